"""Licence scan: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

A file's licence header is any line with a licence word, or any such sentence or clause of it; a licence file (by its
name) is also compared as a whole. Word weights are term frequency times inverse document frequency, of every word and
over all these lines and licence files of the corpus; vectors hold only the words that occur. The template with the
largest cosine names the licence if the cosine reaches the threshold.

Equal candidates are compared once. The words of the templates and the most common others have their weights in the
comparing function, so no hot word is shuffled; the squared weights of all further words come by a join with their
frequencies and are summed for each candidate.

A directory has the licence of its licence file. Directories, not files, look for their nearest licensed ancestor, by
a join of every directory's ancestor paths with the licensed directories; files then join their directory.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimsift.llm.common import cut, map_chunks, texts_of

# Licence names and the wording of their headers and notices, for comparison.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license. See LICENSE for details."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it under the terms of the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
#: A line with one of these is a candidate.
CUES = ("licen", "copyright", "spdx", "permission is", "redistribut", "public domain", "subject to the terms", "free software", "creative commons")
LICENSE_FILE = r"(?i)^(licen[sc]e|copying|unlicense)([.-].*)?$"

WORD = re.compile(r"[a-z0-9]+")
SENTENCE_END = re.compile(r"(?<=[.!?])\s+")
#: Clauses end at a semicolon or colon, and at a comma if a licence word follows before the next mark.
CLAUSE_END = re.compile(rf"(?<=[.!?;:])\s+|(?<=,)\s+(?=[^.,;:]*(?:{'|'.join(CUES)}))", re.I)
#: Words whose weights all tasks hold, besides those of the templates; longer words are always joined.
COMMON_WORDS, COMMON_LENGTH = 4096, 100


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


VOCABULARY = sorted({w for _, text in TEMPLATES for w in words_of(text)})


class TemplateVectors:
    """Unit vectors of the templates, and the cosine of any text to them, under given document frequencies.

    A word without a frequency weighs as one that no candidate holds, unless the squared weights of such words of a text
    are given.
    """

    def __init__(self, frequency: dict[str, int], total: int):
        self.idf = {w: math.log((1 + total) / (1 + frequency.get(w, 0))) + 1 for w in frequency.keys() | set(VOCABULARY)}
        self.rare = math.log(1 + total) + 1
        self.vectors = [(name, self._unit(text)) for name, text in TEMPLATES]

    def _unit(self, text: str, others: float | None = None) -> dict[str, float]:
        counts = Counter(words_of(text))
        weights = {w: n * self.idf[w] for w, n in counts.items() if w in self.idf}
        if others is None:
            others = sum((n * self.rare) ** 2 for w, n in counts.items() if w not in self.idf)
        length = math.sqrt(sum(x * x for x in weights.values()) + others)
        return {w: x / length for w, x in weights.items()} if length else {}

    def best(self, text: str, others: float | None = None) -> tuple[str | None, float]:
        """The licence of the closest template (the first of equals) and the cosine."""
        vector = self._unit(text, others)
        name, cosine = None, 0.0
        for candidate, template in self.vectors:
            dot = sum(x * vector[w] for w, x in template.items() if w in vector)
            if dot > cosine:
                name, cosine = candidate, dot
        return name, min(cosine, 1.0)


def _has_cue(text: str) -> bool:
    lower = text.lower()
    return any(cue in lower for cue in CUES)


def candidates(text: str, whole: bool) -> list[tuple[str, bool]]:
    """(candidate, whether its words count for the frequencies): lines and whole texts do, their parts do not again."""
    if not _has_cue(text):
        return []
    lines = [line for line in text.split("\n") if _has_cue(line)]
    parts = []
    for line in lines:
        pieces = dict.fromkeys([*SENTENCE_END.split(line), *CLAUSE_END.split(line)])
        parts += [(piece, False) for piece in pieces if piece != line and _has_cue(piece)]
    return [*((line, True) for line in lines), *parts, *([(text, True)] if whole else [])]


def _square_weights(texts: DataFrame, total: int) -> tuple[dict[str, int], DataFrame]:
    """Frequencies of the common words, and (row, others): squared weights of a candidate's other words."""

    def count_words(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, numbers, words, times = [], [], [], []
        for row, number, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
            counts = Counter(words_of(text))
            rows += [row] * len(counts)
            numbers += [number] * len(counts)
            words += counts.keys()
            times += counts.values()
        columns = [pa.array(rows, pa.int64()), pa.array(numbers, pa.int64()), pa.array(words, pa.string()), pa.array(times, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["row", "n", "word", "times"])

    words = cut(map_chunks(texts.select("row", "n", "candidate"), count_words, "row bigint, n bigint, word string, times bigint", "candidate"))
    frequencies = cut(words.groupBy("word").agg(F.sum("n").alias("frequency"), F.count("*").alias("rows")))
    listed = frequencies.filter(F.col("word").isin(VOCABULARY))
    common = frequencies.filter(F.length("word") <= COMMON_LENGTH).orderBy(F.desc("rows"), "word").limit(COMMON_WORDS)
    known = dict.fromkeys(VOCABULARY, 0) | {r["word"]: r["frequency"] for part in (listed, common) for r in part.collect()}
    known_words = F.broadcast(texts.sparkSession.createDataFrame([(w,) for w in known], "word string"))
    weight = F.col("times") * (F.log((1 + F.lit(total)) / (1 + F.col("frequency"))) + 1)
    others = (
        words.join(known_words, "word", "left_anti")
        .join(frequencies.select("word", "frequency"), "word")
        .groupBy("row")
        .agg(F.sum(weight * weight).alias("others"))
    )
    return known, others


def _ancestors(directory: Column) -> Column:
    """The directory itself, its parent, and so on up to the root ""."""
    parts = F.split(directory, "/")
    return F.concat(
        F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/")), F.array(F.lit(""))
    )


def scan_licenses(files: DataFrame, id_col: str, path_col: str, text_col: str, threshold: float = 0.6) -> DataFrame:
    """(id, path, license, found, similarity, licensed_by): one row for each file.

    ``found`` is ``header`` for a licence in the file itself (a licence file included), ``inherited`` for that of the
    nearest directory above, else null with a null license. ``similarity`` is the cosine, ``licensed_by`` the id of the
    file that holds the licence. Of several candidates in a file, or licence files in a directory, the largest cosine
    wins, then the smallest licence name, then the smallest id. Null text counts as empty, a null path as a file in the root
    directory. Repeated rows stay repeated. Without any candidate nothing is licensed; an empty table stays empty.
    """
    rows = files.select(
        F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{path_col}`"), F.lit("")).alias("path"), F.col(f"`{text_col}`").alias("text")
    )
    name = F.substring_index("path", "/", -1)
    directory = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
    is_license_file = name.rlike(LICENSE_FILE)

    def find(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, found, counts = [], [], []
        for row, (text, whole) in enumerate(zip(texts_of(batch.column(2)), batch.column(3).to_pylist())):
            for candidate, counting in candidates(text, whole):
                at.append(row)
                found.append(candidate)
                counts.append(counting)
        index = pa.array(at, pa.int64())
        columns = [batch.column(0).take(index), batch.column(1).take(index), batch.column(3).take(index), pa.array(found, pa.string()), pa.array(counts, pa.bool_())]
        return pa.RecordBatch.from_arrays(columns, names=["id", "path", "whole", "candidate", "counting"])

    id_type = dict(rows.dtypes)["id"]
    found = cut(
        map_chunks(
            rows.select("id", "path", F.coalesce("text", F.lit("")).alias("text"), is_license_file.alias("whole")),
            find, f"id {id_type}, path string, whole boolean, candidate string, counting boolean", "text",
        ).withColumn("key", F.sha2("candidate", 256))
    )
    texts = cut(
        found.groupBy("key")
        .agg(F.first("candidate").alias("candidate"), F.sum(F.col("counting").cast("bigint")).alias("n"))
        .withColumn("row", F.monotonically_increasing_id())
    )
    total = texts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    frequency, others = _square_weights(texts, total)
    vectors = TemplateVectors(frequency, total)

    @F.arrow_udf("struct<license string, similarity double>")
    def closest(texts: pa.Array, others: pa.Array) -> pa.Array:
        best = [vectors.best(t, x) for t, x in zip(texts.to_pylist(), others.to_pylist())]
        return pa.StructArray.from_arrays(
            [pa.array([b[0] for b in best], pa.string()), pa.array([round(b[1], 9) for b in best], pa.float64())], ["license", "similarity"]
        )

    licences = cut(
        texts.join(others, "row", "left")
        .select("key", closest("candidate", F.coalesce("others", F.lit(0.0))).alias("best"))
        .select("key", "best.*")
        .filter(F.col("similarity") >= threshold)
    )
    rank = F.struct(-F.col("similarity"), F.col("license"), F.col("id"))
    own = cut(
        found.select("id", "path", "whole", "key").join(licences, "key")
        .groupBy("id", "path", "whole")
        .agg(F.min(rank).alias("r"))
        .select("id", "path", "whole", F.col("r.license").alias("license"), (-F.col("r.col1")).alias("similarity"))
    )
    licensed = (
        own.filter("whole")
        .groupBy(directory.alias("ancestor"))
        .agg(F.min(rank).alias("r"))
        .select("ancestor", F.struct(F.col("r.license").alias("license"), (-F.col("r.col1")).alias("similarity"), F.col("r.id").alias("licensed_by")).alias("theirs"))
    )
    directories = rows.select(directory.alias("directory")).distinct()
    inherited = cut(
        directories.select("directory", F.explode(_ancestors(F.col("directory"))).alias("ancestor"))
        .join(licensed, "ancestor")
        .groupBy("directory")
        .agg(F.max_by("theirs", F.length("ancestor")).alias("theirs"))
    )
    own = own.select("id", "path", F.struct("license", "similarity", F.col("id").alias("licensed_by")).alias("own"))
    return (
        rows.select("id", "path", directory.alias("directory"))
        .join(own.select(F.col("id").alias("own_id"), F.col("path").alias("own_path"), "own"), F.col("id").eqNullSafe(F.col("own_id")) & (F.col("path") == F.col("own_path")), "left")
        .join(inherited, "directory", "left")
        .select("id", "path", F.coalesce("own", "theirs").alias("best"), F.when(F.col("own").isNotNull(), "header").when(F.col("theirs").isNotNull(), "inherited").alias("found"))
        .select(F.col("id").alias(id_col), F.col("path").alias(path_col), "best.license", "found", "best.similarity", "best.licensed_by")
    )
