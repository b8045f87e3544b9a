import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from claimsift.llm import licenses
from claimsift.llm.licenses import CUES, TEMPLATES, VOCABULARY, TemplateVectors, scan_licenses, words_of
from claimsift.llm.queries import QUERIES


def scan(spark, rows):
    files = spark.createDataFrame(rows, "id long, path string, text string").withColumn("license", F.lit("clash")).withColumn("own", F.lit(1))
    return {r["id"]: (r["license"], r["found"], r["licensed_by"]) for r in scan_licenses(files, "id", "path", "text").collect()}


def test_cosine_equals_the_dense_one():
    frequency, total = {"license": 50, "mit": 7}, 60
    vectors = TemplateVectors(frequency, total)
    text = "This file is released under the MIT License, whatever that is."
    idf = lambda w: math.log((1 + total) / (1 + frequency.get(w, 0))) + 1 if w in VOCABULARY else math.log(1 + total) + 1
    best = (None, 0.0)
    for name, template in TEMPLATES:
        a, b = Counter(words_of(text)), Counter(words_of(template))
        dot = sum(a[w] * idf(w) * b[w] * idf(w) for w in a.keys() | b.keys())
        size = math.sqrt(sum((n * idf(w)) ** 2 for w, n in a.items()) * sum((n * idf(w)) ** 2 for w, n in b.items()))
        if dot / size > best[1]:
            best = name, dot / size
    assert vectors.best(text)[0] == best[0] == "MIT" and abs(vectors.best(text)[1] - best[1]) < 1e-12


@pytest.mark.parametrize("name,text", TEMPLATES)
def test_every_template_has_a_cue_and_finds_itself(name, text):
    assert any(cue in text.lower() for cue in CUES)
    assert TemplateVectors({}, 0).best(text)[0] == name


def test_nearest_ancestor_wins(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    got = scan(spark, [
        (1, "a/LICENSE", mit), (2, "a/b/COPYING.txt", gpl), (3, "a/x.txt", "text"), (4, "a/b/y.txt", "text"), (5, "a/b/c/d/z.txt", "text"),
        (6, "ab/x.txt", "text"), (7, "a/b/own.txt", f"some words\n{mit}\nmore"), (8, "top.txt", "text"), (9, "a/c/LICENSE", "no notice here"), (10, "a/c/w", "x"),
    ])
    assert got == {
        1: ("MIT", "header", 1), 2: ("GPL-3.0", "header", 2), 3: ("MIT", "inherited", 1), 4: ("GPL-3.0", "inherited", 2), 5: ("GPL-3.0", "inherited", 2),
        6: (None, None, None), 7: ("MIT", "header", 7), 8: (None, None, None), 9: ("MIT", "inherited", 1), 10: ("MIT", "inherited", 1),
    }


def test_a_license_far_down_a_long_text_is_found(spark):
    text = "word " * 50000 + "\nLicensed under CC BY-NC 4.0.\n" + "word " * 100
    assert scan(spark, [(1, "x", text)])[1][0] == "CC-BY-NC-4.0"


def test_words_of_many_headers_weigh_little(spark):
    gpl = "This package is licensed under the GNU General Public License, version 3."
    mit = "Copyright 2024 Acme Corp. Licensed under the MIT License."
    own = [f"// Copyright {k}, licensed under the MIT license; own{k}" for k in range(30)] + [mit]
    templates = [text for _, text in TEMPLATES[:2] + TEMPLATES[5:6]] * 50
    got = scan(spark, [(k, f"a{k}/x", text) for k, text in enumerate([gpl] * 300 + own + templates)])
    assert [got[k][:2] for k in range(331)] == [("GPL-3.0", "header")] * 300 + [("MIT", "header")] * 31


def test_similarity_counts_every_word(spark, monkeypatch):
    lines = [f"Licensed under the MIT license by {' '.join(f'w{j}' for j in range(k % 5))} own{k}" for k in range(40)]
    frequency = Counter(w for line in lines for w in set(words_of(line)))
    vectors = TemplateVectors(frequency, len(lines))
    want = {k: round(vectors.best(line)[1], 9) for k, line in enumerate(lines)}
    files = spark.createDataFrame([(k, f"d{k}/x", line) for k, line in enumerate(lines)], "id long, path string, text string")
    for most in (4096, 3):  # weights of all words in the tasks, or of most words by the join
        monkeypatch.setattr(licenses, "COMMON_WORDS", most)
        got = {r["id"]: r["similarity"] for r in scan_licenses(files, "id", "path", "text", threshold=0.01).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-9 for k in want)


def test_edges(spark):
    mit = "Released under the MIT License."
    got = scan(spark, [(1, None, "text"), (2, "d/f", None), (3, "d/g", ""), (None, "LICENSE", mit), (5, "LICENSE", mit), (6, "e/h", "t"), (6, "e/h", "t")])
    assert got[6] == got[2] == got[1] == ("MIT", "inherited", None)
    empty = spark.createDataFrame([], "id long, path string, text string")
    assert scan_licenses(empty, "id", "path", "text").count() == 0
    files = spark.createDataFrame([(6, "e/h", "t"), (6, "e/h", "t"), (7, "i", mit), (7, "i", mit)], "id long, path string, text string")
    assert scan_licenses(files, "id", "path", "text").count() == 4


def test_query(spark, small):
    rows = QUERIES["op9_license_scan"](spark, "/root/testdata/sf0.01").collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert len(rows) == len(texts)
    marks = {"MIT": "MIT License.", "Apache-2.0": "Apache License, Version 2.0.", "GPL-3.0": "GNU General Public License, version 3.", "CC-BY-NC-4.0": "CC BY-NC 4.0."}
    for r in rows:
        held = [name for name, mark in marks.items() if mark in texts[r["doc_id"]]]
        assert (r["found"] == "header") == bool(held) and (not held or r["license"] in held)
    assert any(r["found"] == "inherited" for r in rows)
