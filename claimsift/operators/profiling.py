"""Corpus statistics per label.

Everything is counted per document in one projection and then summed per label
with partial aggregation, so a label holding most of the corpus costs no more
than any other. Matches that would span two documents are not counted.

Lists are exploded with the outer variant and filtered afterwards: for the inner one
the optimizer adds a size test below, which would run the regexes a second time.

Input: documents with ``id``, ``label`` and ``text``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimsift.fixed_values import (
    CATEGORY_KEYWORDS,
    DATE_PATTERNS,
    FORM_FIELD_PATTERNS,
    MEASUREMENT_PATTERNS,
    MEDICAL_TERMS,
    NUMBER_PATTERN,
    PATIENT_INFO_PATTERNS,
    PERCENTAGE_PATTERN,
    PROFESSIONAL_TITLES,
    STOP_WORDS,
    TIME_REFERENCE_PATTERNS,
)
from claimsift.functions.patterns import (
    SENTENCE_END,
    SPACE,
    WORD,
    all_matches,
    count_matches,
    fold_case,
    strip,
    token_count,
    tokens,
)
from claimsift.operators.ordering import running_totals

# analysis -> (patterns, ignore case)
PATTERN_FAMILIES: dict[str, tuple[Sequence[str], bool]] = {
    "dates": (DATE_PATTERNS, False),
    "form_fields": (FORM_FIELD_PATTERNS, True),
    "time_references": (TIME_REFERENCE_PATTERNS, True),
    "patient_info": (PATIENT_INFO_PATTERNS, True),
    "measurements": (MEASUREMENT_PATTERNS, True),
}


def _sum(column: Column | str) -> Column:
    return F.coalesce(F.sum(column), F.lit(0)).cast("bigint")


def _matches(family: str) -> Column:
    """Matches of a whole family in ``text``, given its folded form ``_folded``."""
    patterns, ignore_case = PATTERN_FAMILIES[family]
    folded = F.col("_folded") if ignore_case else None
    counts = [count_matches(F.col("text"), p, folded) for p in patterns]
    return reduce(lambda a, b: a + b, counts)


def _listed(words: Column, terms: Sequence[str]) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(list(terms))))


def concat_text_by_label(docs: DataFrame, part_bytes: int = 64 << 20) -> DataFrame:
    """Texts of a label joined by one space in id order: (label, part_no, text).

    A label's text has no size limit, so it is cut every ``part_bytes`` bytes; a document
    belongs to the part in which its first byte falls. Joining the parts in order with
    one space gives the whole text.
    """
    sizes = docs.select("label", "id", (F.octet_length("text") + 1).cast("bigint").alias("_size"))
    ends = running_totals(sizes, "id", {"_end": F.col("_size")}, by=["label"])
    part = F.floor((F.col("_end") - F.col("_size")) / F.lit(part_bytes)).cast("bigint")
    parts = ends.select("id", part.alias("part_no"))
    ordered = F.array_sort(F.collect_list(F.struct("id", "text")))
    return (
        docs.join(parts, "id")
        .groupBy("label", "part_no")
        .agg(ordered.alias("d"))
        .select("label", "part_no", F.array_join("d.text", " ").alias("text"))
    )


def keyword_frequency(
    docs: DataFrame, keywords: dict[str, list[str]] = CATEGORY_KEYWORDS
) -> DataFrame:
    """(label, keyword, occurrences): exact tokens; absent keywords count 0."""
    wanted = sorted({k for ks in keywords.values() for k in ks})
    found = (
        docs.select(
            "label",
            F.explode_outer(F.filter(tokens(F.lower("text")), lambda t: t.isin(wanted))).alias("keyword"),
        )
        .filter("keyword IS NOT NULL")
        .groupBy("label", "keyword")
        .agg(F.count("*").alias("n"))
    )
    pairs = [
        F.struct(F.lit(label).alias("label"), F.lit(k).alias("keyword"))
        for label, ks in keywords.items()
        for k in ks
    ]
    listed = docs.sparkSession.range(1).select(F.explode(F.array(*pairs)).alias("p")).select("p.*")
    present = docs.select("label").distinct()
    return (
        listed.join(present, "label", "left_semi")
        .join(found, ["label", "keyword"], "left")
        .select("label", "keyword", F.coalesce("n", F.lit(0)).alias("occurrences"))
    )


def _first_rows(rows: DataFrame, order: Sequence[str], k: int, name: str) -> DataFrame:
    """First k rows per label. The row limit is applied before the shuffle as well."""
    place = F.row_number().over(Window.partitionBy("label").orderBy(*order))
    return rows.withColumn(name, place.cast("bigint")).filter(F.col(name) <= k)


def first_lines(docs: DataFrame, k: int = 3, part_bytes: int = 64 << 20) -> DataFrame:
    """(label, line_no, part_no, line): first k lines of the label's joined text, blank ones left out.

    The last line of a document and the first of the next are one line, so a line has no
    size limit. Documents carry the running number of line feeds before them; only those
    with fewer than k are looked at, and of them only what their first k line feeds end. A
    line is cut every ``part_bytes`` bytes: a document's piece belongs to the part in which
    its first byte falls, and joining the parts in order with one space gives the line.
    """
    text = F.col("text")
    feeds = (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).cast("bigint")
    counted = running_totals(docs.select("label", "id", feeds.alias("_feeds")), "id", {"_to": F.col("_feeds")}, by=["label"])
    early = counted.select("id", (F.col("_to") - F.col("_feeds")).alias("before")).filter(F.col("before") < k)
    heads = docs.select("label", "id", F.substring_index(text, "\n", k).alias("head")).join(early, "id")
    pieces = (
        heads.select("label", "id", "before", F.posexplode(F.split("head", "\n")).alias("pos", "piece"))
        .select("label", "id", (F.col("before") + F.col("pos") + 1).alias("line_no"), "piece")
        .filter(F.col("line_no") <= k)
    )
    # white space around a line is dropped: all before its first piece with more, and behind its last one
    here = ["label", "line_no"]
    filled = pieces.filter(strip(F.col("piece")) != "").groupBy(*here).agg(F.min("id").alias("low"), F.max("id").alias("high"))
    edge = lambda bound: F.col("id") == F.col(bound)
    left = F.when(edge("low"), F.regexp_replace("piece", f"^[{SPACE}]+", "")).otherwise(F.col("piece"))
    kept = pieces.join(filled, here).filter(F.col("id").between(F.col("low"), F.col("high")))
    kept = kept.withColumn("piece", left).withColumn("piece", F.when(edge("high"), F.regexp_replace("piece", f"[{SPACE}]+\\z", "")).otherwise(F.col("piece")))
    kept = kept.select(*here, "id", "piece")
    sizes = kept.select(*here, "id", (F.octet_length("piece") + 1).cast("bigint").alias("_size"))
    ends = running_totals(sizes, "id", {"_end": F.col("_size")}, by=here)
    parts = ends.select(*here, "id", F.floor((F.col("_end") - F.col("_size")) / F.lit(part_bytes)).cast("bigint").alias("part_no"))
    ordered = F.array_sort(F.collect_list(F.struct("id", "piece")))
    return (
        kept.join(parts, [*here, "id"])
        .groupBy(*here, "part_no")
        .agg(ordered.alias("d"))
        .select("label", "line_no", "part_no", F.array_join("d.piece", " ").alias("line"))
    )


def _by_label(rows: DataFrame, value: str) -> Column:
    """A map label -> value as a scalar; rows has one row for each label."""
    return rows.agg(F.map_from_entries(F.collect_list(F.struct("label", value)))).scalar()


def pattern_counts(docs: DataFrame, family: str) -> DataFrame:
    """(label, matches) over all patterns of a family."""
    folded = docs.withColumn("_folded", fold_case(F.col("text")))
    return folded.groupBy("label").agg(_sum(_matches(family)).alias("matches"))


def pattern_samples(docs: DataFrame, family: str, k: int = 2) -> DataFrame:
    """(label, sample_no, sample): first k matches in (pattern, document, position) order."""
    patterns, ignore_case = PATTERN_FAMILIES[family]
    # k matches per document and pattern are enough to decide the first k of a label
    folded = F.col("_folded") if ignore_case else None
    found = F.array(*[F.slice(all_matches(F.col("text"), p, folded), 1, k) for p in patterns])
    matches = (
        docs.withColumn("_folded", fold_case(F.col("text")))
        .select("label", "id", F.posexplode(found).alias("pattern_no", "m"))
        .select("label", "pattern_no", "id", F.posexplode_outer("m").alias("pos", "sample"))
        .filter("sample IS NOT NULL")
    )
    return _first_rows(matches, ["pattern_no", "id", "pos"], k, "sample_no").select(
        "label", "sample_no", "sample"
    )


def numeric_counts(docs: DataFrame) -> DataFrame:
    return docs.groupBy("label").agg(
        _sum(count_matches(F.col("text"), NUMBER_PATTERN)).alias("numbers"),
        _sum(count_matches(F.col("text"), PERCENTAGE_PATTERN)).alias("percentages"),
    )


def term_density(docs: DataFrame, terms: Sequence[str] = MEDICAL_TERMS) -> DataFrame:
    """(label, term_tokens, all_tokens, density)."""
    per_doc = docs.select("label", tokens(F.lower("text")).alias("w")).select(
        "label", _listed(F.col("w"), terms).alias("t"), F.size("w").alias("n")
    )
    sums = per_doc.groupBy("label").agg(
        _sum("t").alias("term_tokens"), _sum("n").alias("all_tokens")
    )
    density = F.when(F.col("all_tokens") == 0, 0.0).otherwise(
        F.try_divide("term_tokens", "all_tokens")
    )
    return sums.withColumn("density", density)


def document_lengths(docs: DataFrame) -> DataFrame:
    """(label, words, sentences, characters); characters include the joining spaces."""
    text = F.col("text")
    return docs.groupBy("label").agg(
        _sum(token_count(text)).alias("words"),
        _sum(F.regexp_count(text, F.lit(SENTENCE_END))).alias("sentences"),
        (_sum(F.length(text)) + F.count("*") - 1).alias("characters"),
    )


def header_footer(docs: DataFrame, width: int = 100) -> DataFrame:
    """(label, header, footer): first and last line of the label's joined text, cut to ``width``.

    The first line ends in the first document with a line feed, the last line begins in
    the last such document. ``width + 1`` documents are enough to fill either, as every
    document adds a space at least.
    """
    text = F.col("text")
    broken = F.when(text.contains("\n"), F.col("id"))
    pieces = docs.select(
        "label", "id", broken.alias("broken"),
        F.substring(F.substring_index(text, "\n", 1), 1, width).alias("first"),
        F.substring(F.substring_index(text, "\n", -1), 1, width).alias("last"),
    )
    ends = pieces.groupBy("label").agg(F.min("broken").alias("lo"), F.max("broken").alias("hi"))
    lo, hi = (F.try_element_at(_by_label(ends.filter("lo IS NOT NULL"), c), F.col("label")) for c in ("lo", "hi"))

    def line(rows: DataFrame, piece: str, name: str) -> DataFrame:
        some = _first_rows(rows, ["id"], width + 1, "_place")
        ordered = F.array_sort(F.collect_list(F.struct("id", piece)))
        return some.groupBy("label").agg(F.substring(F.array_join(ordered[piece], " "), 1, width).alias(name))

    header = line(pieces.filter(F.coalesce(F.col("id") <= lo, F.lit(True))), "first", "header")
    footer = line(pieces.filter(F.coalesce(F.col("id") >= hi, F.lit(True))), "last", "footer")
    return header.join(footer, "label")


def title_counts(docs: DataFrame, titles: Sequence[str] = PROFESSIONAL_TITLES) -> DataFrame:
    counted = _listed(tokens(F.lower("text")), titles)
    return docs.groupBy("label").agg(_sum(counted).alias("titles"))


def corpus_profile(docs: DataFrame) -> DataFrame:
    """All counting analyses in one scan and one small shuffle: (label, metric, value)."""
    text = F.col("text")
    prepared = docs.select(
        "label", "text", fold_case(text).alias("_folded"), tokens(F.lower("text")).alias("w")
    )
    per_doc = prepared.select(
        "label",
        F.lit(1).alias("documents"),
        F.size("w").alias("words"),
        F.regexp_count(text, F.lit(SENTENCE_END)).alias("sentences"),
        F.length(text).alias("characters"),
        *[_matches(family).alias(family) for family in PATTERN_FAMILIES],
        count_matches(text, NUMBER_PATTERN).alias("numbers"),
        count_matches(text, PERCENTAGE_PATTERN).alias("percentages"),
        _listed(F.col("w"), MEDICAL_TERMS).alias("medical_terms"),
        _listed(F.col("w"), PROFESSIONAL_TITLES).alias("titles"),
    )
    metrics = [c for c in per_doc.columns if c != "label"]
    sums = per_doc.groupBy("label").agg(*[_sum(m).alias(m) for m in metrics])
    sums = sums.withColumn("characters", F.col("characters") + F.col("documents") - 1)
    return sums.unpivot("label", metrics, "metric", "value")


def top_terms(
    docs: DataFrame, k: int = 200, min_length: int = 2, stop_words: Sequence[str] = STOP_WORDS
) -> DataFrame:
    """(label, term, occurrences, place): the k most frequent words per label that are no stop words."""
    words = F.regexp_extract_all(
        F.lower("text"), F.lit(f"[{WORD}]{{{min_length},}}"), F.lit(0)
    )
    if stop_words:
        words = F.filter(words, lambda w: ~w.isin(list(stop_words)))
    counts = (
        docs.select("label", F.explode_outer(words).alias("term"))
        .filter("term IS NOT NULL")
        .groupBy("label", "term")
        .agg(F.count("*").alias("occurrences"))
    )
    return _first_rows(counts, [F.desc("occurrences"), "term"], k, "place").select(
        "label", "term", "occurrences", "place"
    )


def run_all_analyses(docs: DataFrame) -> dict[str, DataFrame]:
    """The twelve analyses by name; :func:`corpus_profile` has the counts in one scan."""
    results = {
        "keyword_frequency": keyword_frequency(docs),
        "first_lines": first_lines(docs),
        "numbers": numeric_counts(docs),
        "medical_term_density": term_density(docs),
        "document_lengths": document_lengths(docs),
        "header_footer": header_footer(docs),
        "professional_titles": title_counts(docs),
    }
    for family in PATTERN_FAMILIES:
        results[family] = pattern_counts(docs, family).join(
            pattern_samples(docs, family).groupBy("label").agg(
                F.array_sort(F.collect_list(F.struct("sample_no", "sample"))).alias("samples")
            ),
            "label",
            "left",
        )
    return results
