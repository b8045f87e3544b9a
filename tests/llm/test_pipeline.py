import sys

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from claimsift.llm.language import UNDETERMINED
from test_decontaminate import brute as overlaps
from test_line_runs import brute as kept_lines
from test_simhash import brute_fingerprint, brute_groups


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("row", F.lit("clash"))


def test_stages():
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language ID", "line dedup", "SimHash near-dedup", "benchmark decontamination", "byte-level BPE"]


def test_language_keeps_documents_with_a_language(spark, docs, small):
    extra = spark.createDataFrame([(-1, None), (-2, ""), (-3, "... 123"), (-4, "漢字" * 50)], "doc_id long, text string")
    kept = corpus_pipeline.language(spark, docs.unionByName(extra, allowMissingColumns=True), small)
    assert kept.columns == docs.columns
    assert {r[0] for r in kept.select("doc_id").collect()} == {r[0] for r in docs.select("doc_id").collect()}
    assert UNDETERMINED == "und"


def test_line_dedup(spark, docs, small):
    got = corpus_pipeline.line_dedup(spark, docs, small)
    assert got.columns == docs.columns and got.dtypes == docs.dtypes
    rows = got.collect()
    want = kept_lines([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sorted(repr((r["doc_id"], r["text"])) for r in rows) == sorted(repr(eval(w)[:2]) for w in want)  # noqa: S307
    assert all(r["n_chars"] == len(r["text"]) for r in rows)


def test_one_document_of_each_group_stays(spark, docs, small):
    rows = docs.collect()
    groups = brute_groups([r["doc_id"] for r in rows], [brute_fingerprint(r["text"]) for r in rows])
    got = corpus_pipeline.near_duplicates(spark, docs.unionByName(docs.limit(3)), small)
    assert got.columns == docs.columns
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(set(groups))


def test_contaminated_documents_go(spark, docs, small):
    item = spark.read.parquet(f"{small}/benchmark.parquet").first()["text"]
    planted = spark.createDataFrame([(-1, f"words before {item} words after"), (-2, "clean words only")], "doc_id long, text string")
    got = corpus_pipeline.decontamination(spark, planted, small)
    assert [r["doc_id"] for r in got.collect()] == [-2] and overlaps(item, item)


def test_run_equals_its_stages(spark, small):
    rows = corpus_pipeline.run(spark, small).collect()
    ids = {r["doc_id"] for r in rows}
    assert len(ids) == len(rows) > 0 and all(r["n_tokens"] > 0 or r["decoded_sha256"].startswith("e3b0c442") for r in rows)


def test_nulls_and_repeated_rows(spark, small):
    item = spark.read.parquet(f"{small}/benchmark.parquet").first()["text"]
    rows = [(1, None, None, None, 0), (None, "the the and of this", "en", "s", 5), (None, "another text without an id", "en", "s", 5), (None, item, "en", "s", 5), (2, "the of and in to", None, None, None), (2, "the of and in to", None, None, None), (3, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
    assert sorted((r["doc_id"] or -1) for r in docs.collect()) == [-1, -1, 2]


def test_empty_table(spark, docs, small):
    now = docs.filter(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, small)
        assert now.count() == 0


def test_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(entry.oracle_sql()) <= names and "corpus_pipeline" in sys.modules
