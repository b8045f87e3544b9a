import re

import pytest
from pyspark.sql import functions as F

from claimsift.sources import interchange, store

S = store.DOCUMENT_SCHEMA
B = ", ".join(f for f in S.split(", ") if f.split()[0] in store.BATCH_COLUMNS) + ", seq bigint"


def target(spark):
    return spark.createDataFrame([(7, "a", "/a", "old", "old", "X", 0.5, None, None, "T")], S)


def batch(spark, *rows):
    """Rows (name, location, raw, clean, class, confidence, seq)."""
    return spark.createDataFrame([(*r[:6], "{}", "{}", r[6]) for r in rows], B)


def table(df):
    return {r.file_name: r for r in df.collect()}


def test_upsert_keeps_and_overwrites(spark):
    b = batch(spark, ("a", "/new", "r1", "", None, 0.0, 1), ("n2", "/n2", "r", "c", "Y", 0.1, 9),
              ("n1", "/n1", "r", "c", "Y", 0.1, 2), ("n1", "/later", "last", "c", "Z", 0.2, 3))
    got = table(store.upsert_documents(target(spark), b))
    assert (got["a"].id, got["a"].file_location, got["a"].ground_truth) == (7, "/a", "T")
    assert (got["a"].raw_text, got["a"].cleaned_text, got["a"].classified_category, got["a"].confidence) == ("r1", "", None, 0.0)
    assert (got["n1"].id, got["n1"].file_location, got["n1"].raw_text) == (8, "/n1", "last")
    assert got["n2"].id == 9


def test_upsert_twice_is_once(spark):
    b = batch(spark, ("a", "/x", "r", "c", "Y", 0.9, 1), ("b", "/b", "r", "c", "Y", 0.9, 2))
    once = store.upsert_documents(target(spark), b)
    assert table(store.upsert_documents(once, b)) == table(once)


def test_partial_upsert_ignores_empty_values(spark):
    b = batch(spark, ("a", "/x", "", "c1", None, 0.0, 1), ("a", "/x", "r2", "", "Y", 0.0, 2), ("n", "/n", "", "c", "", 0.0, 3), ("n", "/n2", "r", "", "", 0.0, 4))
    got = table(store.partial_upsert_documents(target(spark), b))
    assert (got["a"].raw_text, got["a"].cleaned_text, got["a"].classified_category, got["a"].confidence) == ("r2", "c1", "Y", 0.5)
    assert (got["n"].raw_text, got["n"].cleaned_text, got["n"].classified_category, got["n"].confidence) == ("r", "c", "", 0.0)
    assert got["n"].file_location == "/n"


def test_store_replay_and_compaction(spark):
    s = store.DocumentStore(spark, interchange.shared_folder(spark))
    first = batch(spark, ("a", "/a", "v0", "c", "Y", 0.1, 5), ("b", "/b", "v0", "c", "Y", 0.1, 6))
    second = batch(spark, ("b", "/b2", "v1", "c", "Z", 0.2, 1), ("c", "/c", "v1", "c", "Z", 0.2, 2))
    assert s.current().count() == 0
    s.append(first, 0)
    s.append(second, 1)
    s.append(second, 1)
    merged = table(s.current())
    assert {n: (r.id, r.raw_text) for n, r in merged.items()} == {"a": (1, "v0"), "b": (2, "v1"), "c": (3, "v1")}
    s.compact()
    s.compact()
    assert table(s.current()) == merged
    s.append(batch(spark, ("a", "/z", "v2", "c", "Q", 0.3, 1)), 2)
    assert table(s.current())["a"].raw_text == "v2" and table(s.current())["a"].id == 1


def test_hot_name_is_reduced_before_the_shuffle(spark):
    b = spark.range(1000).select(F.lit("hot").alias("file_name"), F.lit("/h").alias("file_location"),
                                 *[F.lit("x").alias(c) if c != "confidence" else F.lit(0.1).alias(c) for c in store.OVERWRITTEN],
                                 F.col("id").alias("seq"))
    df = store.upsert_documents(target(spark), b)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan and table(df)["hot"].id == 8


def test_keyed_json_files(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"A 1.pdf": {"text": "x\\ny", "label": "A"}, "B.pdf": {"text": "z", "label": "B"}}')
    got = interchange.read_keyed_json(spark, str(tmp_path), "struct<text: string, label: string>").collect()
    assert {(r.file_name, r.text, r.label) for r in got} == {("A 1.pdf", "x\ny", "A"), ("B.pdf", "z", "B")}
    folder = tmp_path / "e"
    folder.mkdir()
    (folder / "e.json").write_text('{"m": {"total_time": 1.5, "per_file_times": {"f": 1.5}, "texts": {"f": "t"}}}')
    assert tuple(interchange.read_extraction_results(spark, str(folder)).first()) == ("m", "f", 1.5, "t")


class _Session:
    """The two things the folder lookup asks a session for."""

    def __init__(self, folder, master):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = type("C", (), {"master": master, "applicationId": "x"})


def test_shared_folder_uses_the_session_setting():
    assert interchange.shared_folder(_Session("/mnt/all/", "yarn")).startswith("/mnt/all/claimsift-")
    with pytest.raises(ValueError):
        interchange.shared_folder(_Session(None, "yarn"))
    assert "claimsift-" in interchange.shared_folder(_Session(None, "local[2]"))


def test_first_rows_leave_their_texts_behind(spark):
    """Texts of a first row are not shuffled along when a later row, or the row itself, has one; unfilled ones still count."""
    some = batch(spark, ("a", "/a", "r", "", None, 0.0, 1), ("a", "/b", "", "", "Y", 0.5, 2), ("b", "/c", "", None, "", None, 3))
    merged = store.partial_upsert_documents(spark.createDataFrame([], store.DOCUMENT_SCHEMA), some)
    assert not re.search(r"struct\(raw_text, raw_text#", merged._jdf.queryExecution().optimizedPlan().toString())
    got = table(merged)
    assert (got["a"].raw_text, got["a"].cleaned_text, got["a"].classified_category, got["a"].confidence) == ("r", "", "Y", 0.5)
    assert (got["b"].raw_text, got["b"].cleaned_text, got["b"].classified_category, got["b"].confidence) == ("", None, "", None)
