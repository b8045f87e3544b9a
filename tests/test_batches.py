import pytest
from pyspark.sql import functions as F

from claimsift.sources import interchange
from claimsift.sources.partitioned_store import PartitionedStore
from claimsift.streaming import batches
from claimsift.streaming.batches import BatchSinks, extract_or_reject, ingest_batches, run_batch

SCHEMA = "file_name string, file_location string, raw_text string, seq bigint"
ROWS = [
    ("a", "/a", "sleep study apnea", 1), ("b", "/b", None, 2), ("c", "/c", "  ", 3), ("d", "/d", "*** ///", 4), (None, "/e", "text", 5),
    ("f", "/f", "nothing known here", 6), ("g", "/g", "Rx:5 refills: 3", 7),
]
DEAD = {
    ("b", "Text", "no text"), ("c", "Text", "blank text"), ("d", "Text Cleaning", "nothing left after cleaning"), (None, "Text", "no file name"),
    ("f", "Classification", "no class"),
}


@pytest.fixture
def made(spark):
    folder = interchange.shared_folder(spark)
    return PartitionedStore(spark, f"{folder}/store", 4, 2), BatchSinks(spark, f"{folder}/sinks")


def dead(sinks):
    return sorted(((r.file_name or "", r.stage, r.reason, r.batch) for r in sinks.dead_letters().collect()))


def test_every_row_reaches_one_sink_and_a_replay_adds_nothing(spark, made):
    store, sinks = made
    batch = spark.createDataFrame(ROWS, SCHEMA)
    assert sinks.dead_letters().count() == 0 and sinks.stage_log().count() == 0
    run_batch(batch, 0, store, sinks)
    for _ in range(2):
        assert dead(sinks) == sorted((n or "", s, r, 0) for n, s, r in DEAD)
        assert {r.file_name: (r.id, r.classified_category) for r in store.current().collect()} == {"a": (1, "Sleep"), "g": (2, "Prescription")}
        log = {r.stage: (r.place, r.documents, r.rejected, r.characters) for r in sinks.stage_log().collect()}
        assert log == {"Text": (0, 7, 3, 57), "Text Cleaning": (1, 4, 1, 50), "Classification": (2, 3, 1, 32)}
        assert all(r.seconds >= 0 and r.batch == 0 for r in sinks.stage_log().collect())
        run_batch(batch, 0, store, sinks)


def test_a_failure_between_the_sinks_is_mended_by_the_replay(spark, made, monkeypatch):
    store, sinks = made
    batch = spark.createDataFrame(ROWS, SCHEMA)
    write = sinks.write
    monkeypatch.setattr(sinks, "write", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        run_batch(batch, 3, store, sinks)
    assert store.current().count() == 2 and sinks.dead_letters().count() == 0
    monkeypatch.setattr(sinks, "write", write)
    run_batch(batch, 3, store, sinks)
    assert store.current().count() == 2 and len(dead(sinks)) == 5 and sinks.stage_log().count() == 3


def test_a_file_that_cannot_be_read_is_a_dead_letter(spark, made):
    store, sinks = made
    rows = [("a", "/a", b"sleep study apnea", 1), ("b", "/b", b"\xff\xfe", 2), ("c", "/c", None, 3)]
    files = spark.createDataFrame(rows, "file_name string, file_location string, content binary, seq bigint")
    stages = [("OCR", extract_or_reject(lambda content: content.decode()), "raw_text"), *batches.STAGES]
    run_batch(files, 0, store, sinks, stages)
    assert dead(sinks) == [("b", "OCR", "extraction failed: UnicodeDecodeError", 0), ("c", "OCR", "no content", 0)]
    assert [r.file_name for r in store.current().collect()] == ["a"]
    assert [r.documents for r in sinks.stage_log().orderBy("place").collect()] == [3, 1, 1, 1]


def test_stream_in_several_batches(spark, made, tmp_path):
    store, sinks = made
    source = tmp_path / "in"
    source.mkdir()

    def run():
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(str(source))
        ingest_batches(stream, store, sinks, str(tmp_path / "progress")).awaitTermination()

    spark.createDataFrame(ROWS[:4], SCHEMA).coalesce(1).write.parquet(str(source / "one"))
    run()
    spark.createDataFrame([*ROWS[4:], ("a", "/z", "Rx:5 refills: 1", 8)], SCHEMA).coalesce(1).write.parquet(str(source / "two"))
    run()
    run()
    assert {(n or None, s, r) for n, s, r, _ in dead(sinks)} == DEAD and {b for *_, b in dead(sinks)} == {0, 1}
    assert {r.file_name: (r.id, r.classified_category, r.file_location) for r in store.current().collect()} == {
        "a": (1, "Prescription", "/a"), "g": (2, "Prescription", "/g")
    }
    log = sinks.stage_log().groupBy("stage").agg(F.sum("documents").alias("n"), F.sum("rejected").alias("r")).collect()
    assert {r.stage: (r.n, r.r) for r in log} == {"Text": (8, 3), "Text Cleaning": (5, 1), "Classification": (4, 1)}
