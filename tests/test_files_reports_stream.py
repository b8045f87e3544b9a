import logging
import re

import pytest
from pyspark.sql import functions as F

from claimsift.functions.patterns import SPACE_CHARS
from claimsift.operators import prototypes, reporting
from claimsift.sources import files, interchange
from claimsift.sources.store import DocumentStore
from claimsift.streaming.ingest import ingest


def test_find_and_extract(spark, tmp_path):
    (tmp_path / "Sleep 1.pdf").write_bytes(b"one\xc3\xa9")
    (tmp_path / "x.PDF").write_bytes(b"no")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "y.pdf").write_bytes(b"no")
    found = files.find_files(spark, str(tmp_path))
    out = files.extract_text(found, lambda content: content.decode()).collect()
    assert [(r.file_name, r.raw_text) for r in out] == [("Sleep 1.pdf", "oneé")]
    assert files.find_files(spark, str(tmp_path / "Sleep 1.pdf")).count() == 1
    with pytest.raises(ValueError):
        files.find_files(spark, str(tmp_path / "missing"))


def test_pages_stay_whole_in_parts(spark):
    pages = spark.createDataFrame([(1, i, f"p{i}") for i in range(25)] + [(2, 0, "only")], "doc_id bigint, page_no bigint, page_text string")
    parts = {(r.doc_id, r.part_no): r.text for r in files.assemble_pages(pages, 10).collect()}
    ours = sorted(k for k in parts if k[0] == 1)
    assert "".join(parts[k] for k in ours) == "".join(f"p{i}\n" for i in range(25)) and len(ours) == 9
    assert parts[(2, 0)] == "only\n"
    assert {r.doc_id for r in files.assemble_pages(pages).collect()} == {1, 2} and files.assemble_pages(pages).count() == 2


def test_timed_returns_result_and_seconds(caplog):
    caplog.set_level(logging.INFO, logger="claimsift.operators.reporting")

    @reporting.timed
    def add(x, y, name="n"):
        return f"{name}: {x + y}"

    result, seconds = add(1, 2, name="sum")
    assert result == "sum: 3" and isinstance(seconds, float)
    assert len(caplog.records) == 1 and "add" in caplog.text and "seconds" in caplog.text


def test_timed_passes_errors_through(caplog):
    caplog.set_level(logging.INFO, logger="claimsift.operators.reporting")

    @reporting.timed
    def fail():
        raise ValueError("Test error")

    with pytest.raises(ValueError, match="Test error"):
        fail()
    assert not caplog.records


META = [
    (1, '{"OCR": {"time": 1.5}, "Text Cleaning": {"time": 0.25}, "Classification": {"time": 2, "cost": 0.00012}}'),
    (2, "{}"), (3, "{bad"), (4, None), (5, ""), (6, "[1]"), (7, '{"OCR": {"time": 3}}'),
]


def test_stage_times_and_costs(spark):
    df = spark.createDataFrame(META, "id bigint, process_metadata string")
    times = reporting.stage_times(df)
    got = {r.id: (float(r.ocr), float(r.text_cleaning), float(r.classification)) for r in times.collect()}
    assert got == {1: (1.5, 0.25, 2.0), 2: (0, 0, 0), 7: (3.0, 0, 0)}
    costs = reporting.document_costs(df)
    assert costs.count() == 7
    s = reporting.cost_summary(costs).first()
    assert (s.documents, s.total_cost) == (7, pytest.approx(0.00012))
    empty = reporting.cost_summary(costs.filter("id < 0")).first()
    assert (empty.documents, empty.total_cost, empty.average_cost) == (0, 0.0, 0.0)
    box = {r.stage: r for r in reporting.stage_time_box(times).collect()}
    assert (box["OCR"].low, box["OCR"].median, box["OCR"].high) == (0.0, 1.5, 3.0)
    hist = {r.bin: r.documents for r in reporting.cost_histogram(costs).collect()}
    assert hist == {0: 6, 1: 1}


def test_stages_that_are_no_objects(spark):
    rows = [(1, '{"OCR": null}'), (2, '{"OCR": 5}'), (3, '{"OCR": {"time": null}, "Classification": {"time": 2}}'),
            (4, '{"OCR": {"time": 0.0000001}}'), (5, '{"Text Cleaning": {}}')]
    times = reporting.stage_times(spark.createDataFrame(rows, "id bigint, process_metadata string"))
    number = lambda x: None if x is None else float(x)
    got = {r.id: (number(r.ocr), number(r.text_cleaning), number(r.classification)) for r in times.collect()}
    assert got == {3: (None, 0.0, 2.0), 4: (1e-7, 0.0, 0.0), 5: (0.0, 0.0, 0.0)}
    averages = {r.stage: r.average for r in reporting.stage_time_averages(times).collect()}
    assert averages["OCR"] == pytest.approx(1e-7 / 2) and averages["Classification"] == pytest.approx(2 / 3)
    totals = {r.id: r.ocr_total for r in reporting.cumulative_stage_times(times).collect()}
    assert totals[3] is None and float(totals[5]) == 1e-7


def test_high_confidence_map(spark):
    rows = [(1, '{"A": 0.5, "B": 1}'), (2, ""), (3, None), (4, "[1]")]
    df = spark.createDataFrame(rows, "id int, s string").select("id", reporting.high_confidence_map(F.col("s")).alias("m"))
    assert {r.id: r.m for r in df.collect()} == {1: {"A": 0.5, "B": 1.0}, 2: {}, 3: {}, 4: {}}


def test_metadata_round_trip(spark):
    seconds = {s: F.lit(1.5) for s in reporting.STAGES}
    df = spark.range(1).select("id", reporting.process_metadata(seconds, F.lit(0.25)).alias("process_metadata"))
    assert float(reporting.document_costs(df).first().cost) == 0.25
    assert float(reporting.stage_times(df).first().text_cleaning) == 1.5


def test_prototypes(spark):
    rows = [(0, "x", [1.0, 0.0]), (1, "y", [0.0, 2.0]), (2, "y", [0.0, 0.0])]
    model = prototypes.PrototypeModel.fit(spark.createDataFrame(rows, "vec_id bigint, label string, embedding array<float>"))
    vecs = spark.createDataFrame([(9, [3.0, 0.1]), (8, [-1.0, -1.0]), (7, [1.0, 1.0]), (6, None)], "vec_id bigint, embedding array<float>")
    got = {r.vec_id: r for r in prototypes.classify_by_prototypes(vecs, model).collect()}
    assert got[9].predicted_class == "x" and got[8].predicted_class == "Unknown"
    assert got[7].predicted_class == "x" and got[7].confidence == pytest.approx(0.5**0.5)
    assert got[6].predicted_class is None
    with pytest.raises(ValueError):
        prototypes.PrototypeModel.fit(spark.createDataFrame([], "vec_id bigint, label string, embedding array<float>"))


def test_stream_in_two_runs(spark, tmp_path):
    source, schema = tmp_path / "in", "file_name string, file_location string, raw_text string, seq bigint"
    source.mkdir()

    def arrive(name, *rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.parquet(str(source / name))

    def run():
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(source))
        ingest(stream, s, str(tmp_path / "progress")).awaitTermination()

    s = DocumentStore(spark, interchange.shared_folder(spark))
    arrive("one", ("a", "/a", "sleep study apnea", 1), ("b", "/b", "-- nothing", 2))
    run()
    arrive("two", ("b", "/b", "Rx:5 refills: 3", 1))
    run()
    run()
    got = {r.file_name: (r.id, r.classified_category, r.cleaned_text) for r in s.current().collect()}
    assert got == {"a": (1, "Sleep", "sleep study apnea"), "b": (2, "Prescription", "Rx:5 refills: 3")}


def test_words_are_counted_without_making_them(spark):
    """Counts equal those of str.split for every kind of white space, across parts of a batch, for null and empty texts."""
    some = ["", " ", "a", " a", "a ", "ab  cd\n", "é ü", "　日本　語", " x y​z", " a᠎b", "a\x1cb\x85c\x00d", "â€€ "]
    texts = [*some, None, *[c.join(["wÂ", "\U0001f600", ""]) for c in SPACE_CHARS], "long word " * 300_000, *some]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, text string").coalesce(1)
    counted = rows.select("id", files.word_count(F.col("text")).alias("words"))
    got = dict(counted.collect())
    assert got == {k: None if t is None else len(re.findall(f"[^{SPACE_CHARS}]+", t)) for k, t in enumerate(texts)}
    assert "regexp" not in counted._jdf.queryExecution().executedPlan().toString()
