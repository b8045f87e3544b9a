import pytest

from claimsift.operators import profiling


@pytest.mark.parametrize("texts", [
    ["one", "two\nthree", "four"], ["a"] * 7, ["a\nb\nc\nd\ne", "f"], ["x", "y", "\n", "z\n\n\nw", "v"], ["", "a\n", "", "b"], ["only"], ["x" * 300, "y\n" + "z" * 300, "w"],
])
def test_lines_of_the_joined_text(spark, texts):
    docs = spark.createDataFrame([(i, "L", t) for i, t in enumerate(texts)] + [(99, "M", "other")], "id bigint, label string, text string").repartition(3)
    lines = " ".join(texts).split("\n")
    got = {r.line_no: r.line for r in profiling.first_lines(docs).filter("label = 'L'").collect()}
    assert got == {i: x.strip() for i, x in enumerate(lines[:3], 1) if x.strip()}
    ends = profiling.header_footer(docs).filter("label = 'L'").first()
    assert (ends.header, ends.footer) == (lines[0][:100], lines[-1][:100])


def test_label_text_in_parts(spark):
    docs = spark.createDataFrame([(i * i, None if i % 5 == 0 else "L", f"text {i} é") for i in range(60)], "id bigint, label string, text string")
    parts = profiling.concat_text_by_label(docs, part_bytes=50).collect()
    for label in (None, "L"):
        joined = " ".join(r.text for r in sorted((r for r in parts if r.label == label), key=lambda r: r.part_no))
        assert joined == " ".join(f"text {i} é" for i in range(60) if (i % 5 == 0) == (label is None))
    assert max(len(r.text.encode()) for r in parts) < 70


def test_stop_words_are_left_out(spark):
    docs = spark.createDataFrame([(1, "L", "The mask and the tubing, the mask")], "id bigint, label string, text string")
    assert [(r.term, r.occurrences) for r in profiling.top_terms(docs).orderBy("place").collect()] == [("mask", 2), ("tubing", 1)]
    assert profiling.top_terms(docs, stop_words=()).orderBy("place").first().term == "the"
