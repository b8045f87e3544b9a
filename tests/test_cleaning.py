import re

import pytest
from pyspark.sql import functions as F

from claimsift.fixed_values import CLEANING_PATTERNS, NOISE_WORDS
from claimsift.operators.cleaning import clean_documents, clean_text, label_from_file_name

EDGES = [
    "..a.,b", "e", "", "--- x", " Email: a@b\nz", "Fax: 1\n\nPhone 2\nq", "snake_e e_", "²5%",
    "a  b", "a  b", "é x", "a\u001cb\u001c\u001cc", "٣cmH20", "4.5,x", "x :y , z",
    "oor eee aye E Aye oore", "\n\n\n", "a\n \nb", "5%6L/min 7cmH20", "　 a \u0085", "a.\n", "e,e.e", "été e",
]


def by_hand(text, last=10):
    for step in range(1, last + 1):
        if step == 2:
            text = re.sub("|".join(rf"\b{w}\b" for w in NOISE_WORDS), "", text)
        elif step == 10:
            text = text.strip()
        else:
            for pattern, new in CLEANING_PATTERNS[step]:
                text = re.sub(pattern, re.sub(r"\$(\d)", r"\\\1", new), text)
    return text


@pytest.mark.parametrize("last", range(1, 11))
def test_edge_strings_match_python(spark, last):
    df = spark.createDataFrame([(t,) for t in EDGES], "t string")
    got = [r.c for r in df.select(clean_text(F.col("t"), last).alias("c")).collect()]
    assert got == [by_hand(t, last) for t in EDGES]


def test_every_document_matches_python(views):
    rows = views.claims.select("raw_text", clean_text(F.col("raw_text")).alias("c")).collect()
    assert len(rows) == 200
    assert all(r.c == by_hand(r.raw_text) for r in rows)


def test_decorated_documents_match_python(views):
    wild = F.concat(F.lit("** e   §"), F.col("raw_text"), F.lit("\x1c ¾5% ,　x\n\n"))
    rows = views.claims.select(wild.alias("t"), clean_text(wild).alias("c")).collect()
    assert all(r.c == by_hand(r.t) for r in rows)


def test_filter_on_cleaned_text_does_not_clean_twice(views):
    df = clean_documents(views.claims).filter("cleaned_text <> ''")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("cmH20") == 1


def test_label(spark):
    df = spark.createDataFrame([("Sleep a b.pdf",), ("Order.pdf",)], "f string")
    assert [r[0] for r in df.select(label_from_file_name(F.col("f"))).collect()] == ["Sleep", "Order.pdf"]
