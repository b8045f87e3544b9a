import random
import re
from itertools import permutations

import numpy as np
import pytest
from oracle_check import compare, oracle_connection
from pyspark.sql import functions as F

from claimsift.llm.filter_audit import audit_filters, order_rows, text_filters, walk_states
from claimsift.llm.queries import ORACLES, QUERIES

COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def failed(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {
        "A": len(words) < 200,
        "B": 100 * len(set(words)) < 50 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
        "D": re.search("[#$%&*|]", text) is not None,
    }


def brute(docs, labels):
    """docs: (id, part, text); the audit by running every order over every document."""
    rows = []
    for i, part, text in docs:
        fails = failed(text or "")
        fails["E"] = i is not None and any(j is not None and j < i and (t or "") == (text or "") for j, _, t in docs)
        rows.append((part or "", fails, any(i is not None and x == i and q == 1 for x, q, _ in labels), any(i is not None and x == i and t == 1 for x, _, t in labels)))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(r[1][f] for r in mine) - len(gone),
                    sum(r[1][f] and sum(r[1].values()) == 1 for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone),
                ]
        for (p, order, step), values in out.items():
            if p == part:
                values.append(shapley[order[step - 1]])
    return out


def audited(frame):
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in COUNTS] for r in frame.collect()}


def test_walk_equals_counting_each_subset():
    rng = np.random.default_rng(1)
    cells = rng.integers(0, 9, (3, 2, 32))
    states = walk_states(cells, 5)
    for subset in range(32):
        assert (states[..., subset] == cells[..., [m for m in range(32) if not m & subset]].sum(axis=-1)).all()


def test_two_filters():
    cells = np.zeros((1, 3, 4), np.int64)
    cells[0, 0] = [5, 1, 2, 4]
    rows = order_rows(walk_states(cells, 2), "AB")
    assert rows["removed"].tolist() == [[[5, 2], [6, 1]]] and rows["kept"].tolist() == [[[7, 5], [6, 5]]]
    assert rows["redundant"].tolist() == [[[0, 4], [0, 4]]] and rows["shapley"].tolist() == [[[6, 8], [8, 6]]]


def test_hostile_rows_equal_brute_force(spark):
    rng = random.Random(4)
    long = " ".join(f"w{k}" for k in range(230))
    texts = [None, "", " \t\x0b\n", "ABC", "a b # c", long, long.upper(), "x " * 250, "x " * 250 + "#", long + "|", "é\x85ü\xa0z " * 90, "q" * 200_000]
    docs = [(rng.choice([None, *range(40)]), rng.choice([None, "", "a", "b", "hot", "hot", "hot"]), rng.choice(texts)) for _ in range(220)]
    docs += docs[:6]
    labels = [(k % 25, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(40)] + [(None, 1, 1)]
    frame = spark.createDataFrame(docs, "doc_id long, source string, text string").select(
        "*", F.lit(1).alias("part"), F.lit(2).alias("mask"), F.lit(3).alias("n"), F.lit(4).alias("good"), F.lit(5).alias("digest"), F.lit(6).alias("id"), F.lit(7).alias("toxic")
    )
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("id", F.lit(0)).withColumn("part", F.lit(0))
    got = audited(audit_filters(frame, "doc_id", "source", "text", marks))
    assert got == brute(docs, labels)
    assert len(got) == 600 * 4


def test_own_filters_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "p", "x"), (2, "p", "x"), (3, "p", "y")], "doc_id long, source string, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = audit_filters(docs, "doc_id", "source", "text", labels, {"Y": F.col("text") == "y"}, "Z").collect()
    assert sorted((r["filter_order"], r["step"], r["kept"], r["removed"], r["shapley"]) for r in rows) == [
        ("YZ", 1, 2, 1, 2), ("YZ", 2, 1, 1, 2), ("ZY", 1, 2, 1, 2), ("ZY", 2, 1, 1, 2)
    ]
    assert audit_filters(docs.limit(0), "doc_id", "source", "text", labels).count() == 0


@pytest.mark.parametrize("text", ["", "a", "A b\x0bc", "a  a a\n", "é" * 3, "\x85", "x\x1cy", "#"])
def test_text_filters(spark, text):
    row = spark.createDataFrame([(text,)], "text string").select(*[c.alias(k) for k, c in text_filters(F.col("text")).items()]).first()
    assert row.asDict() == failed(text)


def test_query_equals_oracle(spark, small):
    rows, problem = compare(spark, oracle_connection(small), "op12_filter_audit", small, QUERIES, ORACLES)
    assert problem is None and rows >= 600
