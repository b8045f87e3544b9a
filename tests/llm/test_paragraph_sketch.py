import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimsift.llm import paragraph_sketch
from claimsift.llm.paragraph_sketch import Sketches, digests, edited, fingerprint_versions, likeness, paragraph_pattern
from claimsift.llm.queries import QUERIES

PATTERN = paragraph_pattern(4)


def exact(a, b):
    first, second = Counter(PATTERN.findall(a)), Counter(PATTERN.findall(b))
    either = (first | second).total()
    return (first & second).total() / either if either else 1.0


def random_text(rng, size):
    return " ".join(rng.choice(["one", "two", "three\n", "four", f"w{rng.randrange(200)}"]) for _ in range(size))


def test_likeness_equals_sets():
    rng = random.Random(4)
    texts = [random_text(rng, rng.choice([0, 1, 5, 50, 500, 4000])) for _ in range(60)]
    texts += [t + " end" for t in texts[:20]] + ["", " \n "]
    owner, keys = digests(texts, PATTERN)
    first = np.array([rng.randrange(len(texts)) for _ in range(200)] + list(range(20)))
    second = np.array([rng.randrange(len(texts)) for _ in range(200)] + list(range(60, 80)))
    got = likeness(owner, keys, first, second)
    assert np.allclose(got, [exact(texts[a], texts[b]) for a, b in zip(first, second)])


def test_very_many_equal_paragraphs_are_different_elements():
    texts = ["x\n" * 70_000, "a b c d e", "x\n" * 67_000 + "y"]
    owner, keys = digests(texts, PATTERN)
    assert len(np.unique(keys[owner == 0])) == 70_000
    got = likeness(owner, keys, np.array([0, 0, 2]), np.array([1, 2, 1]))
    assert np.allclose(got, [exact(texts[a], texts[b]) for a, b in ((0, 1), (0, 2), (2, 1))])


def test_peeling_recovers_the_differing_digests():
    owner, keys = digests(["a b c d\ne f\ng", "a b c d\nx y\ng"], PATTERN)
    sketch = Sketches(1, 18)
    sketch.add(np.zeros((owner == 0).sum(), np.int64), keys[owner == 0])
    sketch.add(np.zeros((owner == 1).sum(), np.int64), keys[owner == 1], -1)
    more, less, complete = sketch.peel()
    assert (more[0], less[0], complete[0]) == (1, 1, True)


def test_a_small_sketch_fails_and_a_larger_one_succeeds():
    owner, keys = digests([" ".join(f"w{k}" for k in range(400))], PATTERN)
    for cells, enough in ((18, False), (288, True)):
        sketch = Sketches(1, cells)
        sketch.add(owner, keys)
        assert sketch.peel()[2][0] == enough


def brute(rows):
    """Contract of the query, in plain Python; rows are (doc_id, text)."""
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    out = []
    for (doc_id, text), (_, following) in zip(ordered, ordered[1:] + ordered[:1]):
        changed = edited(text, following)
        out.append((doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), round(exact(text, changed), 9), round(exact(text, following), 9)))
    return out


def rows_of(frame):
    return [(r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in frame.collect()]


def as_text(rows):
    return sorted(map(repr, rows))


def test_query_equals_brute_force(spark, small):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    frame = QUERIES["op8_paragraph_sketch"](spark, small)
    assert as_text(rows_of(frame)) == as_text(brute(docs))
    prints = {}
    for r in frame.collect():
        prints.setdefault(dict(docs)[r["doc_id"]], set()).add(r["fingerprint"])
    assert all(len(p) == 1 for p in prints.values()) and len(set.union(*prints.values())) > 0.9 * len(prints)


@pytest.mark.parametrize("n,parts", [(0, 4), (1, 4), (2, 4), (5, 1), (37, 3), (37, 50)])
def test_neighbours_across_parts(spark, documents, n, parts, monkeypatch):
    monkeypatch.setattr(paragraph_sketch, "CHUNK_CHARS", 40)
    rng = random.Random(n)
    rows = [(3 * k - 20, random_text(rng, rng.randrange(30))) for k in range(n)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        docs = documents(rows) if rows else documents([(1, "x")]).filter(F.lit(False))
        got = as_text(rows_of(fingerprint_versions(docs, "doc_id", "text")))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == as_text(brute(rows))


def test_edges(documents):
    rows = [(1, None), (2, ""), (5, "a b c d e f"), (5, "a b c d e f"), (5, "another"), (None, "x y z"), (None, "y"), (9, "é" * 50)]
    got = rows_of(fingerprint_versions(documents(rows), "doc_id", "text"))
    assert as_text(got) == as_text(brute([(i, t or "") for i, t in rows]))
