import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from claimsift.llm import simhash
from claimsift.llm.components import components
from claimsift.llm.queries import QUERIES
from claimsift.llm.simhash import close_pairs, fingerprints, forest, links, simhash_groups


def brute_fingerprint(text, size=3):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(ids, fps, radius=2):
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    distinct = sorted(set(fps))
    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    least = {}
    for i, f in zip(ids, fps):
        least[find(f)] = min(least.get(find(f), i), i)
    return [least[find(f)] for f in fps]


@pytest.mark.parametrize("text", ["", "  \t\n", "A b", "one TWO three four one two three four", "Éa\x85b c d\x0b\x0ce f", "x\x1cy z w", "w " * 300])
def test_fingerprints_equal_brute_force(text):
    assert [int(f) for f in fingerprints([text, "other words here now"], 3)] == [brute_fingerprint(text), brute_fingerprint("other words here now")]


def test_counting_in_parts_changes_nothing(monkeypatch):
    text = " ".join(f"w{k % 37}" for k in range(500))
    monkeypatch.setattr(simhash, "COUNTED_HASHES", 7)
    assert int(fingerprints([text], 3)[0]) == brute_fingerprint(text)


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5])
def test_close_pairs_equal_brute_force(radius):
    rng = np.random.default_rng(radius)
    fps = []
    for base in rng.integers(0, 2**63, 12, dtype=np.uint64):
        for _ in range(25):
            fps.append(int(base) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)))
    fps = np.array(fps, np.uint64)
    keys = np.sort(rng.integers(0, 4, len(fps)))
    first, second = close_pairs(keys, fps, radius)
    want = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if keys[i] == keys[j] and int(fps[i] ^ fps[j]).bit_count() <= radius}
    assert len(first) == len(want) and set(zip(first.tolist(), second.tolist())) == want


def test_forest_reaches_the_smallest():
    fps = np.array([50, 40, 30, 20, 10, 7, 8], np.uint64)
    node, root = forest(fps, np.array([0, 1, 2, 5]), np.array([1, 2, 4, 6]))
    assert dict(zip(node.tolist(), root.tolist())) == {50: 10, 40: 10, 30: 10, 8: 7}


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 90), (90, 100), (5, 5), (None, 3), (3, None), (200, 100), (-7, 300)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(1, 41)} | {100: 90, 200: 90, 300: -7}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_query_equals_brute_force(spark, small):
    rows = {r["doc_id"]: r for r in QUERIES["op4_simhash_bit_sliced"](spark, small).collect()}
    docs = spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect()
    fps = [brute_fingerprint(d["text"]) for d in docs]
    assert [rows[d["doc_id"]]["fingerprint"] for d in docs] == [f"{f:016x}" for f in fps]
    assert [rows[d["doc_id"]]["component_id"] for d in docs] == brute_groups([d["doc_id"] for d in docs], fps)
    assert len({r["component_id"] for r in rows.values()}) < len(rows)


def test_long_lists_are_cut_without_losing_links(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LIST_ROWS", 16)
    rng = np.random.default_rng(3)
    fps = sorted({sum(1 << int(b) for b in rng.choice(20, rng.integers(0, 4), replace=False)) for _ in range(300)})
    found = components(links(spark.createDataFrame([(f,) for f in fps], "fp long"), 2))
    got = {r["node"]: r["root"] for r in found.collect()}
    groups = brute_groups(fps, fps)
    assert {f: got.get(f, f) for f in fps} == dict(zip(fps, groups))


def test_edges(documents):
    docs = documents([(5, None), (4, ""), (3, "a b c d"), (3, "a b c d"), (None, "a b c d"), (None, "quite another text here"), (9, "  ")])
    rows = sorted(((r["doc_id"] or -1, r["fp"], r["component_id"]) for r in simhash_groups(docs, "doc_id", "text").collect()))
    assert [(i, c) for i, f, c in rows if f == 0] == [(4, 4), (5, 4), (9, 4)]
    assert sorted((i, c or -1) for i, f, c in rows if f != 0) == [(-1, -1), (-1, 3), (3, 3), (3, 3)]
    assert simhash_groups(docs.filter(F.lit(False)), "doc_id", "text").count() == 0
