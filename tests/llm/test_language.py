import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimsift.llm.language import ContextTree, fit, gram_counts, identify
from claimsift.llm.queries import QUERIES

ORDER, LEAST = 3, 2
TRAINING = {"a": ["the cat sat on the mat", "the hat of the cat"], "b": ["der hut und die katze", "katze und hund der"], "c": [""]}


@pytest.fixture(scope="module")
def tree():
    return ContextTree({lang: gram_counts(texts, ORDER) for lang, texts in TRAINING.items()}, ORDER, LEAST)


def brute_bits(text, lang):
    """Code length by plain escapes with exclusion, context by context."""
    after = {}
    support = {}
    for other, texts in TRAINING.items():
        own = {}
        for t in texts:
            data = b"\n" * ORDER + t.encode()
            for i in range(ORDER, len(data)):
                for k in range(ORDER + 1):
                    own.setdefault(data[i - k : i], Counter())[data[i]] += 1
        for context, seen in own.items():
            support[context] = max(support.get(context, 0), sum(seen.values()))
        if other == lang:
            after = own
    kept = {c for c, n in support.items() if n >= LEAST or not c}
    kept = {c for c in kept if all(c[k:] in kept for k in range(len(c) + 1))}
    data, total = b"\n" * ORDER + text.encode(), 0.0
    for i in range(ORDER, len(data)):
        k = max(k for k in range(ORDER + 1) if data[i - k : i] in kept)
        ruled_out = set()
        while True:
            seen = {b: n for b, n in after.get(data[i - k : i], {}).items() if b not in ruled_out}
            n = sum(seen.values())
            if data[i] in seen:
                total -= math.log2(seen[data[i]] / (n + len(seen)))
                break
            if seen:
                total -= math.log2(len(seen) / (n + len(seen)))
                ruled_out |= set(seen)
            if k == 0:
                total -= math.log2(1 / (256 - len(ruled_out)))
                break
            k -= 1
    return total


@pytest.mark.parametrize("text", ["the cat", "katze", "x", "the hund é日", "cat\n\ncat", "t" * 300])
def test_code_lengths_equal_brute_force(tree, text):
    want = [brute_bits(text, lang) for lang in tree.languages]
    assert np.allclose(tree.score(["other", text, ""])[1], want, rtol=1e-4, atol=1e-3)


def test_probabilities_add_up(tree):
    chance = 2.0 ** -tree.bits[1:].astype(float)
    unseen = 256 - (tree.width - 1)
    assert np.allclose(chance[:, 1:].sum(axis=1) + chance[:, 0] * unseen, 1, atol=1e-5)


def test_documents_do_not_influence_each_other(tree):
    texts = ["the cat", "", "katze und", "x" * 1000]
    together = tree.score(texts)
    assert np.allclose(together, np.concatenate([tree.score([t]) for t in texts]), atol=1e-6)


def test_query_on_held_out_documents(spark, small):
    rows = {r["doc_id"]: r for r in QUERIES["op2_language_ppm"](spark, "/root/testdata/sf0.01").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    assert len(rows) == len(docs)
    held = [(d, rows[d["doc_id"]]) for d in docs if zlib.crc32(str(d["doc_id"]).encode()) % 5 == 0]
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for i, r in rows.items())
    assert sum(d["lang"] == r["lang_pred"] for d, r in held) / len(held) > 0.95


def test_edges(spark, documents):
    docs = documents([(1, None), (2, ""), (3, "12 ... 34"), (4, "the cat sat"), (4, "the cat sat"), (None, "hello")])
    tree = fit(docs, "doc_id", "text", "lang")
    rows = docs.select("doc_id", identify(docs, F.col("text"), tree).alias("f")).select("doc_id", "f.*").orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in rows] == ["en", "und", "und", "und", "en", "en"]
    assert rows[1]["score"] == 0 and rows[4]["score"] == 1
    nothing = fit(docs.filter(F.lit(False)), "doc_id", "text", "lang")
    assert {r[0]["lang_pred"] for r in docs.select(identify(docs, F.col("text"), nothing)).collect()} == {"und"}
    assert docs.filter(F.lit(False)).select(identify(docs, F.col("text"), tree)).count() == 0


def test_null_languages_teach_nothing(spark):
    docs = spark.createDataFrame([(1, "aaa", None), (2, "bbb", "x"), (3, "ccc", "y")], "doc_id long, text string, lang string")
    assert fit(docs, "doc_id", "text", "lang").languages == ["x", "y"]


def test_the_sample_is_bounded_in_rows(spark, monkeypatch):
    rows = [(None, f"word{k} and more", "en") for k in range(3000)] + [(7, "the same", "de")] * 3000 + [(8, "another", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    plans = []
    grouped = type(docs).groupBy

    def kept(frame, *columns):
        if "place" in frame.columns:
            plans.append(frame)
        return grouped(frame, *columns)

    monkeypatch.setattr(type(docs), "groupBy", kept)
    tree = fit(docs, "doc_id", "text", "lang", docs_per_lang=20)
    drawn = [(r["lang"], r["text"]) for r in plans[-1].collect()]
    assert tree.languages == ["de", "en"]
    assert sum(lang == "en" for lang, _ in drawn) == 20 and sorted(t for lang, t in drawn if lang == "de") == ["another", "the same"]
