import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimsift.llm import toxicity
from claimsift.llm.queries import QUERIES
from claimsift.llm.toxicity import Network, Scorer, fit, score_documents, train, windows_of


def test_gradients_equal_differences():
    network = Network({"aa": 3.0, "bb": -2.0, "cc": 1.0}, {"^aa$": 2.0, "^bbb": 1.0, "bbb$": 0.5})
    network.p = {k: v.astype(np.float64) for k, v in network.p.items()}
    found = network.lookups(["aa", "bbb", "cc", "zz"])
    windows = np.full((3, toxicity.WINDOW), -1)
    windows[0, :5], windows[1, :3], windows[2, :1] = [0, 1, 2, 3, 1], [2, 2, 0], [1]
    labels, weights = np.array([1, 0, 1]), np.array([1.0, 2.0, 1.0])
    _, grad = network.gradients(found, windows, labels, weights)
    rng = np.random.default_rng(0)
    for name, value in network.p.items():
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in value.shape)
            if name == "word" and at[0] == 0:
                continue
            kept, losses = value[at], []
            for step in (1e-4, -1e-4):
                value[at] = kept + step
                losses.append(network.gradients(found, windows, labels, weights)[0])
            value[at] = kept
            assert abs((losses[0] - losses[1]) / 2e-4 - grad[name][at]) < 1e-4, name


@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, 48, 49, 100, 1000])
def test_windows_overlap_and_hold_every_word(n):
    windows = windows_of(np.arange(n))
    assert set(windows.ravel().tolist()) - {-1} == set(range(n))
    for before, after in zip(windows, windows[1:]):
        assert (before[toxicity.STRIDE :] == after[: -toxicity.STRIDE]).all()


def corpus(n, seed):
    rng = random.Random(seed)
    texts, labels = [], []
    for k in range(n):
        words = ["".join(rng.choice(["ba", "do", "ki", "lu", "me", "ro"]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 150))]
        bad = k % 4 == 0
        for _ in range(rng.randint(2, 4) if bad else 0):
            words.insert(rng.randrange(len(words)), "vexo" + rng.choice(["ba", "do", "ki", "lu", "me"]) + rng.choice(["ro", "ki", "lu"]))
        texts.append(" ".join(words))
        labels.append(int(bad))
    return texts, labels


def test_learns_stems_from_documents():
    network = train(*corpus(600, 1))
    texts, labels = corpus(300, 2)
    scores = Scorer(network).score(texts)
    predicted = scores >= toxicity.TOXIC_FROM
    assert np.mean(predicted == (np.array(labels) == 1)) > 0.97


def test_batches_and_forgetting_change_nothing(monkeypatch):
    network = train(*corpus(200, 1), rounds=1, epochs=1)
    texts, _ = corpus(40, 3)
    together = Scorer(network).score(texts)
    monkeypatch.setattr(toxicity, "REMEMBERED", 10)
    one_by_one = Scorer(network)
    assert np.allclose(together, [one_by_one.score([t])[0] for t in texts], atol=1e-5)
    monkeypatch.setattr(toxicity, "WINDOWS", 3)
    assert np.allclose(together, Scorer(network).score(texts), atol=1e-5)


def test_query(spark, small):
    rows = QUERIES["op5_toxicity_gru"](spark, small).collect()
    assert len(rows) == spark.read.parquet(f"{small}/documents.parquet").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)


def learned(monkeypatch):
    """What `fit` trains on, without training."""
    monkeypatch.setattr(toxicity, "train", lambda texts, labels: sorted(zip(texts, labels)))
    return fit


def test_rows_of_one_id_are_bounded(spark, monkeypatch):
    same = spark.range(20_000).select(F.lit(7).cast("long").alias("doc_id"), F.when(F.col("id") < 10_000, F.lit("equal text")).otherwise(F.concat(F.lit("text "), F.col("id"))).alias("text"))
    other = spark.createDataFrame([(1, "clean one"), (2, "clean two"), (2, "clean two")], "doc_id long, text string")
    labels = spark.createDataFrame([(7, 1), (1, 0), (2, 0)], "doc_id long, toxic int")
    rows = learned(monkeypatch)(same.unionByName(other), "doc_id", "text", labels, "toxic", max_toxic=50, max_clean=30)
    assert sum(y for _, y in rows) == 50 and len(set(rows)) == len(rows) == 52


def test_long_texts_are_learned_whole_if_short_ones_are_few(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "x" * 30), (2, "short"), (3, "y" * 25), (4, "z" * 1000), (5, "clean")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 1), (5, 0)], "doc_id long, toxic int")
    rows = learned(monkeypatch)(docs, "doc_id", "text", labels, "toxic", max_toxic=4, max_clean=4, max_chars=20)
    texts = {t for t, _ in rows}
    assert "short" in texts and "clean" in texts and "z" * 1000 not in texts
    assert sum(len(t) for t, y in rows if y) <= 80


def test_held_out_quality(spark):
    """On the largest test table, by the query itself: all documents, labels of the two other thirds learned."""
    sf_dir = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    rows = QUERIES["op5_toxicity_gru"](spark, sf_dir).filter("held_out").join(labels, "doc_id").collect()
    toxic = [r for r in rows if r["toxic"] == 1]
    found = [r for r in rows if r["predicted"] == 1]
    recall = sum(r["predicted"] for r in toxic) / len(toxic)
    precision = sum(r["toxic"] for r in found) / len(found)
    scores = sorted((r["score"], r["toxic"]) for r in rows)
    ranks = sum(k for k, (_, y) in enumerate(scores, 1) if y)
    area = (ranks - len(toxic) * (len(toxic) + 1) / 2) / (len(toxic) * (len(rows) - len(toxic)))
    print(f"held-out documents {len(rows)}, toxic {len(toxic)}: area {area:.3f}, precision {precision:.3f}, recall {recall:.3f}")
    assert area >= 0.93 and precision >= 0.88 and recall >= 0.85


def test_edges(spark, documents):
    docs = documents([(1, None), (2, ""), (3, "bad words"), (3, "bad words"), (None, "fine words"), (4, "fine words")])
    labels = spark.createDataFrame([(3, 1), (3, 0), (4, 0), (None, 1), (9, 1), (2, None)], "doc_id long, toxic int")
    network = fit(docs, "doc_id", "text", labels, "toxic")
    scored = score_documents(docs, "doc_id", "text", network, F.lit(True).alias("held_out"))
    assert scored.columns == ["held_out", "doc_id", "score"]
    rows = scored.orderBy("doc_id").collect()
    assert rows[1]["score"] == rows[2]["score"] and rows[3] == rows[4] and rows[0]["score"] == rows[5]["score"]
    for nothing in (fit(docs, "doc_id", "text", labels.filter(F.lit(False)), "toxic"), fit(docs.filter(F.lit(False)), "doc_id", "text", labels, "toxic")):
        assert score_documents(docs, "doc_id", "text", nothing).count() == 6
    assert score_documents(docs.filter(F.lit(False)), "doc_id", "text", network).count() == 0
