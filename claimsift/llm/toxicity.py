"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word's input is its own vector (words met in training) beside the mean of the vectors of its character n-grams, so an
unknown form of a known stem still has one. Windows of ``WINDOW`` words overlap by half; a gated recurrent unit reads
each window forwards and another backwards, attention weights the states, and a logistic unit scores their sum. The
score of a document is that of its worst window, over all its windows.

Training (numpy, Adam) is on a bounded sample of labelled documents. Labels are given to documents, not to windows:
a toxic document teaches by its worst window, a clean one by its worst windows and one at random, as the network of the
previous round ranks them. First vectors start from how unevenly a word or n-gram falls on the two classes.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimsift.llm.common import cut, map_chunks, texts_of

WINDOW, STRIDE = 32, 16
WORD_SIZE = CHAR_SIZE = 8
HIDDEN, ATTENTION = 8, 8
#: Characters of an n-gram; a word's ends count as characters.
GRAM = 4
MIN_WORD_DOCS, MIN_GRAM_DOCS = 3, 5
MAX_WORDS, MAX_GRAMS = 40_000, 40_000
#: Words whose inputs a task remembers, and windows scored at once.
REMEMBERED, WINDOWS = 200_000, 1024
TOXIC_FROM = 0.7
WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    """Words of a text; a word said again at once is read once, so that repetition alone does not add up."""
    words = WORD.findall(text.lower())
    return [w for w, before in zip(words, [None, *words]) if w != before]


def grams_of(word: str) -> list[str]:
    marked = f"^{word}$"
    return [marked[i : i + GRAM] for i in range(len(marked) - GRAM + 1)]


def windows_of(ids: np.ndarray) -> np.ndarray:
    """All windows of a document, one a row, filled up with -1. Every word is in one at least."""
    n = max(1, -(-(len(ids) - WINDOW) // STRIDE) + 1)
    out = np.full((n - 1) * STRIDE + WINDOW, -1, np.int64)
    out[: len(ids)] = ids
    return np.lib.stride_tricks.sliding_window_view(out, WINDOW)[::STRIDE]


def unevenness(a: float, b: float, total_a: float, total_b: float) -> float:
    """Signed root of the likelihood ratio statistic of counts a and b."""
    share = (a + b) / (total_a + total_b)
    g = sum(x * np.log(x / (share * n)) for x, n in ((a, total_a), (b, total_b)) if x)
    return float(np.sqrt(max(0.0, 2 * g))) * (1 if a * total_b > b * total_a else -1)


def summed(index: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows that have each index from 0 to n."""
    out = np.zeros((n, rows.shape[1]), rows.dtype)
    if len(index):
        order = np.argsort(index, kind="stable")
        index = index[order]
        starts = np.nonzero(np.diff(index, prepend=-1))[0]
        out[index[starts]] = np.add.reduceat(rows[order], starts, axis=0)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(np.clip(-x, -60, 60)))


class Network:
    """Vocabulary and weights. ``inputs`` turns words into rows, ``forward`` scores windows of row numbers."""

    def __init__(self, words: dict[str, float], grams: dict[str, float], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.words = {w: k for k, w in enumerate(words, 1)}  # 0: no vector
        self.grams = {g: k for k, g in enumerate(grams)}
        size = WORD_SIZE + CHAR_SIZE

        def started(values, rows: int) -> np.ndarray:
            table = rng.normal(0, 0.05, (rows, 8)).astype(np.float32)
            table[rows - len(values) :, 0] = np.clip(np.array(list(values), np.float32) / 10, -1, 1)
            return table

        def normal(*shape: int) -> np.ndarray:
            return rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)

        self.p = {
            "word": started(words.values(), len(words) + 1),
            "gram": started(grams.values(), len(grams)) if grams else np.zeros((1, 8), np.float32),
            "in": normal(size, 6 * HIDDEN),  # update, reset, new; forwards, then backwards
            "in0": np.zeros(6 * HIDDEN, np.float32),
            "rec_f": normal(HIDDEN, 3 * HIDDEN),
            "rec_b": normal(HIDDEN, 3 * HIDDEN),
            "att": normal(2 * HIDDEN, ATTENTION),
            "att0": np.zeros(ATTENTION, np.float32),
            "att_v": normal(ATTENTION),
            "out": normal(2 * HIDDEN),
            "out0": np.full(1, -1.0, np.float32),
        }
        self.p["word"][0] = 0

    def lookups(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word number, n-gram numbers of all words, and the word each belongs to."""
        get = self.grams.get
        lists = [[k for g in grams_of(w) if (k := get(g)) is not None] for w in words]
        owner = np.repeat(np.arange(len(words)), [len(x) for x in lists])
        return np.array([self.words.get(w, 0) for w in words], np.int64), np.array([k for x in lists for k in x], np.int64), owner

    def inputs(self, found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        numbers, grams, owner = found
        chars = summed(owner, self.p["gram"][grams], len(numbers))
        chars /= np.maximum(1, np.bincount(owner, minlength=len(numbers)))[:, None]
        return np.concatenate([self.p["word"][numbers], chars], axis=1)

    def projected(self, inputs: np.ndarray) -> np.ndarray:
        return inputs @ self.p["in"] + self.p["in0"]

    def _read(self, gates: np.ndarray, mask: np.ndarray, recurrent: np.ndarray, backwards: bool, keep: list | None) -> np.ndarray:
        """States [time, window, HIDDEN] of one direction; gates hold the projected inputs."""
        steps, n, _ = gates.shape
        states = np.empty((steps, n, HIDDEN), np.float32)
        h = np.zeros((n, HIDDEN), np.float32)
        for t in reversed(range(steps)) if backwards else range(steps):
            hu = h @ recurrent
            g = _sigmoid(gates[t, :, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
            update, reset = g[:, :HIDDEN], g[:, HIDDEN:]
            new = np.tanh(gates[t, :, 2 * HIDDEN :] + reset * hu[:, 2 * HIDDEN :])
            if keep is not None:
                keep.append((t, h, hu, update, reset, new))
            h = h + mask[t] * ((1 - update) * (new - h))
            states[t] = h
        return states

    def forward(self, projected: np.ndarray, windows: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows; ``projected`` has a last row for places without a word."""
        p = self.p
        mask = (windows.T >= 0)[:, :, None].astype(np.float32)
        gates = projected[windows.T]
        tapes: tuple[list, list] | tuple[None, None] = ([], []) if keep is not None else (None, None)
        forwards = self._read(gates[:, :, : 3 * HIDDEN], mask, p["rec_f"], False, tapes[0])
        backwards = self._read(gates[:, :, 3 * HIDDEN :], mask, p["rec_b"], True, tapes[1])
        states = np.concatenate([forwards, backwards], axis=2)
        hidden = np.tanh(states @ p["att"] + p["att0"])
        energy = np.where(mask[:, :, 0] > 0, hidden @ p["att_v"], np.float32(-1e9))
        weight = np.exp(energy - energy.max(axis=0)) * mask[:, :, 0]
        weight /= np.maximum(weight.sum(axis=0), np.float32(1e-9))
        pooled = np.einsum("tn,tnk->nk", weight, states)
        if keep is not None:
            keep.update(mask=mask, tapes=tapes, states=states, hidden=hidden, weight=weight, pooled=pooled)
        return pooled @ p["out"] + p["out0"][0]

    def _unread(self, d_states: np.ndarray, mask: np.ndarray, recurrent: np.ndarray, tape: list) -> tuple[np.ndarray, np.ndarray]:
        d_gates = np.zeros((*d_states.shape[:2], 3 * HIDDEN), np.float32)
        d_recurrent = np.zeros_like(recurrent)
        d_h = np.zeros_like(d_states[0])
        for t, h, hu, update, reset, new in reversed(tape):
            d_h = d_h + d_states[t]
            d_step = mask[t] * d_h
            d_new = d_step * (1 - update) * (1 - new * new)
            d_update = -d_step * (new - h) * update * (1 - update)
            d_reset = d_new * hu[:, 2 * HIDDEN :] * reset * (1 - reset)
            d_gates[t] = np.concatenate([d_update, d_reset, d_new], axis=1)
            d_hu = np.concatenate([d_update, d_reset, d_new * reset], axis=1)
            d_recurrent += h.T @ d_hu
            d_h = d_h - d_step * (1 - update) + d_hu @ recurrent.T
        return d_gates, d_recurrent

    def gradients(self, found: tuple, windows: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, dict]:
        """Weighted logistic loss and the gradient of every weight."""
        p, kept = self.p, {}
        inputs = self.inputs(found)
        projected = np.concatenate([self.projected(inputs), np.zeros((1, 6 * HIDDEN), np.float32)])
        logits = self.forward(projected, windows, kept)
        chance = _sigmoid(logits)
        loss = float(-(weights * np.log(np.where(labels == 1, chance, 1 - chance) + 1e-9)).sum() / weights.sum())
        d_logit = (weights * (chance - labels) / weights.sum()).astype(np.float32)
        states, hidden, weight, mask = kept["states"], kept["hidden"], kept["weight"], kept["mask"]
        grad = {"out": kept["pooled"].T @ d_logit, "out0": d_logit.sum(keepdims=True)}
        d_pooled = d_logit[:, None] * p["out"]
        d_states = weight[:, :, None] * d_pooled
        d_weight = np.einsum("nk,tnk->tn", d_pooled, states)
        d_energy = weight * (d_weight - (weight * d_weight).sum(axis=0))
        grad["att_v"] = np.einsum("tn,tna->a", d_energy, hidden)
        d_hidden = d_energy[:, :, None] * p["att_v"] * (1 - hidden * hidden)
        grad["att"], grad["att0"] = np.einsum("tnk,tna->ka", states, d_hidden), d_hidden.sum(axis=(0, 1))
        d_states = d_states + d_hidden @ p["att"].T
        d_forwards, grad["rec_f"] = self._unread(d_states[:, :, :HIDDEN], mask, p["rec_f"], kept["tapes"][0])
        d_backwards, grad["rec_b"] = self._unread(d_states[:, :, HIDDEN:], mask, p["rec_b"], kept["tapes"][1])
        d_gates = np.concatenate([d_forwards, d_backwards], axis=2).reshape(-1, 6 * HIDDEN)
        place = windows.T.ravel()
        d_projected = summed(place[place >= 0], d_gates[place >= 0], len(inputs))
        grad["in"], grad["in0"] = inputs.T @ d_projected, d_projected.sum(axis=0)
        d_inputs = d_projected @ p["in"].T
        numbers, grams, owner = found
        grad["word"] = summed(numbers, d_inputs[:, :WORD_SIZE], len(p["word"]))
        grad["word"][0] = 0
        share = d_inputs[:, WORD_SIZE:] / np.maximum(1, np.bincount(owner, minlength=len(numbers)))[:, None]
        grad["gram"] = summed(grams, share[owner], len(p["gram"]))
        return loss, grad


def train(texts: list[str], labels: list[int], rounds: int = 2, epochs: int = 3, batch: int = 256, rate: float = 0.01) -> Network:
    rng = np.random.default_rng(11)
    docs = [words_of(t) for t in texts]
    labels = np.array(labels)
    counts = (Counter(), Counter())
    for words, y in zip(docs, labels.tolist()):
        counts[y].update(set(words))
    totals = max(1, int((labels == 1).sum())), max(1, int((labels == 0).sum()))
    uneven = {w: unevenness(counts[1][w], counts[0][w], *totals) for w in counts[0].keys() | counts[1].keys()}
    frequent = [w for w in uneven if counts[0][w] + counts[1][w] >= MIN_WORD_DOCS]
    words = {w: uneven[w] for w in sorted(sorted(frequent), key=lambda w: -abs(uneven[w]))[:MAX_WORDS]}
    of_grams: dict[str, list[int]] = {}
    for w in sorted(uneven):
        for g in set(grams_of(w)):
            pair = of_grams.setdefault(g, [0, 0])
            pair[0] += counts[1][w]
            pair[1] += counts[0][w]
    all_a, all_b = max(1, counts[1].total()), max(1, counts[0].total())
    gram_values = {g: unevenness(a, b, all_a, all_b) for g, (a, b) in of_grams.items() if a + b >= MIN_GRAM_DOCS}
    grams = {g: gram_values[g] for g in sorted(sorted(gram_values), key=lambda g: -abs(gram_values[g]))[:MAX_GRAMS]}
    network = Network(words, grams)

    vocabulary = sorted(uneven)
    number = {w: k for k, w in enumerate(vocabulary)}
    found = network.lookups(vocabulary)
    gram_ends = np.searchsorted(found[2], np.arange(len(vocabulary) + 1))
    ids = [np.array([number[w] for w in words], np.int64) for words in docs]
    windows = [windows_of(i) for i in ids]
    flat = np.concatenate(windows) if windows else np.empty((0, WINDOW), np.int64)
    doc_of = np.repeat(np.arange(len(docs)), [len(w) for w in windows])
    starts = np.searchsorted(doc_of, np.arange(len(docs) + 1))
    first_value = np.append(np.maximum(network.inputs(found)[:, [0, WORD_SIZE]].max(axis=1), 0), 0)
    value = first_value[flat].sum(axis=1)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in network.p.items()}
    step = 0
    for _ in range(rounds):
        chosen = []
        for k in range(len(docs)):
            own = value[starts[k] : starts[k + 1]]
            ranked = starts[k] + np.argsort(-own, kind="stable")
            chosen += ranked[:1].tolist() if labels[k] else [*ranked[:3].tolist(), int(rng.integers(starts[k], starts[k + 1]))]
        chosen = np.array(sorted(set(chosen)), np.int64)
        y = labels[doc_of[chosen]]
        weights = np.where(y == 1, max(1.0, (y == 0).sum() / max(1, (y == 1).sum()) / 2), 1.0).astype(np.float32)
        for _ in range(epochs):
            order = rng.permutation(len(chosen))
            for at in range(0, len(order), batch):
                some = order[at : at + batch]
                used, place = np.unique(flat[chosen[some]], return_inverse=True)
                place = place.reshape(len(some), WINDOW)
                if used[0] == -1:
                    used, place = used[1:], place - 1
                lengths = gram_ends[used + 1] - gram_ends[used]
                index = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(gram_ends[used], lengths)
                part = found[0][used], found[1][index], np.repeat(np.arange(len(used)), lengths)
                _, grad = network.gradients(part, place, y[some], weights[some])
                step += 1
                for name, g in grad.items():
                    rows = np.unique(part[name == "gram"]) if name in ("word", "gram") else slice(None)  # others do not move
                    mean, square = moments[name]
                    mean[rows] += 0.1 * (g[rows] - mean[rows])
                    square[rows] += 0.001 * (g[rows] * g[rows] - square[rows])
                    network.p[name][rows] -= rate * (mean[rows] / (1 - 0.9**step)) / (np.sqrt(square[rows] / (1 - 0.999**step)) + 1e-8)
        value = score_windows(network, network.projected(network.inputs(found)), flat)
    return network


def score_windows(network: Network, projected: np.ndarray, windows: np.ndarray) -> np.ndarray:
    projected = np.concatenate([projected, np.zeros((1, 6 * HIDDEN), np.float32)])
    parts = [network.forward(projected, windows[at : at + WINDOWS]) for at in range(0, len(windows), WINDOWS)]
    return np.concatenate(parts) if parts else np.empty(0, np.float32)


class Scorer:
    """Scores texts; remembers the projected inputs of words."""

    def __init__(self, network: Network):
        self.network = network
        self.number: dict[str, int] = {}
        self.projected = np.empty((0, 6 * HIDDEN), np.float32)

    def score(self, texts: list[str]) -> np.ndarray:
        docs = [words_of(t) for t in texts]
        if len(self.number) > REMEMBERED:
            self.number, self.projected = {}, self.projected[:0]
        fresh = sorted(set().union(*docs) - self.number.keys())
        self.number.update((w, k) for k, w in enumerate(fresh, len(self.number)))
        rows = self.network.projected(self.network.inputs(self.network.lookups(fresh)))
        self.projected = np.concatenate([self.projected, rows])
        number = self.number.__getitem__
        windows = [windows_of(np.fromiter(map(number, words), np.int64, len(words))) for words in docs]
        if not windows:
            return np.empty(0)
        starts = np.cumsum([0, *(len(w) for w in windows[:-1])])
        logits = score_windows(self.network, self.projected, np.concatenate(windows))
        return _sigmoid(np.maximum.reduceat(logits, starts).astype(np.float64))


def fit(
    docs: DataFrame, id_col: str, text_col: str, labels: DataFrame, label_col: str, max_toxic: int = 1200, max_clean: int = 3600, max_chars: int = 20_000
) -> Network:
    """Train on at most ``max_toxic`` and ``max_clean`` different labelled documents.

    They are drawn among all with a text, by the smallest hash of id and text: first those of at most ``max_chars``
    characters, then longer ones, whole, as long as all together stay under ``max_chars`` times the number wanted. Their
    number is bounded whatever an id has of rows, so they are broadcast and texts are not shuffled. Null labels, ids
    and texts teach nothing; of several labels of an id the largest counts. Without any toxic or any clean document the
    network stays as it starts.
    """
    marked = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label")).filter("id IS NOT NULL AND label IS NOT NULL")
    marked = marked.groupBy("id").agg(F.max(F.col("label") == 1).cast("int").alias("label"))
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")
    texts = texts.withColumn("place", F.xxhash64("id", "text"))
    size = F.char_length("text").cast("bigint")
    usable = cut(texts.select("id", "place", size.alias("size")).distinct().join(marked, "id"))

    def draw(label: int, most: int) -> DataFrame:
        order = [F.col("size") > max_chars, F.xxhash64("id"), "place"]
        drawn = usable.filter(F.col("label") == label).orderBy(*order).limit(most)
        total = F.sum("size").over(Window.partitionBy("label").orderBy(*order))  # at most `most` rows
        return drawn.withColumn("total", total).filter(F.col("total") <= most * max_chars).select("id", "place", "label")

    sample = cut(draw(1, max_toxic).unionByName(draw(0, max_clean)))  # at most max_toxic + max_clean rows

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["id", "text"])
        return pd.DataFrame({"network": [pickle.dumps(train(rows["text"].tolist(), rows["label"].tolist()))]})

    rows = texts.join(F.broadcast(sample), ["id", "place"]).groupBy("id", "place").agg(F.first("text").alias("text"), F.first("label").alias("label"))
    rows = rows.select(F.lit(1).alias("all"), "id", "text", "label")
    found = rows.groupBy("all").applyInPandas(learn, "network binary").collect()
    return pickle.loads(found[0]["network"]) if found else Network({}, {})


SCORERS: dict[str, Scorer] = {}


def score_documents(docs: DataFrame, id_col: str, text_col: str, network: Network, *more: Column) -> DataFrame:
    """(id, more..., score) with scores from 0 to 1, of whole texts.

    Null and empty texts and texts without a word have the score of an empty window, the same for all. Repeated rows
    have equal scores and stay; an empty table stays empty.
    """
    stored = pickle.dumps(network)
    name = hashlib.sha256(stored).hexdigest()
    shipped = docs.sparkSession.sparkContext.broadcast(stored)  # its size is bounded by MAX_WORDS and MAX_GRAMS
    rows = docs.select(*more, F.col(f"`{id_col}`"), F.col(f"`{text_col}`").alias("text"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        if name not in SCORERS:
            SCORERS.clear()
            SCORERS[name] = Scorer(pickle.loads(shipped.value))
        scores = SCORERS[name].score(texts_of(batch.column(batch.num_columns - 1)))
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores)], names=[*batch.schema.names[:-1], "score"])

    schema = ", ".join(f"`{c}` {kind}" for c, kind in rows.dtypes[:-1])
    return map_chunks(rows, work, f"{schema}, score double", "text")
