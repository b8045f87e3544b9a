"""Language identification by prediction by partial matching over bytes.

For every language a context tree counts which byte follows each context of up to ``order`` bytes. The code length of a
byte is found in the longest context that the tree holds; a byte not seen there costs an escape (method C: as likely as
the number of different bytes seen) and is looked up one byte shorter, without the bytes already ruled out; below the
empty context all bytes not yet ruled out are equally likely. Statistics are frozen after fitting, so the code length
is a function of context node and byte and stands in a table. Scoring walks the tree for all positions of many
documents at once and sums exact code lengths; the language with the shortest code wins.

Fitting reads a bounded sample: per language at most ``docs_per_lang`` documents of at most ``max_doc_bytes`` bytes, for
at most ``max_languages`` languages.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimsift.llm.common import chunks, texts_of

UNDETERMINED = "und"
HAS_LETTER = regex.compile(r"\p{L}").search
#: Code length that a text's best language must beat, in bits a byte: what no model at all would need.
UNIFORM_BITS = 8.0
RESULT = "lang_pred string, score double, bits_per_byte double"


def gram_counts(texts: list[str], order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For k = 0..order: distinct grams of k context bytes and the next byte, packed big-endian, and their counts.

    Documents start after ``order`` newlines.
    """
    data = np.frombuffer(b"".join(b"\n" * order + t.encode() for t in texts) or b"\n", np.uint8).astype(np.uint64)
    real = np.ones(len(data), bool)
    at = 0
    for t in texts:
        real[at : at + order] = False
        at += order + len(t.encode())
    out = []
    packed = data.copy()
    for k in range(order + 1):
        if k:
            shifted = np.zeros_like(data)
            shifted[k:] = data[:-k]
            packed = packed | (shifted << np.uint64(8 * k))
        out.append(np.unique(packed[real] if texts else packed[:0], return_counts=True))
    return out


class ContextTree:
    """Trees of all languages over one set of nodes, with a code length for every (node, byte class, language)."""

    def __init__(self, counts: dict[str, list[tuple[np.ndarray, np.ndarray]]], order: int, min_count: int):
        self.languages = sorted(counts)
        self.order = order
        n_langs = len(self.languages)
        # the line feed stands before every text, so it has a class of its own even if no text holds it
        seen = np.unique(np.concatenate([np.array([10], np.uint64), *(counts[lang][0][0] for lang in self.languages)])).astype(int)
        self.byte_class = np.zeros(256, np.int64)  # class 0: bytes that no language has shown
        self.byte_class[seen] = np.arange(1, len(seen) + 1)
        width = len(seen) + 1
        unseen = 256 - len(seen)
        self.width = width
        # node 0 is no node, node 1 the empty context; child[node, class of the byte before] is a node or 0
        tables = [np.zeros((2, width, n_langs), np.int32)]
        children = [np.zeros((2, width), np.int32)]
        nodes_of: dict[int, int] = {0: 1}  # packed context of the current length -> node
        parents = [0, 0]  # the empty context has no parent
        total_nodes = 2
        for k in range(order + 1):
            grams = {lang: counts[lang][k] for lang in self.languages}
            if k:
                support: dict[int, int] = {}
                for lang in self.languages:
                    gram, number = grams[lang]
                    context, start = np.unique(gram >> np.uint64(8), return_index=True)
                    for c, s in zip(context.tolist(), np.add.reduceat(number, start).tolist() if len(gram) else []):
                        support[c] = max(support.get(c, 0), s)
                kept: dict[int, int] = {}
                for c in sorted(c for c, s in support.items() if s >= min_count):
                    parent = nodes_of.get(c & ((1 << 8 * (k - 1)) - 1))
                    if parent is not None:
                        kept[c] = total_nodes + len(kept)
                        parents.append(parent)
                tables.append(np.zeros((len(kept), width, n_langs), np.int32))
                children.append(np.zeros((len(kept), width), np.int32))
                child = np.concatenate(children)
                for c, node in kept.items():
                    child[parents[node], self.byte_class[c >> 8 * (k - 1)]] = node
                children = [child]
                total_nodes += len(kept)
                nodes_of = kept
            table = np.concatenate(tables)
            for at, lang in enumerate(self.languages):
                gram, number = grams[lang]
                node = np.array([nodes_of.get(c, 0) for c in (gram >> np.uint64(8)).tolist()], np.int64)
                inside = node > 0
                table[node[inside], self.byte_class[(gram & np.uint64(255)).astype(int)][inside], at] = number[inside]
            tables = [table]
        self.child = children[0]
        self.bits = self._code_lengths(tables[0], np.array(parents), unseen)

    @staticmethod
    def _code_lengths(table: np.ndarray, parents: np.ndarray, unseen: int) -> np.ndarray:
        """bits[node, class, language], by escapes with exclusion; parents come before their children."""
        nodes, width, n_langs = table.shape
        bits = np.zeros((nodes, width, n_langs), np.float32)
        ways = np.ones(width)
        ways[0] = unseen  # bytes of class 0 share its probability equally
        for lang in range(n_langs):
            out = bits[:, :, lang]
            left = np.ones((nodes, width), bool)  # classes not yet ruled out
            left[0] = False
            escape, at = np.zeros(nodes), np.arange(nodes)
            while (at > 0).any():
                number = table[at, :, lang]
                found = left & (number > 0)
                different = found.sum(axis=1)
                total = np.where(found, number, 0).sum(axis=1)
                row, byte = np.nonzero(found)
                out[row, byte] = escape[row] + np.log2((total + different)[row] / number[row, byte])
                met = different > 0
                escape[met] += np.log2((total + different)[met] / different[met])
                left &= ~found
                at = parents[at]
            rest = left @ ways  # bytes that not even the empty context has shown
            row, byte = np.nonzero(left)
            out[row, byte] = escape[row] + np.log2(rest[row])
        return bits

    def score(self, texts: list[str]) -> np.ndarray:
        """Code length in bits of each text under each language."""
        sums = np.zeros((len(texts), len(self.languages)))
        raw = [t.encode() for t in texts]
        flat_child, flat_bits = self.child.ravel(), self.bits.reshape(-1, len(self.languages))
        for start, end in chunks([len(r) + self.order for r in raw], 1 << 18):
            lengths = np.array([len(r) for r in raw[start:end]])
            classes = self.byte_class[np.frombuffer(b"".join(b"\n" * self.order + r for r in raw[start:end]), np.uint8)]
            node = np.ones(len(classes), np.int64)
            deepest = node.copy()
            for back in range(1, self.order + 1):
                node[back:] = flat_child[node[back:] * self.width + classes[:-back]]
                node[:back] = 0
                deepest = np.where(node > 0, node, deepest)
            cost = np.cumsum(np.take(flat_bits, deepest * self.width + classes, axis=0), axis=0, dtype=np.float64)
            last = np.cumsum(lengths + self.order) - 1
            full = lengths > 0
            sums[start:end][full] = cost[last[full]] - cost[(last - lengths)[full]]
        return sums

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, its share of the probability (0 to 1), and bits a byte under it; ties go to the first by name."""
        names = [UNDETERMINED] * len(texts)
        score, per_byte = np.zeros(len(texts)), np.zeros(len(texts))
        rows = [k for k, t in enumerate(texts) if self.languages and HAS_LETTER(t)]
        if rows:
            bits = self.score([texts[k] for k in rows])
            best = bits.argmin(axis=1)
            low = bits[np.arange(len(rows)), best]
            score[rows] = 1 / np.exp2(np.maximum(low[:, None] - bits, -1000)).sum(axis=1)
            per_byte[rows] = low / [len(texts[k].encode()) for k in rows]
            for k, b in zip(rows, best.tolist()):
                names[k] = self.languages[b]
        return names, score, per_byte


def fit(
    docs: DataFrame, id_col: str, text_col: str, lang_col: str, order: int = 4, docs_per_lang: int = 400, max_doc_bytes: int = 20_000, min_count: int = 16,
    max_languages: int = 1000,
) -> ContextTree:
    """Frozen statistics from rows with a language and a text that has a letter.

    The sample of a language is its different (id, text) with the smallest hash: first all those under a threshold
    that leaves about twice as many as wanted, then exactly ``docs_per_lang`` of them, limited in the map tasks too, so
    rows of one id, or without one, are bounded as well. At most ``max_languages`` languages
    are learned, those with the most documents, so the thresholds and the sample stay small.
    """
    labelled = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"))
    labelled = labelled.filter("lang IS NOT NULL AND text IS NOT NULL").filter((F.octet_length("text") <= max_doc_bytes) & F.col("text").rlike(r"\p{L}"))
    row_hash = F.xxhash64("id", "text")
    sizes = (
        labelled.groupBy("lang")
        .agg(F.count("*").alias("count"), F.approx_count_distinct(row_hash, 0.02).alias("different"))
        .orderBy(F.desc("count"), "lang")
        .limit(max_languages)
    )
    order_key = row_hash.bitwiseAND(F.lit((1 << 52) - 1)).cast("double") / float(1 << 52)
    near = labelled.withColumn("place", order_key).join(F.broadcast(sizes), "lang").filter(F.col("place") * F.col("different") <= 2 * docs_per_lang)
    first = F.row_number().over(Window.partitionBy("lang").orderBy("place", "text"))
    drawn = near.select("lang", "place", "text").distinct().withColumn("number", first).filter(F.col("number") <= docs_per_lang)

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["place", "text"])
        found = gram_counts(rows["text"].tolist(), order)
        return pd.DataFrame({"lang": [rows["lang"].iloc[0]], "counts": [pickle.dumps(found)]})

    rows = drawn.groupBy("lang").applyInPandas(count, "lang string, counts binary").collect()
    return ContextTree({r["lang"]: pickle.loads(r["counts"]) for r in rows}, order, min_count)


TREES: dict[str, ContextTree] = {}


def predictor(docs: DataFrame, tree: ContextTree):
    """A column function: text -> struct(lang_pred, score, bits_per_byte). The model is broadcast; its size is bounded
    by the sample."""
    stored = pickle.dumps(tree)
    name = hashlib.sha256(stored).hexdigest()
    shipped = docs.sparkSession.sparkContext.broadcast(stored)

    @F.arrow_udf(RESULT)
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if name not in TREES:
            TREES.clear()
            TREES[name] = pickle.loads(shipped.value)
        for batch in batches:
            found = [TREES[name].predict(texts_of(batch.slice(a, b - a))) for a, b in chunks(pa.compute.binary_length(batch).fill_null(0).to_pylist())]
            yield pa.StructArray.from_arrays(
                [
                    pa.array([x for names, _, _ in found for x in names], pa.string()),
                    pa.array(np.concatenate([s for _, s, _ in found] or [np.empty(0)])),
                    pa.array(np.concatenate([p for _, _, p in found] or [np.empty(0)])),
                ],
                ["lang_pred", "score", "bits_per_byte"],
            )

    return predict


def identify(docs: DataFrame, text: Column, tree: ContextTree) -> Column:
    """struct(lang_pred, score, bits_per_byte) of a text column.

    ``und`` with score 0 and 0 bits a byte for null text, text without a letter, and any text if nothing was learned
    (an empty table). Rows are independent; repeated rows give equal results.
    """
    return predictor(docs, tree)(text)
