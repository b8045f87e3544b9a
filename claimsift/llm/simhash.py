"""SimHash fingerprints, and their links by bit-sliced comparison.

Fingerprints that differ in at most r bits agree in all but r of r + 3 bit blocks, so each is listed under every choice
of 3 whole blocks; equal lists meet. Within a list, bit planes stand vertically: plane j holds bit j of 64 fingerprints
per machine word. Shifting a plane by s puts each fingerprint beside the s-th next one; the exclusive or of both is added
to counters that are themselves bit planes (carry-save), so one word operation counts 64 distances. Words of which all 64
distances exceed the radius are abandoned before the next planes.

Long lists are cut into chunks, and every pair of chunks is a list of its own, so no task gathers an unbounded list.
Links leave a task as a forest (each fingerprint to the smallest one it reaches there), never as all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimsift.llm.common import cut, map_chunks, texts_of
from claimsift.llm.components import components

SEED = 42
#: Fingerprints of one list that are compared in one go; lists are cut to chunks of about half of it.
LIST_ROWS = 2048
#: Shingle hashes whose bits are counted at once.
COUNTED_HASHES = 1 << 16
#: Planes between two looks at which words can be abandoned.
PLANES_PER_LOOK = 8


def shingle_hashes(text: str, size: int) -> list[int]:
    words = text.encode().lower().split()  # on bytes: only A-Z, only ASCII white space
    if not words:
        return []
    joined = memoryview(b" ".join(words))
    h = xxhash.xxh64_intdigest
    if len(words) <= size:
        return [h(joined, SEED)]
    next_starts = list(accumulate(len(w) + 1 for w in words))
    return [h(joined[start : next_start - 1], SEED) for start, next_start in zip([0, *next_starts], next_starts[size - 1 :])]


def fingerprint(text: str, size: int) -> int:
    """Bit b is 1 if it is set in over half of the shingle hashes; 0 without words."""
    hashes = shingle_hashes(text, size)
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), COUNTED_HASHES):
        some = np.array(hashes[start : start + COUNTED_HASHES], dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(texts: list[str], size: int) -> np.ndarray:
    return np.array([fingerprint(t, size) for t in texts], dtype=np.uint64)


def fingerprint_docs(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed long. Null text counts as empty."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = fingerprints(texts_of(batch.column(1)), size).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=[id_col, "fp"])

    rows = docs.select(id_col, text_col)
    return map_chunks(rows, work, f"`{id_col}` {rows.dtypes[0][1]}, fp bigint", text_col)


def _over(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose count, held in bit-sliced counters, is over the radius."""
    over = np.zeros_like(counters[0])
    equal = ~over
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            equal &= counters[k]
        else:
            over |= equal & counters[k]
            equal &= ~counters[k]
    return over


def close_pairs(keys: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of rows with equal key and at most ``radius`` differing bits. Rows are sorted by key."""
    n = len(fps)
    if n < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    words = -(-n // 64)
    bits = np.zeros((words * 64, 64), np.uint8)
    bits[:n] = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ends = np.append(np.nonzero(np.diff(keys))[0] + 1, n)
    run = np.zeros(words * 64, np.int64)  # rows of the same key from here on
    run[:n] = ends[np.searchsorted(ends, np.arange(n), side="right")] - np.arange(n)
    run = run.reshape(words, 64)
    longest = run.max(axis=1)
    planes = np.zeros((64, 2 * words + 2), np.uint64)  # zero words behind the rows, for the shift
    planes[:, :words] = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")
    counter_bits = (radius + 1).bit_length()
    found: list[tuple[np.ndarray, np.ndarray]] = []
    word = np.nonzero(longest > 1)[0]
    for shift in range(1, int(longest.max())):
        word = word[longest[word] > shift]
        skip, bit = divmod(shift, 64)
        here = word
        over = ~np.packbits(run[here] > shift, axis=1, bitorder="little").view("<u8").ravel()
        counters = [np.zeros(len(here), np.uint64) for _ in range(counter_bits)]
        for look in range(0, 64, PLANES_PER_LOOK):
            for plane in planes[look : look + PLANES_PER_LOOK]:
                beside = plane[here + skip]
                if bit:
                    beside = (beside >> np.uint64(bit)) | (plane[here + skip + 1] << np.uint64(64 - bit))
                carry = plane[here] ^ beside
                for k, counter in enumerate(counters):
                    counters[k], carry = counter ^ carry, counter & carry
                over |= carry
            over |= _over(counters, radius)
            alive = over != np.uint64(0xFFFFFFFFFFFFFFFF)
            if not alive.all():
                here, over, counters = here[alive], over[alive], [c[alive] for c in counters]
            if not len(here):
                break
        if len(here):
            lane = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            at, place = np.nonzero(lane)
            first = here[at] * 64 + place
            found.append((first, first + shift))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def forest(fps: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each linked fingerprint with the smallest one that it reaches."""
    nodes, place = np.unique(np.concatenate([fps[first], fps[second]]), return_inverse=True)
    a, b = np.split(place, 2)
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            moved = root != np.arange(len(nodes))
            return nodes[moved], nodes[root[moved]]
        root = new


def _block_masks(radius: int) -> list[int]:
    """Bits of every choice of 3 blocks out of radius + 3, as signed longs."""
    blocks = radius + 3
    edges = [64 * k // blocks for k in range(blocks + 1)]
    whole = [(1 << hi) - (1 << lo) for lo, hi in zip(edges, edges[1:])]
    masks = [sum(choice) for choice in combinations(whole, 3)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(distinct: DataFrame, radius: int) -> DataFrame:
    """(u, v): for distinct fingerprints ``fp``, edges that connect all that differ in at most ``radius`` bits."""
    listed = distinct.select(
        "fp",
        F.explode(F.array(*[F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(mask))) for k, mask in enumerate(_block_masks(radius))])).alias("list"),
    )
    half = LIST_ROWS // 2
    long_lists = cut(listed.groupBy("list").count().filter(F.col("count") > half))
    chunked = listed.join(long_lists, "list", "left").withColumn("chunks", F.coalesce(F.ceil(F.col("count") / half), F.lit(1)))
    own = F.pmod(F.xxhash64("fp", F.lit("chunk")), "chunks")
    lists = chunked.withColumn("own", own).select(
        "list",
        "fp",
        F.explode(F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda other: F.struct(F.least("own", other).alias("a"), F.greatest("own", other).alias("b")))).alias("chunk"),
    )
    dealt = (
        lists.select(F.xxhash64("list", "chunk.a", "chunk.b").alias("list"), "fp")
        .repartition("list")
        .sortWithinPartitions("list", "fp")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.empty(0, np.int64), np.empty(0, np.uint64)
        for batch in (*batches, None):
            if batch is not None:
                keys = np.concatenate([keys, batch.column(0).to_numpy()])
                fps = np.concatenate([fps, batch.column(1).to_numpy().view(np.uint64)])
                whole = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # the last list may go on
            else:
                whole = len(keys)
            done_keys, done_fps, keys, fps = keys[:whole], fps[:whole], keys[whole:], fps[whole:]
            first, second = close_pairs(done_keys, done_fps, radius)
            if len(first):
                node, root = forest(done_fps, first, second)
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(root.view(np.int64))], names=["u", "v"])

    return dealt.mapInArrow(compare, "u bigint, v bigint")


def simhash_groups(docs: DataFrame, id_col: str, text_col: str, size: int = 3, radius: int = 2) -> DataFrame:
    """(id, fp, component_id): component_id is the smallest id reachable over links of at most ``radius`` bits.

    Empty and null texts have fingerprint 0 and are linked like any other; repeated rows are linked by their equal
    fingerprints and stay repeated. Null ids take part but never name a component (it is null if all its ids are).
    Only id and text are read. The fingerprint table is checkpointed, texts are read once and never shuffled.
    """
    marked = cut(fingerprint_docs(docs, id_col, text_col, size))
    distinct = cut(marked.groupBy("fp").agg(F.min(id_col).alias("least_id")))
    roots = components(links(distinct, radius))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    rooted = cut(rooted)
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = cut(rooted.join(least, "root").select("fp", "component_id"))
    return marked.join(named, "fp").select(id_col, "fp", "component_id")
