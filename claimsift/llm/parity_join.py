"""Jaccard join of documents on word shingles, by parity sketches.

A set of shingle hashes becomes a sketch of 64-bit words: the high half of a hash chooses the word, its low bits the bit
that it flips. Two sketches differ in no more bits than the sets differ in elements, and an element only ever touches one
word. Sets are banded by size so that similar sets stand in one band or in neighbouring ones. In a band, similar sets differ
in at most D elements; the sketch has D + s words, so at least s words are equal. Documents that share a word become
candidates.

Words of at most one bit say little and would bring unrelated documents together. They count only if s of them agree, since
otherwise a heavier word is equal too: two of the first L - s + 2 of a document's L light words, in one order for all, are
then equal as well, and their pairs are joined instead. A document of L light words needs s - L heavier ones that it shares;
most documents that merely quote a passage share fewer, and leave before any set is compared.

Sets that are equal are one node. Words that many share are dropped from a list, in one order for all, as long as enough of
what it needs stay: similar sets share enough of the others. In each group of nodes that share a word, all are paired with
the first few of them. Pairs that share enough words, and whose small sketches of whole sets are near, are verified on the
sets themselves. Small groups are decided then, and a large one of near copies is connected; a large group that is not is
compared in blocks of bounded size, first by the small sketches.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimsift.llm.common import chunks, cut, drop_cut, release, texts_of
from claimsift.llm.components import components

#: Words of a sketch with at most so many bits are light.
LIGHT_BITS = 1
#: The filter of shared sketch words: bits per word, and the least and most bits.
BITS_PER_WORD, FILTER_BITS = 8, (20, 27)
LIST = pa.struct([("tag", pa.int64()), ("need", pa.int64()), ("sigs", pa.list_(pa.int64()))])
#: Times that documents are dropped which share too little with those that are left, at most; and the share of signatures
#: that one time must drop for another one to be worth its shuffle.
PRUNINGS, WORTH_PRUNING = 2, 0.1
#: Members of a group of a shared word with which all others are compared first.
PIVOTS = 8
#: Signatures of the number that it needs which a list keeps when it drops those of large groups.
LEAST_SHARED = 3
#: Rows and bytes that pass to and from a task's Python at once (a single larger row passes whole).
ARROW_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}
#: Hashes that a block of the final comparison may hold, and its least number of sets.
BLOCK_HASHES, BLOCK_SETS = 1 << 21, 8


class Bands:
    """Sizes from ``low[k]`` up to, not including, ``low[k + 1]`` are band k; similar sets are at most one band apart."""

    def __init__(self, percent: int):
        self.percent = percent
        self.low = [1]
        while self.low[-1] < 1 << 40:
            self.low.append(100 * self.low[-1] // percent + 1)

    def of(self, size: int) -> int:
        return bisect_right(self.low, size) - 1

    def shape(self, band: int) -> tuple[int, int]:
        """(D, s) of sets of which the larger is in the band."""
        largest = self.low[band + 1] - 1
        differing = (100 - self.percent) * 2 * largest // (100 + self.percent)
        return differing, 2 + differing // 6

    def compared_words(self, band: int) -> int:
        """Words of the sketches of whole sets that are compared in the band: two bits for each hash of the largest set."""
        return max(4, -(-(self.low[band + 1] - 1) // 32))


#: Bytes whose words are hashed at once; a longer word is hashed in one go.
HASHED_BYTES = 1 << 19
LONG_WORD = 256
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BASE = 0x9E3779B97F4A7C15  # any odd number
_INVERSE = pow(_BASE, -1, 1 << 64)
_OF_BYTE = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    held = _POWERS.get(base)
    if held is None or len(held) < n:
        factors = np.full(max(n, HASHED_BYTES), base, np.uint64)
        factors[0] = 1
        held = _POWERS[base] = np.cumprod(factors, dtype=np.uint64)
    return held[:n]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(first bytes, 64-bit hashes) of the words of lower-cased UTF-8: a polynomial of the bytes, from running sums."""
    starts, hashes = [], []
    at = 0
    while at < len(data):
        end = min(at + HASHED_BYTES, len(data))
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        part = np.frombuffer(data, np.uint8, end - at, at)
        space = np.concatenate([[True], _SPACE[part], [True]])
        edges = np.flatnonzero(space[1:] != space[:-1])
        first, after = edges[::2], edges[1::2]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_OF_BYTE[part] * _powers(_BASE, len(part)), dtype=np.uint64)])
        found = _mixed((sums[after] - sums[first]) * _powers(_INVERSE, len(part) + 1)[first] + (after - first).astype(np.uint64))
        for k in np.flatnonzero(after - first > LONG_WORD):
            found[k] = xxhash.xxh3_64_intdigest(part[first[k] : after[k]].tobytes())
        starts.append(first + at)
        hashes.append(found)
        at = end
    if not starts:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(starts), np.concatenate(hashes)


def shingle_sets(texts: list[str], size: int) -> list[np.ndarray]:
    """Sorted hashes of the distinct shingles of each text; of the whole sequence if it is shorter; none without words."""
    encoded = [t.encode() for t in texts]
    offsets = np.cumsum([0, *(len(e) + 1 for e in encoded)])
    starts, hashes = word_hashes(b"\n".join(encoded).lower())  # on bytes: only A-Z
    bounds = np.searchsorted(starts, offsets)
    places = max(len(hashes) - size + 1, 0)
    mixed = np.full(places, size, np.uint64)
    for k in range(size):
        mixed = _mixed((mixed << np.uint64(1)) + hashes[k : k + places])
    out = []
    for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if high - low >= size:
            found = np.sort(mixed[low : high - size + 1])
            out.append(found[np.concatenate([[True], found[1:] != found[:-1]])])
        else:
            short = np.full(min(high - low, 1), high - low, np.uint64)
            for k in range(low, high):
                short = _mixed((short << np.uint64(1)) + hashes[k])
            out.append(short)
    return out


def sketch(hashes: np.ndarray, words: int) -> np.ndarray:
    """The parity sketch of sorted hashes."""
    place = ((hashes >> np.uint64(32)) * np.uint64(words)) >> np.uint64(32)
    starts = np.flatnonzero(np.diff(place, prepend=np.uint64(words)))
    out = np.zeros(words, np.uint64)
    out[place[starts]] = np.bitwise_xor.reduceat(np.uint64(1) << (hashes & np.uint64(63)), starts)
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    # The finalizer of SplitMix64
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sketches(hashes: np.ndarray, bands: Bands) -> dict[int, np.ndarray]:
    """The sketches of a set by band: its own and the next one, if sets that differ can be similar there."""
    own = bands.of(len(hashes)) if len(hashes) else 0
    shapes = {band: bands.shape(band) for band in (own, own + 1)}
    return {band: sketch(hashes, differing + spare) for band, (differing, spare) in shapes.items() if differing and len(hashes)}


def signatures(of_bands: dict[int, np.ndarray], bands: Bands) -> list[tuple[int, int, np.ndarray]]:
    """[(tag, need, 64-bit hashes)]: of one of these lists, two different sets that are similar enough share ``need`` hashes.

    ``need`` is that of the set itself. The lists are those of heavy words, and pairs of light words, of either band; the
    tag is the band, doubled, plus one for pairs.
    """
    found: list[tuple[int, int, np.ndarray]] = []
    for band, words in of_bands.items():
        _, spare = bands.shape(band)
        numbers = np.arange(len(words), dtype=np.uint64) + np.uint64(band << 40)
        named = _mixed(words ^ _mixed(numbers))
        bits = np.bitwise_count(words)
        heavy = bits > LIGHT_BITS
        n_light = len(words) - int(heavy.sum())
        found.append((2 * band, max(1, spare - n_light), named[heavy]))
        if n_light >= spare:
            light = np.flatnonzero(~heavy)
            light = light[np.argsort(-bits[light].astype(np.int8), kind="stable")]
            first = named[light[: n_light - spare + 2]]
            one, two = np.array(list(combinations(range(len(first)), 2))).T
            found.append((2 * band + 1, 1, _mixed(first[one] + _mixed(first[two]))))
    return found


class Lists(NamedTuple):
    """Lists of signatures, those of a set together and in the order of its index; ``sigs`` are those of all lists."""

    of: np.ndarray
    tag: np.ndarray
    need: np.ndarray
    sizes: np.ndarray
    sigs: np.ndarray


def signature_lists(sets: list[np.ndarray], bands: Bands) -> Lists:
    """The ``signatures`` of many sets, whose sketches are made at once."""
    lengths = np.array([len(h) for h in sets], np.int64)
    hashes = np.concatenate([*sets, np.empty(0, np.uint64)])
    bit, high = np.uint64(1) << (hashes & np.uint64(63)), hashes >> np.uint64(32)
    own = np.searchsorted(np.array(bands.low), lengths, side="right") - 1
    parts: list[tuple] = []
    for band in (own, own + 1):
        shapes = {k: bands.shape(k) if k >= 0 else (0, 0) for k in np.unique(band).tolist()}
        differing, spare = np.array([shapes[k] for k in band.tolist()], np.int64).reshape(-1, 2).T
        n_words = np.where((differing > 0) & (lengths > 0), differing + spare, 0)
        low = _from_zero(n_words)
        inside = np.repeat(n_words > 0, lengths)
        place = (high[inside] * np.repeat(n_words, lengths)[inside].astype(np.uint64)) >> np.uint64(32)
        place = place.astype(np.int64) + np.repeat(low[:-1], lengths)[inside]
        starts = np.flatnonzero(np.diff(place, prepend=-1))
        words = np.zeros(low[-1], np.uint64)
        if len(starts):
            words[place[starts]] = np.bitwise_xor.reduceat(bit[inside], starts)
        of = np.repeat(np.arange(len(sets)), n_words)
        numbers = np.arange(low[-1]) - low[of] + (band[of] << 40)
        named = _mixed(words ^ _mixed(numbers.astype(np.uint64)))
        bits = np.bitwise_count(words)
        heavy = bits > LIGHT_BITS
        n_heavy = np.bincount(of[heavy], minlength=len(sets))
        n_light = n_words - n_heavy
        some = np.flatnonzero(n_words)
        parts.append((some, 2 * band[some], np.maximum(1, spare - n_light)[some], n_heavy[some], named[heavy]))
        for k in some[n_light[some] >= spare[some]].tolist():
            light = low[k] + np.flatnonzero(~heavy[low[k] : low[k + 1]])
            light = light[np.argsort(-bits[light].astype(np.int8), kind="stable")]
            first = named[light[: n_light[k] - spare[k] + 2]]
            one, two = np.triu_indices(len(first), 1)
            parts.append(([k], [2 * band[k] + 1], [1], [len(one)], _mixed(first[one] + _mixed(first[two]))))
    of, tag, need, sizes = (np.concatenate([p[k] for p in parts]).astype(np.int64) for k in range(4))
    order = np.lexsort((tag, of))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    sigs = np.concatenate([p[4] for p in parts])[np.argsort(np.repeat(rank, sizes), kind="stable")]
    return Lists(of[order], tag[order], need[order], sizes[order], sigs)


def passing_lists(lists: Lists, rows: int, filtered: np.ndarray) -> pa.ListArray:
    """For each of ``rows`` its lists of the signatures that the filter lets through, where they are as many as needed."""
    inside = passing(lists.sigs, filtered)
    counts = np.diff(_from_zero(inside)[_from_zero(lists.sizes)])
    enough = counts >= lists.need
    values = pa.array(lists.sigs[inside & np.repeat(enough, lists.sizes)].view(np.int64))
    left = pa.ListArray.from_arrays(pa.array(_from_zero(counts[enough]), pa.int32()), values)
    columns = [pa.array(lists.tag[enough]), pa.array(lists.need[enough]), left]
    of_lists = pa.StructArray.from_arrays(columns, fields=[LIST.field(k) for k in range(3)])
    per_row = np.bincount(lists.of[enough], minlength=rows)
    return pa.ListArray.from_arrays(pa.array(_from_zero(per_row), pa.int32()), of_lists)


def set_key(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def word_filter(shared: DataFrame) -> np.ndarray:
    """A Bloom filter with two probes of ``sig``. It stops growing at a fixed size, then lets more through, never less."""
    bits = min(max((BITS_PER_WORD * shared.count()).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])
    probes = F.array(*[F.shiftrightunsigned("sig", 64 - bits if k else 0).bitwiseAND(F.lit(2**bits - 1)) for k in (0, 1)])
    bit = F.shiftright("p", 6).cast("int").alias("word"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("bit")
    words = shared.select(F.explode(probes).alias("p")).select(*bit).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(2**bits // 64, np.int64)
    out[words.column(0).to_numpy()] = words.column(1).to_numpy()
    return out.view(np.uint64)


def passing(sigs: np.ndarray, filtered: np.ndarray) -> np.ndarray:
    """Which of ``sigs`` the filter lets through."""
    bits = (len(filtered) * 64).bit_length() - 1
    inside = np.ones(len(sigs), bool)
    for place in (sigs & np.uint64(2**bits - 1), sigs >> np.uint64(64 - bits)):
        inside &= (filtered[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1
    return inside


def _text_chunks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
        for start, end in chunks(sizes, HASHED_BYTES):
            yield batch.slice(start, end - start)


def shared_words(texts: DataFrame, size: int, bands: Bands) -> DataFrame:
    """(sig) that more than one set has; ``texts`` has one column. Copies of a set are folded before they are shuffled."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _text_chunks(batches, 0):
            sets = shingle_sets(texts_of(some.column(0)), size)
            lists = signature_lists(sets, bands)
            keys = np.array([xxhash.xxh3_64_intdigest(h.tobytes()) for h in sets], dtype=np.uint64)
            columns = [lists.sigs, np.repeat(keys[lists.of], lists.sizes)]
            yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in columns], names=["sig", "owner"])

    rows = texts.mapInArrow(work, "sig bigint, owner bigint")
    return rows.groupBy("sig").agg(F.min("owner").alias("low"), F.max("owner").alias("high")).filter("low <> high").select("sig")


def set_owner(key: bytes) -> int:
    """The first 64 bits of a set's key, as a signed long."""
    return int.from_bytes(key[:8], "little", signed=True)


def marked_docs(docs: DataFrame, id_col: str, text_col: str, size: int, bands: Bands, filtered: np.ndarray) -> DataFrame:
    """(id, n, key, owner, lists) of every document; owner is the first half of key.

    ``lists`` are (tag, need, sigs) of the signatures that the filter lets through, where they are enough. The tag is the
    band, doubled, plus one for pairs of light words.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    spread = docs.sparkSession.sparkContext.broadcast(filtered)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _text_chunks(batches, 1):
            sets = shingle_sets(texts_of(some.column(1)), size)
            keys = [set_key(h) for h in sets]
            columns = [
                some.column(0), pa.array([len(h) for h in sets], pa.int64()), pa.array(keys, pa.binary()),
                pa.array([set_owner(k) for k in keys], pa.int64()), passing_lists(signature_lists(sets, bands), len(sets), spread.value),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "key", "owner", "lists"])

    schema = f"id {rows.dtypes[0][1]}, n bigint, key binary, owner bigint, lists array<struct<tag:bigint,need:bigint,sigs:array<bigint>>>"
    return rows.mapInArrow(work, schema)


def wanted_sets(texts: DataFrame, size: int, owners: DataFrame) -> DataFrame:
    """(owner, key, n, hashes) of the different sets of ``owners``, and of a few others."""
    spread = texts.sparkSession.sparkContext.broadcast(word_filter(owners.select(F.col("owner").alias("sig"))))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _text_chunks(batches, 0):
            sets = shingle_sets(texts_of(some.column(0)), size)
            keys = [set_key(h) for h in sets]
            of = np.array([set_owner(k) for k in keys], np.int64)
            inside = np.flatnonzero(passing(of.view(np.uint64), spread.value))
            columns = [
                pa.array(of[inside]), pa.array([keys[k] for k in inside], pa.binary()),
                pa.array([len(sets[k]) for k in inside], pa.int64()), pa.array([sets[k].tobytes() for k in inside], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["owner", "key", "n", "hashes"])

    rows = texts.mapInArrow(work, "owner bigint, key binary, n bigint, hashes binary")
    return rows.groupBy("owner", "key").agg(F.first("n").alias("n"), F.first("hashes").alias("hashes"))


def rows_of(lists: DataFrame) -> DataFrame:
    """(owner, tag, need, sig) of (owner, lists)."""
    return lists.select("owner", F.explode("lists").alias("s")).select("owner", "s.tag", "s.need", F.explode("s.sigs").alias("sig"))


def pruned(lists: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(owner, lists) without the signatures that no other owner has, as far as a filter tells, and without lists that are
    short of what they need then; and a filter of the signatures of large groups. What is dropped is no part of a link."""
    owners = F.count("*").alias("owners"), F.min("owner").alias("low"), F.max("owner").alias("high")
    shared = cut(rows_of(lists).groupBy("sig").agg(*owners).filter("low <> high").select("sig", (F.col("owners") > PIVOTS + 1).alias("large")))
    spread, frequent = lists.sparkSession.sparkContext.broadcast(word_filter(shared)), word_filter(shared.filter("large"))
    drop_cut(shared)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = passing_lists(_lists_of(batch.column(1)), len(batch), spread.value)
            some = pc.greater(pc.list_value_length(left), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(some), left.filter(some)], names=["owner", "lists"])

    return _cut_alone(lists.mapInArrow(work, "owner bigint, lists array<struct<tag:bigint,need:bigint,sigs:array<bigint>>>")), frequent


def _lists_of(of_owner: pa.ListArray) -> Lists:
    tag, need, sigs = of_owner.flatten().flatten()
    of = np.repeat(np.arange(len(of_owner)), pc.list_value_length(of_owner).to_numpy())
    return Lists(of, tag.to_numpy(), need.to_numpy(), pc.list_value_length(sigs).to_numpy(), sigs.flatten().to_numpy().view(np.uint64))


def kept_signatures(lists: Lists, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of the signatures are kept, how many each list has dropped).

    All lists put the signatures of the filter last, in one order, and drop the last ones, as long as these are in the filter
    and LEAST_SHARED of what the list needs stay. Of what two lists share then, only what the one that drops more of the
    order has dropped is gone: of signatures of which both need n, they share n less the larger number dropped.
    """
    large = passing(lists.sigs, frequent)
    of = np.repeat(np.arange(len(lists.sizes)), lists.sizes)
    dropped = np.minimum(np.bincount(of[large], minlength=len(lists.sizes)), np.maximum(lists.need - LEAST_SHARED, 0))
    order = np.lexsort((lists.sigs, large, of))
    kept = np.empty(len(order), bool)
    kept[order] = np.arange(len(order)) < _from_zero(lists.sizes)[of + 1] - dropped[of]
    return kept, dropped


def kept_rows(lists: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(owner, tag, need, dropped, sig) of (owner, lists): ``kept_signatures``, with the number that their list has dropped."""
    spread = lists.sparkSession.sparkContext.broadcast(frequent)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = _lists_of(batch.column(1))
            kept, dropped = kept_signatures(given, spread.value)
            of = np.repeat(np.arange(len(given.sizes)), given.sizes)[kept]
            columns = [batch.column(0).to_numpy()[given.of[of]], given.tag[of], given.need[of], dropped[of], given.sigs[kept].view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["owner", "tag", "need", "dropped", "sig"])

    return lists.mapInArrow(work, "owner bigint, tag bigint, need bigint, dropped bigint, sig bigint")


def _from_zero(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)])


def _cut_alone(df: DataFrame) -> DataFrame:
    """The rows written, and the shuffles before them removed at once: they are of the size of the corpus."""
    out = cut(df)
    release(df.sparkSession)
    return out


def _array(value: pa.Scalar) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), np.uint64)


def compared_sketches(sets: DataFrame, bands: Bands) -> DataFrame:
    """(owner, band, n, words): the sketches of ``compared_words`` of each set, in its own band and the next one.

    They are a small part of the hashes. Fewer words make sets look nearer, never farther apart.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, lengths = (batch.column(k).to_pylist() for k in (0, 1))
            rows = [(k, band) for k, n in enumerate(lengths) for band in (bands.of(n), bands.of(n) + 1)]
            words = [sketch(_array(batch.column(2)[k]), bands.compared_words(band)).tobytes() for k, band in rows]
            columns = [[owners[k] for k, _ in rows], [band for _, band in rows], [lengths[k] for k, _ in rows]]
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns], pa.array(words, pa.binary())], names=["owner", "band", "n", "words"])

    return sets.select("owner", "n", "hashes").mapInArrow(work, "owner bigint, band bigint, n bigint, words binary")


def near_pairs(pairs: DataFrame, sketched: DataFrame, percent: int) -> DataFrame:
    """(u, v) of the pairs (u, v, band) of owners whose sketches are near enough."""
    one, two = (sketched.select(F.col("owner").alias(x), "band", F.col("n").alias(f"n_{x}"), F.col("words").alias(f"of_{x}")) for x in "uv")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.add(batch.column(2), batch.column(3)).to_numpy()
            bits = [int(np.bitwise_count(_array(a) ^ _array(b)).sum(dtype=np.int64)) for a, b in zip(batch.column(4), batch.column(5))]
            near = (100 + percent) * np.array(bits, np.int64) <= (100 - percent) * sizes
            yield batch.select([0, 1]).filter(pa.array(near, pa.bool_()))

    whole = pairs.join(one, ["u", "band"]).join(two, ["v", "band"]).select("u", "v", "n_u", "n_v", "of_u", "of_v")
    return whole.mapInArrow(work, "u bigint, v bigint").distinct()


def _sets_of(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The sets of owners of ``pairs``, and of a few others."""
    ends = pairs.select(F.explode(F.array("u", "v")).alias("sig")).distinct()
    spread = sets.sparkSession.sparkContext.broadcast(word_filter(ends))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passing(batch.column(0).to_numpy().view(np.uint64), spread.value), pa.bool_()))

    return sets.select("owner", "key", "hashes").mapInArrow(work, "owner bigint, key binary, hashes binary")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v): keys of the pairs (u, v) of owners whose sets are similar. ``pairs`` are read twice."""
    sets = _sets_of(sets, pairs)
    one, two = (sets.select(F.col("owner").alias(x), F.col("key").alias(f"key_{x}"), F.col("hashes").alias(f"of_{x}")) for x in "uv")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = [similar(_array(a), _array(b), percent) for a, b in zip(batch.column(2), batch.column(3))]
            yield batch.select([0, 1]).filter(pa.array(same, pa.bool_()))

    whole = pairs.join(one, "u").join(two, "v").select(F.col("key_u").alias("u"), F.col("key_v").alias("v"), "of_u", "of_v")
    return whole.mapInArrow(work, "u binary, v binary")


def pairs_and_members(rows: DataFrame) -> DataFrame:
    """(u, v, tag) of ``kept_rows``: pairs of owners that share as many signatures of a list as both need, as far as groups
    show it, and, with tags below zero, (owner, sig, -1 - tag) of the members of large groups.

    Every member of a group is paired with the first few only, so a group costs in proportion to its size; in groups of
    up to one more than these few all pairs are seen. Larger ones are large.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((0, 5), np.int64)  # the first rows of the last group, up to PIVOTS + 1
        seen = 0  # rows of that group
        for batch in batches:
            given = np.column_stack([c.to_numpy() for c in batch.columns])
            if not len(given):
                continue
            if len(held) and held[0, 0] != given[0, 0]:
                held, seen = held[:0], 0
            rows = np.concatenate([held, given])  # held ones have their pairs already
            sig, owner, tag, need, dropped = rows.T
            first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
            of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(rows))))
            place = np.arange(len(rows)) - first[of]
            place[len(held) :] += np.where(of[len(held) :] == 0, seen - len(held), 0)
            fresh = np.arange(len(rows)) >= len(held)
            parts = []
            for k in range(PIVOTS):
                u = np.flatnonzero(fresh & (place > k))
                v = first[of[u]] + k
                u, v = u[owner[u] != owner[v]], v[owner[u] != owner[v]]
                parts.append((owner[u], owner[v], tag[u], np.maximum(need[u], need[v]) - np.maximum(dropped[u], dropped[v])))
            # a group is large from its row PIVOTS + 1 on, which brings the rows before it along
            turned = first[of[np.flatnonzero(fresh & (place == PIVOTS + 1))]]
            member = np.concatenate([np.flatnonzero(fresh & (place > PIVOTS)), (turned[:, None] + np.arange(PIVOTS + 1)).ravel()])
            parts.append((owner[member], sig[member], -1 - tag[member], np.zeros(len(member), np.int64)))
            seen = int(place[-1]) + 1
            held = rows[first[-1] : first[-1] + PIVOTS + 1]
            columns = [np.concatenate(c) for c in zip(*parts)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["u", "v", "tag", "most"])

    dealt = rows.select("sig", "owner", "tag", "need", "dropped").repartition("sig").sortWithinPartitions("sig", "owner")
    found = dealt.mapInArrow(work, "u bigint, v bigint, tag bigint, most bigint")
    return found.groupBy("u", "v", "tag").agg(F.count("*").alias("m"), F.max("most").alias("most")).filter("m >= most").select("u", "v", "tag")


def near_in_block(words: np.ndarray, sizes: np.ndarray, roots: np.ndarray, sides: np.ndarray, percent: int, forest: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of different roots and sides (of any sides if there is one only) whose sketches are near enough.

    With ``forest`` only pairs that connect roots which no earlier pair has connected.
    """
    one_side = len(np.unique(sides)) == 1
    first, second = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for k in range(len(words) - 1):
        other = np.arange(k + 1, len(words))
        other = other[(roots[other] != roots[k]) & (one_side | (sides[other] != sides[k]))]
        bits = np.bitwise_count(words[other] ^ words[k]).sum(axis=1, dtype=np.int64)
        near = other[(100 + percent) * bits <= (100 - percent) * (sizes[other] + sizes[k])]
        if forest and len(near):
            found, at = np.unique(roots[near], return_index=True)
            near = near[at]
            roots = np.where(np.isin(roots, found), roots[k], roots)
        first.append(np.full(len(near), k))
        second.append(near)
    return np.concatenate(first), np.concatenate(second)


def near_in_lists(members: DataFrame, sketched: DataFrame, percent: int, forest: bool) -> DataFrame:
    """(u, v): pairs of members (list, owner, root, tag) of one list that have different roots and near sketches.

    With ``forest`` only pairs that connect roots in a task, so their number stays below that of the members. Long lists are cut into blocks, and every two blocks are compared in a task of their own.
    """
    members = members.select("list", "owner", "root", F.shiftright("tag", 1).alias("band"))
    per_list = members.join(sketched.select("owner", "band", "n"), ["owner", "band"]).groupBy("list").agg(F.count("*").alias("m"), F.max("n").alias("most"))
    held = F.greatest(F.lit(BLOCK_SETS), F.floor(F.lit(BLOCK_HASHES) / F.col("most")))
    cuts = cut(per_list.select("list", F.greatest(F.ceil(F.col("m") / held), F.lit(1)).cast("int").alias("blocks")))
    side = F.pmod(F.xxhash64("owner", F.lit("block")), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.struct(F.least("side", other).alias("a"), F.greatest("side", other).alias("b")))
    sided = members.join(cuts, "list").withColumn("side", side)
    dealt = (
        sided.join(sketched, ["owner", "band"])
        .select("list", "owner", "root", "side", "n", "words", F.explode(pairs).alias("pair"))
        .select(F.xxhash64("list", "pair.a", "pair.b").alias("list"), "side", "owner", "root", "n", "words")
        .repartition("list").sortWithinPartitions("list", "owner")
    )

    def near(rows: list[tuple]) -> pa.RecordBatch | None:
        _, roots = np.unique(np.array([row[3] for row in rows], dtype="V16"), return_inverse=True)
        words = np.array([np.frombuffer(row[5], np.uint64) for row in rows])
        first, second = near_in_block(words, np.array([row[4] for row in rows]), roots, np.array([row[1] for row in rows]), percent, forest)
        if not len(first):
            return None
        return pa.RecordBatch.from_arrays([pa.array([rows[k][2] for k in which], pa.int64()) for which in (first, second)], names=["u", "v"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*[column.to_pylist() for column in batch.columns]):
                if held and held[0][0] != row[0]:
                    found, held = near(held), []
                    if found is not None:
                        yield found
                held.append(row)
        if held:
            found = near(held)
            if found is not None:
                yield found

    return dealt.mapInArrow(work, "u bigint, v bigint")


def similar_sets(lists: DataFrame, frequent: np.ndarray, texts: DataFrame, size: int, percent: int, bands: Bands) -> DataFrame:
    """(node, root) of the keys of sets that are linked to a smaller key; ``lists`` has (owner, lists), ``frequent`` is a
    filter of the signatures of large groups. Any filter gives the same result."""
    found = _cut_alone(pairs_and_members(kept_rows(lists, frequent)))
    pairs = cut(found.filter("tag >= 0").select("u", "v", F.shiftright("tag", 1).alias("band")).distinct())
    large = cut(found.filter("tag < 0").select(F.col("v").alias("sig"), F.col("u").alias("owner"), (-1 - F.col("tag")).alias("tag")))
    drop_cut(found)
    owners = cut(pairs.select(F.explode(F.array("u", "v")).alias("owner")).unionByName(large.select("owner")).distinct())
    sets = _cut_alone(wanted_sets(texts, size, owners))
    drop_cut(lists)
    sketched = cut(compared_sketches(sets, bands))
    pairs = _cut_alone(near_pairs(pairs, sketched, percent))
    roots = components(_cut_alone(verified(pairs, sets, percent)))
    if large.isEmpty():
        return roots
    # large groups that are not connected by now are compared, equal lists of members once: first along forests of near
    # sketches, and only where the ends of a pair of a forest are not connected after all, in all pairs of what is still apart
    more = None
    for forest in (True, False):
        of_owner = sets.select("owner", "key").join(roots, F.col("key") == F.col("node"), "left").select("owner", F.coalesce("root", "key").alias("root"))
        if not forest:
            of_end = [of_owner.select(F.col("owner").alias(x), F.col("root").alias(f"root_{x}")) for x in "uv"]
            apart = cut(more.join(of_end[0], "u").join(of_end[1], "v").filter("root_u <> root_v").select(F.col("u").alias("owner")).distinct())
            large = cut(large.join(large.join(apart, "owner", "left_semi").select("sig").distinct(), "sig"))
        rooted = cut(large.join(of_owner, "owner"))
        open_groups = rooted.groupBy("sig").agg(
            F.count("*").alias("m"), F.bit_xor(F.xxhash64("owner")).alias("all"), F.bit_xor(F.xxhash64("owner", F.lit(1))).alias("all2"),
            F.min("root").alias("low"), F.max("root").alias("high"),
        ).filter("low <> high")
        unlike = open_groups.groupBy("m", "all", "all2").agg(F.min("sig").alias("sig"))
        members = _cut_alone(rooted.join(unlike.select("sig"), "sig").select(F.col("sig").alias("list"), "owner", "root", "tag"))
        near = near_in_lists(members, sketched, percent, forest)
        more = _cut_alone(near.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        links = _cut_alone(verified(cut(more.join(pairs, ["u", "v"], "left_anti")), sets, percent))
        if not links.isEmpty():
            roots = components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(links))
        if links.count() == more.count():
            break
    return roots


def jaccard_groups(docs: DataFrame, id_col: str, text_col: str, size: int = 4, percent: int = 85) -> DataFrame:
    """(id, n_shingles, component_id): component_id is the smallest id reachable over links of at least ``percent``.

    The set of a document is its distinct shingles of ``size`` words, the whole sequence if there are fewer. Null and empty
    texts and texts without words have an empty set, are linked with nothing and are components of their own. Equal sets
    are linked; repeated rows stay repeated. Null ids take part but never name a component (it is null if all its ids
    are). An empty table gives an empty table. Only id and text are read, three times: to count the words of all sketches, to find
    the sets that share enough of them, and to compare these sets. Only hashes are shuffled.
    """
    with _small_batches(docs.sparkSession):
        return _jaccard_groups(docs, id_col, text_col, size, percent)


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    before = {name: spark.conf.get(name, None) for name in ARROW_BATCHES}
    try:
        for name, value in ARROW_BATCHES.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _n_signatures(lists: DataFrame) -> int:
    of_owner = F.aggregate("lists", F.lit(0), lambda n, x: n + F.size(x["sigs"]))
    return lists.agg(F.sum(of_owner)).first()[0] or 0


def _jaccard_groups(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    bands = Bands(percent)
    texts = docs.select(F.col(f"`{text_col}`").alias("text"))
    shared = _cut_alone(shared_words(texts, size, bands))
    filtered = word_filter(shared)
    drop_cut(shared)
    with_lists = cut(marked_docs(docs, id_col, text_col, size, bands, filtered))
    del shared, filtered
    lists = cut(with_lists.filter(F.size("lists") > 0).groupBy("owner").agg(F.first("lists").alias("lists")))
    marked = cut(with_lists.select("id", "n", "key"))
    drop_cut(with_lists)
    del with_lists
    release(docs.sparkSession)
    held = _n_signatures(lists)
    for _ in range(PRUNINGS):
        given, before = lists, held
        lists, frequent = pruned(given)
        drop_cut(given)
        held = _n_signatures(lists)
        if held > (1 - WORTH_PRUNING) * before:
            break
    release(docs.sparkSession)
    roots = similar_sets(lists, frequent, texts, size, percent, bands)
    least = marked.filter("n > 0").groupBy("key").agg(F.min("id").alias("least_id"))
    rooted = cut(least.join(roots, F.col("key") == F.col("node"), "left").select("key", "least_id", F.coalesce("root", "key").alias("root")))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")), "root").select("key", "component_id")
    filled = marked.filter("n > 0").join(cut(named), "key").select("id", "n", "component_id")
    empty = marked.filter("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return filled.unionByName(empty).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
