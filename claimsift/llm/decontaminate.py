"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A text becomes the hashes of its words. A seed is the hash of the words that a fixed mask selects from a stretch; the
words it skips may differ. The two masks together hit every stretch of 16 words of which at most 3 differ, wherever
they stand (tests/llm tries all ways). An item of fewer than 16 words is cut into one block more than words of it may
differ, so one block is whole in every copy; its seeds are its blocks, and documents have seeds of all runs of such
lengths. Characters of scripts written without spaces are words of their own. Seeds of documents are joined with seeds of
the benchmark; every hit gives a document, an item and an offset between them, and around the hit the aligned words are
compared: an overlap counts if some stretch of 16 words (the whole item if it is shorter) agrees in 80 % of the words.

Of the document seeds only those leave the scan whose words at the places common to the masks are flagged as words of
an item, and that pass a Bloom filter of the benchmark seeds. The flags have a fixed size and the filter a largest one: a
larger benchmark makes them pass more, never miss any. Both come into the rows from subqueries, not as literals of the plan.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimsift.functions import bloom
from claimsift.llm.common import cut

#: Words of a stretch that each mask selects.
MASKS = ((0, 2, 3, 6, 7, 8), (0, 1, 2, 7, 9, 10))
STRETCH, AGREEING = 16, 0.8
#: Scripts that put no space between words.
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"
#: Ranges that hold all characters of these scripts, and are quick to look for.
MAY_BE_UNSPACED = r"[\x{E00}-\x{1FFF}\x{2E80}-\x{10FFFF}]"
#: Places that all masks select: a seed can only match where an item has words with such hashes there.
COMMON = sorted(set.intersection(*map(set, MASKS)))
#: Low bits of a word's hash that the flags of item words tell apart.
FLAG_BITS = 16
#: Bits of the filter for a seed, and its most bits as a power of two; three bits are set for a seed.
BITS_PER_SEED, FILTER_BITS = 16, 20


def word_hashes(text: Column) -> Column:
    lower = F.lower(F.coalesce(text, F.lit("")))
    spaced = F.when(lower.rlike(MAY_BE_UNSPACED) & lower.rlike(UNSPACED), F.regexp_replace(lower, f"({UNSPACED})", " $1 ")).otherwise(lower)
    words = F.array_remove(F.split(spaced, r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _seed(hashes: Column, start: Column, number: int) -> Column:
    return F.xxhash64(F.lit(number), *[F.get(hashes, start + place) for place in MASKS[number]])


def _starts(hashes: Column) -> Column:
    last = F.size(hashes) - min(mask[-1] for mask in MASKS) - 1
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def _seeds(hashes: Column, starts: Column, passes=None) -> Column:
    """array of (place, seed) for all masks from the given starts; only those seeds that ``passes``."""

    def of_mask(number: int) -> Column:
        def wanted(start: Column) -> Column:
            inside = start + MASKS[number][-1] < F.size(hashes)
            return inside if passes is None else inside & passes(_seed(hashes, start, number))

        return F.transform(F.filter(starts, wanted), lambda start: F.struct(start.alias("place"), _seed(hashes, start, number).alias("seed")))

    return F.concat(*[of_mask(number) for number in range(len(MASKS))])


def blocks(size: int, agreeing: float) -> list[tuple[int, int]]:
    """(place, length) of the blocks of an item of ``size`` words, one more than words of it may differ."""
    parts = min(size, size - math.ceil(size * agreeing) + 1)
    bounds = [size * k // parts for k in range(parts + 1)]
    return [(a, b - a) for a, b in zip(bounds, bounds[1:])]


def _run_seed(hashes: Column, start: Column, length: int) -> Column:
    return F.xxhash64(F.lit(-length), *[F.get(hashes, start + k) for k in range(length)])


def _block_seeds(hashes: Column, stretch: int, agreeing: float) -> Column:
    """Seeds of an item of fewer words than a stretch: array of (place, seed)."""
    seeds = F.array().cast("array<struct<place:int,seed:bigint>>")
    for size in range(1, stretch):
        of_size = [F.struct(F.lit(at).alias("place"), _run_seed(hashes, F.lit(at), n).alias("seed")) for at, n in blocks(size, agreeing)]
        seeds = F.when(F.size(hashes) == size, F.array(*of_size)).otherwise(seeds)
    return seeds


def _run_seeds(hashes: Column, lengths: list[int], starts: Column, passes) -> Column:
    """Seeds of the runs of the given lengths in a document that pass: array of (place, seed)."""

    def of_length(n: int) -> Column:
        inside = F.filter(starts, lambda start: (start + n <= F.size(hashes)) & passes(_run_seed(hashes, start, n)))
        return F.transform(inside, lambda start: F.struct(start.alias("place"), _run_seed(hashes, start, n).alias("seed")))

    return F.concat(*[of_length(n) for n in lengths])


def word_flags(items: DataFrame) -> Column:
    """A scalar, an array of booleans by the low bits of a word's hash: whether a word of an item has them.

    It is the result of a subquery, as is the filter, so that neither stands in a plan.
    """
    low = F.col("word").bitwiseAND(F.lit(2**FLAG_BITS - 1))
    known = items.select(F.explode("item_words").alias("word")).select(low.alias("id")).distinct().withColumn("known", F.lit(True))
    every = items.sparkSession.range(2**FLAG_BITS).join(known, "id", "left")
    rows = F.sort_array(F.collect_list(F.struct("id", F.coalesce("known", F.lit(False)).alias("known"))))
    return every.agg(F.transform(rows, lambda row: row["known"])).scalar()


def seed_filter(seeds: DataFrame) -> tuple[Column, int]:
    """(the filter of ``seed`` as a scalar array of longs, its bits as a power of two)."""
    bits = max(min((BITS_PER_SEED * seeds.count()).bit_length(), FILTER_BITS), 6)
    return bloom.bit_array(seeds.select(F.explode(F.array(*bloom.probe_places(F.col("seed"), bits))).alias("place")), bits), bits


def contaminated(
    docs: DataFrame, id_col: str, text_col: str, items: DataFrame, item_id_col: str, item_text_col: str,
    stretch: int = STRETCH, agreeing: float = AGREEING, shortest: int = 9,
) -> DataFrame:
    """(doc_id, item_id, n_equal, n_compared): the best stretch of every document and item that overlap.

    Null and empty texts have no words and overlap nothing; so do items of fewer than ``shortest`` words. Items of fewer
    than 16 words must lie in the document as a whole; all copies that agree enough are found. Repeated documents or items
    of one id give one row with the best stretch; null ids give rows with null. Items of one word repeated throughout
    are no evidence and match nothing, but a single word is an item. Empty tables give an empty table. Only ids and texts
    are read.
    """
    hashed_items = cut(
        items.select(F.col(f"`{item_id_col}`").alias("item_id"), word_hashes(F.col(f"`{item_text_col}`")).alias("item_words"))
        .filter((F.size("item_words") >= shortest) & ((F.size(F.array_distinct("item_words")) > 1) | (F.size("item_words") == 1)))
        .distinct()
        .withColumn("item_row", F.monotonically_increasing_id())
    )
    long_seeds = _seeds(F.col("item_words"), _starts(F.col("item_words")))
    short_seeds = _block_seeds(F.col("item_words"), stretch, agreeing)
    item_seeds = cut(
        hashed_items.select("item_row", F.explode(F.when(F.size("item_words") < stretch, short_seeds).otherwise(long_seeds)).alias("s"))
        .select("item_row", F.col("s.place").alias("item_place"), F.col("s.seed").alias("seed"))
    )
    wanted, bits = seed_filter(item_seeds.select("seed").distinct())
    sizes = {r["n"] for r in hashed_items.filter(F.size("item_words") < stretch).select(F.size("item_words").alias("n")).distinct().collect()}
    lengths = sorted({n for size in sizes for _, n in blocks(size, agreeing)})  # none, if no item is that short

    def known(start: Column) -> Column:
        return F.get("flags", F.get("words", start).bitwiseAND(F.lit(2**FLAG_BITS - 1)).cast("int"))

    def flagged(start: Column) -> Column:
        return reduce(and_, [known(start + place) for place in COMMON])

    def passes(seed: Column) -> Column:
        return reduce(and_, [bloom.is_set(F.col("wanted"), place) for place in bloom.probe_places(seed, bits)])

    # the row number is not deterministic to the optimizer, which therefore leaves the filter on hits above it and
    # does not compute the hits twice
    document_seeds = _seeds(F.col("words"), F.col("starts"), passes)
    run_starts = F.array().cast("array<int>")
    if lengths:
        every = F.when(F.size("words") > 0, F.sequence(F.lit(0), F.size("words") - 1)).otherwise(run_starts)
        run_starts = F.filter(every, lambda start: reduce(and_, [known(start + k) for k in range(lengths[0])]))
        document_seeds = F.concat(document_seeds, _run_seeds(F.col("words"), lengths, F.col("run_starts"), passes))
    hit_docs = cut(
        docs.select(F.col(f"`{id_col}`").alias("doc_id"), word_hashes(F.col(f"`{text_col}`")).alias("words"), word_flags(hashed_items).alias("flags"))
        .select("doc_id", "words", F.filter(_starts(F.col("words")), flagged).alias("starts"), run_starts.alias("run_starts"), wanted.alias("wanted"))
        .select("doc_id", "words", document_seeds.alias("hits"), F.monotonically_increasing_id().alias("doc_row"))
        .filter(F.size("hits") > 0)
    )
    hits = hit_docs.select("doc_row", F.explode("hits").alias("s")).select("doc_row", F.col("s.place").alias("place"), F.col("s.seed").alias("seed"))
    offsets = (
        hits.join(item_seeds, "seed")
        .select("doc_row", "item_row", (F.col("place") - F.col("item_place")).alias("offset"))
        .distinct()
    )
    aligned = (
        offsets.join(hit_docs.select("doc_row", "doc_id", "words"), "doc_row")
        .join(hashed_items, "item_row")
        .withColumn("doc_from", F.greatest(F.col("offset"), F.lit(0)))
        .withColumn("item_from", F.greatest(-F.col("offset"), F.lit(0)))
        .withColumn("common", F.least(F.size("words") - F.col("doc_from"), F.size("item_words") - F.col("item_from")))
        .withColumn("n_compared", F.least(F.lit(stretch), F.size("item_words")))
        .filter("common >= n_compared")
        .withColumn(
            "equal",
            F.zip_with(
                F.slice("words", F.col("doc_from") + 1, F.col("common")),
                F.slice("item_words", F.col("item_from") + 1, F.col("common")),
                lambda a, b: (a == b).cast("int"),
            ),
        )
    )
    window_sums = F.transform(
        F.sequence(F.lit(1), F.col("common") - F.col("n_compared") + 1),
        lambda start: F.aggregate(F.slice("equal", start, F.col("n_compared")), F.lit(0), lambda total, e: total + e),
    )
    return (
        aligned.select("doc_id", "item_id", F.array_max(window_sums).alias("n_equal"), "n_compared")
        .filter(F.col("n_equal") >= F.ceil(F.col("n_compared") * F.lit(agreeing)))
        .groupBy("doc_id", "item_id")
        .agg(F.max(F.struct("n_equal", "n_compared")).alias("best"))
        .select("doc_id", "item_id", F.col("best.n_equal").cast("bigint").alias("n_equal"), F.col("best.n_compared").cast("bigint").alias("n_compared"))
    )
