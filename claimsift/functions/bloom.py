"""Bloom filters in DataFrame functions: a bit array as a scalar, and a scan that only passes rows whose key may be wanted."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimsift.functions.plan_shape import written

#: Bits per key, and the least and most bits of a filter as powers of two (8 KB to 4 MB).
BITS_PER_KEY, FILTER_BITS = 16, (16, 25)
_SHIFTS = (0, 19, 39)


def bit_array(places: DataFrame, bits: int) -> Column:
    """A scalar: 2 ** (bits - 6) longs, in which the bits at the ``place`` values are set.

    It is read as a scalar subquery, so its values never stand in a plan.
    """
    words = places.select(F.shiftright("place", 6).cast("int").alias("word"), F.expr("shiftleft(1L, cast(place & 63 as int))").alias("bit"))
    words = words.groupBy("word").agg(F.bit_or("bit").alias("bits"))
    every = places.sparkSession.range(2 ** (bits - 6)).select(F.col("id").cast("int").alias("word"))
    dense = every.join(words, "word", "left").select(F.struct("word", F.coalesce("bits", F.lit(0)).alias("bits")).alias("w"))
    return dense.agg(F.transform(F.sort_array(F.collect_list("w")), lambda w: w["bits"])).scalar()


def is_set(array: Column, place: Column) -> Column:
    return F.getbit(F.get(array, F.shiftright(place, 6).cast("int")), place.bitwiseAND(F.lit(63)).cast("int")) == 1


def probe_places(hashed: Column, bits: int) -> list[Column]:
    """The places of a 64-bit hash in an array of 2 ** bits bits, at most 25."""
    return [F.shiftrightunsigned(hashed, shift).bitwiseAND(F.lit(2**bits - 1)) for shift in _SHIFTS]


def filter_bits(n_keys: int) -> int:
    """Beyond the largest size a filter lets more through; it never loses a key."""
    return min(max((BITS_PER_KEY * n_keys).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])


def may_be_key(wanted: DataFrame, key: str) -> Column:
    """Whether the ``key`` of a row may be among those of ``wanted``: always true for these, rarely for others.

    ``wanted`` is read twice, so it should be written somewhere.
    """
    hashes = wanted.select(F.xxhash64(key).alias("hashed")).distinct()
    bits = filter_bits(wanted.count())
    array = bit_array(hashes.select(F.explode(F.array(*probe_places(F.col("hashed"), bits))).alias("place")), bits)
    return reduce(and_, [is_set(array, place) for place in probe_places(F.xxhash64(key), bits)])


def keys_kept(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The ``rows`` whose key is among those of ``wanted``, and a few others; the rest is dropped at the scan."""
    return rows.filter(may_be_key(wanted, key))


def rows_of_keys(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``rows`` joined with ``keys`` on ``key``.

    Rows whose key is surely not wanted leave at the scan; the join decides about the rest, so the result is exact.
    ``keys`` is narrow: it is written to the shared folder, as its size decides the filter's.
    """
    wanted = written(keys)
    return keys_kept(rows, wanted, key).join(wanted, key)
