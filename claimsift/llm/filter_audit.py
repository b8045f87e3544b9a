"""Interaction of corpus filters: what each filter removes, in every order in which the filters could run.

A document's failures are a mask of bits, one per filter, so a part of the corpus is a table of at most 2^n cells. The
subsets of filters are walked in Gray-code order: every move toggles one filter. Each cell counts how many active filters
it fails, and only cells whose counter leaves or reaches zero change the running survivors. The 2^n states are stored;
every step of every order is the difference of two of them.

The copy filter fails a document whose text stands under a smaller id anywhere in the table. Documents of equal text fail
the other filters alike, so copies are summed per text and part before the smallest id of a text is sought: no group of
copies is ever gathered, and texts themselves are not shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimsift.llm.common import cut

SPACES = r"[\x20\x09-\x0D]+"
#: Parts whose orders are written out in one Arrow batch.
PARTS_AT_ONCE = 64
MEASURES = ("n", "good", "toxic")


def text_filters(text: Column) -> dict[str, Column]:
    """Few words, repeated words, capitals, and marks of code or tables. ``text`` is not null."""
    words = F.array_remove(F.split(text, SPACES), "")
    capitals = F.octet_length(F.regexp_replace(text, "[^A-Z]+", "")).cast("bigint")
    return {
        "A": F.size(words) < 200,
        "B": F.size(F.array_distinct(words)) * F.lit(100).cast("bigint") < F.size(words) * F.lit(50).cast("bigint"),
        "C": capitals * 100 > F.char_length(text).cast("bigint") * 2,
        "D": text.rlike("[#$%&*|]"),
    }


def walk_states(cells: np.ndarray, n_filters: int) -> np.ndarray:
    """(..., 2^n): survivors of every subset of filters; ``cells`` holds counts by failure mask in its last dimension."""
    masks = np.arange(2**n_filters)
    failing = np.zeros(2**n_filters, np.int64)
    survivors = cells.sum(axis=-1)
    states = np.empty_like(cells)
    states[..., 0] = survivors
    active = 0
    for move in range(1, 2**n_filters):
        toggled = move & -move
        active ^= toggled
        fails = masks & toggled > 0
        if active & toggled:
            survivors = survivors - cells[..., fails & (failing == 0)].sum(axis=-1)
            failing[fails] += 1
        else:
            failing[fails] -= 1
            survivors = survivors + cells[..., fails & (failing == 0)].sum(axis=-1)
        states[..., active] = survivors
    return states


def order_rows(states: np.ndarray, letters: str) -> dict[str, np.ndarray]:
    """Columns of (parts, orders, steps) from states of (parts, measures, 2^n)."""
    n = len(letters)
    orders = np.array(list(permutations(range(n))))
    after = np.cumsum(1 << orders, axis=1)
    before = after - (1 << orders)
    lost = states[..., before] - states[..., after]
    everything = 2**n - 1
    single = 1 << np.arange(n)
    kept, removed = states[:, 0][:, after], lost[:, 0]
    failures = states[:, 0, [0]] - states[:, 0][:, single]
    unique = states[:, 0][:, everything ^ single] - states[:, 0, [everything]]
    shapley = np.zeros((len(states), n), np.int64)
    for k in range(n):
        shapley[:, k] = (removed * (orders == k)).sum(axis=(1, 2))
    return {
        "kept": kept, "removed": removed, "redundant": failures[:, orders] - removed, "unique_fails": unique[:, orders],
        "good_lost": lost[:, 1], "toxic_lost": lost[:, 2], "shapley": shapley[:, orders],
    }


def failure_cells(
    docs: DataFrame, id_col: str, part_col: str, text_col: str, labels: DataFrame, filters: Mapping[str, Column], letters: str, copy_letter: str,
) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the filters that they fail."""
    bit = {letter: 1 << k for k, letter in enumerate(letters)}
    mask = sum((F.when(failed, F.lit(bit[letter])).otherwise(F.lit(0)) for letter, failed in filters.items()), F.lit(0))
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = (
        docs.select(
            F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"),
            F.unhex(F.md5(text.cast("binary"))).alias("digest"), mask.alias("mask"),
        )
        .groupBy("id", "part", "digest", "mask")
        .agg(F.count("*").alias("n"))
    )
    rows = cut(rows)
    marks = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")
    )
    known = rows.filter("id IS NOT NULL").join(marks, F.col("id") == F.col("doc_id"), "left").select(
        "id", "part", "digest", "mask", "n",
        (F.col("n") * F.coalesce("good", F.lit(0))).alias("good"), (F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"),
    )
    measured = [F.sum(m).alias(m) for m in MEASURES]
    # per text and part: all its documents, and those of the smallest id
    copies = cut(
        known.groupBy("digest", "part", "mask").agg(*measured, F.min(F.struct("id", *MEASURES)).alias("first"))
    )
    least = copies.groupBy("digest").agg(F.min("first.id").alias("least"))
    is_first = F.col("first.id") == F.col("least")
    split = copies.join(least, "digest").select(
        "part", "mask", *MEASURES, *[F.when(is_first, F.col(f"first.{m}")).otherwise(F.lit(0)).alias(f"first_{m}") for m in MEASURES]
    )
    first = split.select("part", "mask", *[F.col(f"first_{m}").alias(m) for m in MEASURES])
    later = split.select("part", F.col("mask").bitwiseOR(F.lit(bit[copy_letter])).alias("mask"), *[(F.col(m) - F.col(f"first_{m}")).alias(m) for m in MEASURES])
    without_id = rows.filter("id IS NULL").select("part", "mask", "n", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    return first.unionByName(later).unionByName(without_id).groupBy("part", "mask").agg(*measured)


def audit_filters(
    docs: DataFrame, id_col: str, part_col: str, text_col: str, labels: DataFrame,
    filters: Mapping[str, Column] | None = None, copy_letter: str = "E",
) -> DataFrame:
    """One row per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    ``filters`` maps letters to boolean columns (true: fails; null: passes) of ``docs``; ``copy_letter`` names the filter
    of copies. ``labels`` has doc_id, quality and toxic; a document is good (toxic) if any of its label rows says 1, and
    neither without a label. Null part counts as the empty string, null text as the empty text. A null id has no smaller
    id and no label. Repeated rows of one id and text are counted each, and are no copies of each other. A part without
    failures has rows of zeros; an empty table has no parts and gives no rows. Other columns are not read.
    """
    if filters is None:
        filters = text_filters(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    letters = "".join(sorted([*filters, copy_letter]))
    n = len(letters)
    cells = failure_cells(docs, id_col, part_col, text_col, labels, filters, letters, copy_letter)
    # at most 2^n cells of a part
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", *MEASURES)).alias("cells"))
    names = ["".join(order) for order in permutations(letters)]
    counted = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows_of_part = len(names) * n
        for batch in batches:
            for start in range(0, len(batch), PARTS_AT_ONCE):
                some = batch.slice(start, PARTS_AT_ONCE)
                lists = some.column(1)
                flat = lists.flatten()
                owner = np.repeat(np.arange(len(some)), lists.value_lengths().to_numpy(zero_copy_only=False))
                mask, *counts = (c.to_numpy(zero_copy_only=False) for c in flat.flatten())
                grid = np.zeros((len(some), len(MEASURES), 2**n), np.int64)
                for k, values in enumerate(counts):
                    grid[owner, k, mask] = values
                columns = order_rows(walk_states(grid, n), letters)
                place = pa.array(np.repeat(np.arange(len(some)), rows_of_part))
                out = [
                    some.column(0).take(place),
                    pa.array(np.repeat(names, n).tolist() * len(some), pa.string()),
                    pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), len(names) * len(some))),
                    *[pa.array(columns[c].ravel()) for c in counted],
                ]
                yield pa.RecordBatch.from_arrays(out, names=["part", "filter_order", "step", *counted])

    return parts.mapInArrow(work, "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in counted))
