"""Ordered work over whole tables without a one-task window.

A window ordered over everything runs in one task. Here the order column is cut
into slices of about equal row count (approximate quantiles, so uneven ids do no
harm), each slice is summed, and the sums of the earlier slices are added to a
window inside the slice. Results are exact; the quantiles only place the cuts.
The number of cuts is a parameter, so nothing that is broadcast depends on the
data or on the number of groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimsift.functions.plan_shape import settled, written


def _slice_count(df: DataFrame, slices: int | None) -> int:
    if slices:
        return slices
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def running_totals(
    df: DataFrame,
    order: str,
    measures: dict[str, Column],
    by: Sequence[str] = (),
    slices: int | None = None,
) -> DataFrame:
    """Add ``name`` = running total of each measure up to and including the row.

    ``order`` must be numeric and unique within ``by``; a NULL group is a group. The
    rows are written to the shared folder once, as they are read three times: for
    the cuts, for the sums of the slices and for the totals.
    """
    columns, names, by = df.columns, list(measures), list(by)
    slices = _slice_count(df, slices)
    rows = written(df.select("*", *[measures[n].alias(f"_m_{n}") for n in names]))
    cuts = [i / slices for i in range(1, slices)]
    found = rows.agg(F.percentile_approx(order, cuts, F.lit(max(10_000, 10 * slices)))).first()[0]
    bounds = F.array(*[F.lit(x) for x in dict.fromkeys(found or [])]).cast(f"array<{dict(rows.dtypes)[order]}>")
    position = F.col(order)
    # settled, or the optimizer infers a filter on the slices of the other side of the join from the projected expression. It
    # drops such a filter for naming a column that side lacks, but takes a session's second column for the lambda's variable
    sliced = settled(rows, rows.columns, F.size(F.filter(bounds, lambda b: b < position)).alias("_slice"))

    per_slice = sliced.groupBy(*by, "_slice").agg(
        *[F.sum(f"_m_{n}").alias(f"_s_{n}") for n in names]
    )
    # at most `slices` rows per group: small enough for one ordered window
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = per_slice.select(
        *[F.col(c).alias(f"_by_{k}") for k, c in enumerate(by)],
        F.col("_slice").alias("_in"),
        *[F.sum(f"_s_{n}").over(before).alias(f"_o_{n}") for n in names],
    )
    if not by:
        offsets = F.broadcast(offsets)  # one row for each slice
    inside = Window.partitionBy(*by, "_slice").orderBy(order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    same = F.col("_slice") == F.col("_in")
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{k}"))
    return sliced.join(offsets, same).select(
        *[F.col(c) for c in columns],
        *[
            (F.sum(f"_m_{n}").over(inside) + F.coalesce(F.col(f"_o_{n}"), F.lit(0))).alias(n)
            for n in names
        ],
    )


def row_numbers(df: DataFrame, order: str, name: str, slices: int | None = None) -> DataFrame:
    """Number rows 1..n by a unique numeric ``order`` column."""
    return running_totals(df, order, {name: F.lit(1).cast("bigint")}, slices=slices)


def positional_slice(
    df: DataFrame, key: str, start: int = 0, stop: int | None = None
) -> DataFrame:
    """Rows ``[start:stop]`` in order of the unique column ``key``.

    An open end is answered with the key at position ``start`` and a plain filter,
    so the remainder is never sorted and no task gathers the rows before it.
    """
    if stop is not None:
        return df.orderBy(key).limit(stop).offset(start)
    if start == 0:
        return df
    numbered = row_numbers(df.select(key), key, "_n")
    cut = numbered.filter(F.col("_n") == start).agg(F.max(key).alias("cut")).scalar()
    return df.filter(F.col(key) > cut)


def exact_quantiles(
    df: DataFrame,
    value: str,
    by: str,
    probabilities: Sequence[float],
    rule: str = "hazen",
) -> DataFrame:
    """Exact interpolated quantiles of ``value`` per group: (by, probability, quantile).

    Equal values are counted first, so the ordered part works on distinct values
    only, in slices. ``hazen`` places p at p*n-1/2 (the rule box charts use),
    ``linear`` at p*(n-1).
    """
    if rule not in ("hazen", "linear"):
        raise ValueError(f"unknown quantile rule {rule!r}")
    counts = written(
        df.filter(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("_n"))
    )
    ranked = running_totals(counts, value, {"_upto": F.col("_n")}, by=[by])
    n = F.col("_total")
    wanted = F.transform(
        F.array(*[F.lit(float(p)) for p in probabilities]),
        lambda p: F.struct(
            p.alias("probability"),
            F.greatest(
                F.lit(0.0),
                F.least(n - 1.0, p * n - 0.5 if rule == "hazen" else p * (n - 1.0)),
            ).alias("place"),
        ),
    )
    # groups x probabilities rows
    targets = (
        counts.groupBy(by)
        .agg(F.sum("_n").cast("double").alias("_total"))
        .select(by, F.explode(wanted).alias("w"))
        .select(
            by,
            "w.probability",
            "w.place",
            F.floor("w.place").alias("_lo"),
            F.ceil("w.place").alias("_hi"),
        )
    )
    first = F.col("_upto") - F.col("_n")
    covers = (first <= F.col("_hi")) & (F.col("_upto") > F.col("_lo"))
    at = lambda place: (first <= F.col(place)) & (F.col("_upto") > F.col(place))
    picked = (
        ranked.alias("r")
        .join(targets.withColumnRenamed(by, "_by"), F.col(by).eqNullSafe(F.col("_by")))
        .filter(covers)
        .groupBy(by, "probability", "place", "_lo")
        .agg(
            F.max(F.when(at("_lo"), F.col(value))).cast("double").alias("_low"),
            F.max(F.when(at("_hi"), F.col(value))).cast("double").alias("_high"),
        )
    )
    share = F.col("place") - F.col("_lo")
    return picked.select(
        by,
        "probability",
        (F.col("_low") * (1.0 - share) + F.col("_high") * share).alias("quantile"),
    )
