"""Time and cost reports from the JSON processing metadata of stored documents."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Sequence
from functools import reduce, wraps

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from claimsift.fixed_values import STAGES
from claimsift.operators.ordering import exact_quantiles, running_totals

log = logging.getLogger(__name__)

SECONDS = "decimal(24,9)"
MONEY = "decimal(18,8)"
STAGE_COLUMNS = {stage: stage.lower().replace(" ", "_") for stage in STAGES}


def process_metadata(seconds: dict[str, Column], cost: Column) -> Column:
    """Metadata JSON from the seconds per stage and the classification cost."""
    stages = []
    for stage in STAGES:
        fields = [seconds[stage].alias("time")]
        if stage == "Classification":
            fields.append(cost.alias("cost"))
        stages.append(F.struct(*fields).alias(stage))
    return F.to_json(F.struct(*stages))


def stage_times(docs: DataFrame, metadata: str = "process_metadata") -> DataFrame:
    """(id, seconds per stage); a missing stage or time is 0, a time that is no number is NULL.

    A row is left out if its metadata, or a stage that is there, is no object.
    """
    fields = "map<string,variant>"
    parsed = docs.select("id", F.try_variant_get(F.try_parse_json(metadata), "$", fields).alias("_m"))
    parsed = parsed.filter("_m IS NOT NULL")
    objects = {c: F.try_variant_get(F.try_element_at("_m", F.lit(s)), "$", fields) for s, c in STAGE_COLUMNS.items()}
    rows = parsed.select("id", "_m", *[o.alias(f"_{c}") for c, o in objects.items()])
    readable = reduce(
        lambda a, b: a & b,
        [~F.map_contains_key("_m", F.lit(s)) | F.col(f"_{c}").isNotNull() for s, c in STAGE_COLUMNS.items()],
    )
    times = [
        F.when(
            F.coalesce(F.map_contains_key(f"_{c}", F.lit("time")), F.lit(False)),
            F.try_variant_get(F.try_element_at(f"_{c}", F.lit("time")), "$", SECONDS),
        )
        .otherwise(F.lit(0).cast(SECONDS))
        .alias(c)
        for c in STAGE_COLUMNS.values()
    ]
    return rows.filter(readable).select("id", *times)


def _by_stage(times: DataFrame) -> DataFrame:
    """(stage, seconds), one row per document and stage."""
    rows = F.array(
        *[F.struct(F.lit(s).alias("stage"), F.col(c).alias("seconds")) for s, c in STAGE_COLUMNS.items()]
    )
    return times.select(F.explode(rows).alias("r")).select("r.*")


def stage_time_box(times: DataFrame, rule: str = "hazen") -> DataFrame:
    """(stage, low, q1, median, q3, high), exact."""
    names = {0.0: "low", 0.25: "q1", 0.5: "median", 0.75: "q3", 1.0: "high"}
    quantiles = exact_quantiles(_by_stage(times), "seconds", "stage", list(names), rule)
    return quantiles.groupBy("stage").agg(
        *[F.max(F.when(F.col("probability") == p, F.col("quantile"))).alias(n) for p, n in names.items()]
    )


def stage_time_averages(times: DataFrame) -> DataFrame:
    """(stage, average) of the times that are numbers; sums are decimal, so the order of rows does not matter."""
    sums = times.agg(
        *[F.count(c).alias(f"_n_{c}") for c in STAGE_COLUMNS.values()],
        *[F.sum(c).cast("double").alias(c) for c in STAGE_COLUMNS.values()],
    )
    rows = F.array(
        *[
            F.struct(F.lit(s).alias("stage"), F.try_divide(F.col(c), F.col(f"_n_{c}")).alias("average"))
            for s, c in STAGE_COLUMNS.items()
        ]
    )
    return sums.select(F.explode(rows).alias("r")).select("r.*")


def cumulative_stage_times(times: DataFrame, slices: int | None = None) -> DataFrame:
    """(id, running total per stage) in id order, without a one-task window.

    A time that is NULL adds nothing and leaves its own total NULL.
    """
    totals = {f"{c}_total": F.coalesce(F.col(c), F.lit(0).cast(SECONDS)) for c in STAGE_COLUMNS.values()}
    return running_totals(times, "id", totals, slices=slices).select(
        "id", *[F.when(F.col(c).isNotNull(), F.col(f"{c}_total")).alias(f"{c}_total") for c in STAGE_COLUMNS.values()]
    )


def high_confidence_map(stored: Column) -> Column:
    """The stored JSON object label -> confidence as a map; NULL, empty or unreadable gives an empty map."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(stored), "$", "map<string,double>"), F.map_from_entries(F.array().cast("array<struct<k:string,v:double>>")))


def document_costs(docs: DataFrame, metadata: str = "process_metadata") -> DataFrame:
    """(id, cost); every row counts, a missing or unreadable cost is 0."""
    cost = F.try_variant_get("_v", '$["Classification"].cost', MONEY)
    return docs.select("id", F.try_parse_json(metadata).alias("_v")).select(
        "id", F.coalesce(cost, F.lit(0).cast(MONEY)).alias("cost")
    )


def cost_summary(costs: DataFrame) -> DataFrame:
    """(documents, total_cost, average_cost), 0 when there are no rows."""
    return costs.agg(
        F.count("*").alias("documents"), F.sum("cost").cast("double").alias("t")
    ).select(
        "documents",
        F.coalesce("t", F.lit(0.0)).alias("total_cost"),
        F.coalesce(F.try_divide("t", "documents"), F.lit(0.0)).alias("average_cost"),
    )


def cost_histogram(costs: DataFrame, bin_width: str = "0.0001") -> DataFrame:
    """(bin, low, high, documents) over bins of fixed width; empty bins are left out."""
    width = F.lit(bin_width).cast(MONEY)
    place = F.floor(F.col("cost") / width).cast("bigint")
    edge = lambda c: (c * width).cast("double")
    return (
        costs.groupBy(place.alias("bin"))
        .agg(F.count("*").alias("documents"))
        .select("bin", edge(F.col("bin")).alias("low"), edge(F.col("bin") + 1).alias("high"), "documents")
    )


def timed(func: Callable) -> Callable:
    """Call and return (result, seconds); errors pass through and log nothing."""

    @wraps(func)
    def call(*args, **kwargs):
        start = time.perf_counter()
        result = func(*args, **kwargs)
        seconds = time.perf_counter() - start
        log.info("%s took %.2f seconds", func.__name__, seconds)
        return result, seconds

    return call


@timed
def _run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def observe_stages(
    spark: SparkSession, stages: Sequence[tuple[str, DataFrame, str]]
) -> DataFrame:
    """Run each (name, DataFrame, text column) once: (stage, seconds, documents, characters).

    Row and character counts come out of the run itself, not from a second scan.
    """
    rows = []
    for name, df, text in stages:
        seen = Observation(name)
        watched = df.observe(
            seen, F.count(F.lit(1)).alias("documents"), F.sum(F.length(text)).alias("characters")
        )
        _, seconds = _run(watched)
        rows.append((name, seconds, seen.get["documents"], seen.get["characters"]))
    return spark.createDataFrame(
        rows, "stage string, seconds double, documents bigint, characters bigint"
    )
