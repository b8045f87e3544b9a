"""The documents table: upsert by file name, and a store of parquet files.

A plain parquet table has no MERGE. The store appends each batch as its own
immutable folder and merges on read; ``compact`` writes the merged table as a new
base. Writing a batch therefore costs the batch, not the table, and repeating a
batch or a compaction replaces exactly the folder it wrote before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimsift.operators.ordering import row_numbers

DOCUMENT_SCHEMA = (
    "id bigint, file_name string, file_location string, raw_text string, "
    "cleaned_text string, classified_category string, confidence double, "
    "high_confidence_classes string, process_metadata string, ground_truth string"
)
OVERWRITTEN = [
    "raw_text", "cleaned_text", "classified_category", "confidence",
    "high_confidence_classes", "process_metadata",
]
PARTLY_OVERWRITTEN = ["raw_text", "cleaned_text", "classified_category", "confidence"]
BATCH_COLUMNS = ["file_name", "file_location", *OVERWRITTEN, "seq"]
_COLUMNS = [field.split()[0] for field in DOCUMENT_SCHEMA.split(", ")]


def new_ids(target: DataFrame, batch: DataFrame, last_id: Column | None = None) -> DataFrame:
    """(file_name, new_id) for names not in the target, in order of first arrival.

    Works on names and sequence numbers only. Ids follow ``last_id``, by default the target's highest.
    """
    arrived = batch.groupBy("file_name").agg(F.min("seq").alias("_first"))
    fresh = arrived.join(target.select("file_name"), "file_name", "left_anti")
    if last_id is None:
        last_id = target.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    return row_numbers(fresh, "_first", "_n").select(
        "file_name", (F.col("_n") + last_id).alias("new_id")
    )


def _merge(target: DataFrame, ids: DataFrame, source: DataFrame, values: dict[str, Column]):
    """Full outer join of the table and one row per batch file name.

    New ids are added to the batch side before the join, so the merged rows with their
    texts are not joined again.
    """
    source = source.join(ids, "file_name", "left")
    known = F.col("t.file_name").isNotNull()
    return (
        target.alias("t")
        .join(source.alias("s"), F.col("t.file_name") == F.col("s.file_name"), "full_outer")
        .select(
            F.coalesce("t.file_name", "s.file_name").alias("file_name"),
            F.coalesce(F.col("t.id"), F.col("s.new_id")).alias("id"),
            F.when(known, F.col("t.file_location"))
            .otherwise(F.col("s.file_location"))
            .alias("file_location"),
            *[
                values.get(c, F.col(f"t.{c}")).alias(c)
                for c in [*OVERWRITTEN, "ground_truth"]
            ],
        )
        .select(*_COLUMNS)
    )


def upsert_documents(target: DataFrame, batch: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """The table after the batch; ``ids`` gives (file_name, new_id) if they were taken before.

    Known names keep id, file_location and ground_truth and take everything else
    from the last batch row (highest ``seq``); new names are inserted with the
    location of their first row. The last row is picked with partial aggregation,
    so many copies of one name are one row per task before they move.
    """
    last = F.max_by(F.struct(*OVERWRITTEN), "seq").alias("last")
    source = batch.groupBy("file_name").agg(
        last, F.min_by("file_location", "seq").alias("file_location")
    )
    given = F.col("s.file_name").isNotNull()
    values = {
        c: F.when(given, F.col(f"s.last.{c}")).otherwise(F.col(f"t.{c}")) for c in OVERWRITTEN
    }
    return _merge(target, ids or new_ids(target, batch), source, values)


def partial_upsert_documents(target: DataFrame, batch: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """As :func:`upsert_documents`, but empty strings, 0.0 and NULL overwrite nothing.

    The first row's values matter only where no row has any, so its texts stay behind.
    """
    def filled(c: str) -> Column:
        empty = F.lit(0.0) if c == "confidence" else F.lit("")
        return F.col(c) != empty

    source = batch.groupBy("file_name").agg(
        F.min_by("file_location", "seq").alias("file_location"),
        F.min_by(F.struct(*[F.when(~filled(c), F.col(c)).alias(c) for c in PARTLY_OVERWRITTEN]), "seq").alias("first"),
        *[F.max_by(c, F.when(filled(c), F.col("seq"))).alias(c) for c in PARTLY_OVERWRITTEN],
    )
    known = F.col("t.file_name").isNotNull()
    values = {
        c: F.coalesce(
            F.col(f"s.{c}"), F.when(known, F.col(f"t.{c}")).otherwise(F.col(f"s.first.{c}"))
        )
        for c in PARTLY_OVERWRITTEN
    }
    return _merge(target, ids or new_ids(target, batch), source, values)


class DocumentStore:
    """Parquet folders ``base/upto=<batch>`` and ``delta/batch=<batch>`` under one path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _numbers(self, folder: str, key: str) -> list[int]:
        """Finished numbered sub-folders (those with a success marker)."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        root = hadoop.Path(f"{self.path}/{folder}")
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        return sorted(
            int(n.split("=")[1])
            for n in names
            if n.startswith(f"{key}=") and fs.exists(hadoop.Path(root, f"{n}/_SUCCESS"))
        )

    def append(self, batch: DataFrame, batch_id: int) -> None:
        """Write one batch; the same ``batch_id`` replaces its earlier attempt."""
        batch.select(*BATCH_COLUMNS).write.mode("overwrite").parquet(
            f"{self.path}/delta/batch={batch_id}"
        )

    def base(self) -> tuple[int, DataFrame]:
        versions = self._numbers("base", "upto")
        if not versions:
            return -1, self.spark.createDataFrame([], DOCUMENT_SCHEMA)
        return versions[-1], self.spark.read.schema(DOCUMENT_SCHEMA).parquet(
            f"{self.path}/base/upto={versions[-1]}"
        )

    def _pending(self, upto: int) -> list[int]:
        return [b for b in self._numbers("delta", "batch") if b > upto]

    def current(self) -> DataFrame:
        """The table as of now: the base merged with the batches after it."""
        upto, base = self.base()
        pending = self._pending(upto)
        if not pending:
            return base
        rows = self.spark.read.option("basePath", f"{self.path}/delta").parquet(
            *[f"{self.path}/delta/batch={b}" for b in pending]
        )
        # later batches win; one ordered number per row across batches
        span = F.lit(str(2**63)).cast("decimal(20,0)")
        seq = F.col("batch").cast("decimal(18,0)") * span + F.col("seq")
        return upsert_documents(base, rows.withColumn("seq", seq))

    def compact(self) -> None:
        """Write the merged table as the new base."""
        upto, _ = self.base()
        pending = self._pending(upto)
        if pending:
            self.current().write.mode("overwrite").parquet(
                f"{self.path}/base/upto={pending[-1]}"
            )
