"""The documents table at rest in parts by file name; an upsert rewrites only the parts that its batch touches.

The table is partitioned by a hash of the file name and bucketed by the file name inside. A batch is shuffled to the
buckets once; the stored rows of the touched parts are read where they are and joined without an exchange, so no stored
text ever moves. The job has a branch for every few parts, so that a task sorts a bucket of these, not of the whole table.
Spark's dynamic partition overwrite replaces the touched parts; the files of all others stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimsift.sources.store import BATCH_COLUMNS, DOCUMENT_SCHEMA, new_ids, upsert_documents

_COLUMNS = [field.split()[0] for field in DOCUMENT_SCHEMA.split(", ")]
#: Codec of the files.
_CODEC = "zstd"


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {name: spark.conf.get(name, None) for name in values}
    try:
        for name, value in values.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


class PartitionedStore:
    """A parquet table under ``path`` of ``parts`` partitions with ``buckets`` buckets each, both fixed when it is made.

    A task merges about ``task_bytes`` of files, down to one bucket of one part.
    """

    def __init__(self, spark: SparkSession, path: str, parts: int = 16, buckets: int = 8, task_bytes: int = 32 << 20):
        self.spark, self.path, self.parts, self.buckets, self.task_bytes = spark, path.rstrip("/"), parts, buckets, task_bytes
        self.table = f"documents_{hashlib.md5(self.path.encode()).hexdigest()[:16]}"
        location = f"{self.path}/table".replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} ({DOCUMENT_SCHEMA}, name_part int) USING parquet OPTIONS (compression '{_CODEC}') "
            f"PARTITIONED BY (name_part) CLUSTERED BY (file_name) SORTED BY (file_name) INTO {buckets} BUCKETS LOCATION '{location}'"
        )

    def load(self, documents: DataFrame) -> None:
        """Replace the whole table by ``documents``, with their ids. Their texts are shuffled to the buckets this once.

        A task gets a few buckets of single parts, so that sorting them does not spill.
        """
        rows = documents.select(*_COLUMNS, self._part())
        bucket = F.pmod(F.hash("file_name"), F.lit(self.buckets))  # as Spark assigns buckets
        rows.repartition(self.parts * self.buckets, "name_part", bucket).write.mode("overwrite").insertInto(self.table)

    def _part(self) -> Column:
        return F.pmod(F.xxhash64("file_name"), F.lit(self.parts)).cast("int").alias("name_part")

    def _stored(self, spark: SparkSession) -> DataFrame:
        spark.catalog.refreshTable(self.table)
        return spark.table(self.table)

    def current(self) -> DataFrame:
        """The table as of now; nothing is merged on read."""
        return self._stored(self.spark).select(*_COLUMNS)

    def _bytes(self, folder: str) -> int:
        """Size of the files below a folder of the store; 0 if there is none."""
        jpath = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        fs = jpath.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return fs.getContentSummary(jpath).getLength() if fs.exists(jpath) else 0

    def _finished(self, path: str) -> bool:
        jpath = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return jpath.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath)

    def _ids(self, stored: DataFrame, touched: DataFrame, batch: DataFrame, batch_id: int) -> DataFrame:
        """New ids of the batch. They are kept, so a repeated batch gives the same ids whatever it had already stored."""
        path = f"{self.path}/ids/batch={batch_id}"
        if not self._finished(path):
            ids = new_ids(touched, batch, stored.agg(F.coalesce(F.max("id"), F.lit(0))).scalar())
            ids.withColumn("name_part", self._part()).write.mode("overwrite").partitionBy("name_part").parquet(path)
        return batch.sparkSession.read.schema("file_name string, new_id bigint, name_part int").parquet(path)

    def merged(
        self, batch: DataFrame, batch_id: int, merge: Callable[..., DataFrame] = upsert_documents
    ) -> DataFrame | None:
        """The touched parts after the batch, with their ``name_part``; None if the batch is empty.

        A batch with a ``name_part`` column is read by it.
        """
        if "name_part" not in batch.columns:
            batch = batch.withColumn("name_part", self._part())
        parts = sorted(r[0] for r in batch.select("name_part").distinct().collect())  # at most the number of parts
        if not parts:
            return None
        stored = self._stored(batch.sparkSession)
        touched = stored.filter(F.col("name_part").isin(parts))
        ids = self._ids(stored, touched, batch, batch_id)

        def of_parts(some: list[int]) -> DataFrame:
            target, rows, new = (df.filter(F.col("name_part").isin(some)).drop("name_part") for df in (touched, batch, ids))
            return merge(target, rows, new).select(*_COLUMNS, self._part())

        size = self._bytes("table") + self._bytes(f"batches/batch={batch_id}")
        branches = min(size // (self.buckets * self.task_bytes) + 1, len(parts))
        return reduce(DataFrame.union, [of_parts(parts[k::branches]) for k in range(branches)])

    def replace_parts(self, rows: DataFrame) -> None:
        """Write ``rows`` in place of the parts that they belong to; the files of other parts stay.

        Shuffles have as many partitions as there are buckets, so that what is grouped by name is not shuffled again to
        meet the stored rows.
        """
        values = {"spark.sql.sources.partitionOverwriteMode": "dynamic", "spark.sql.shuffle.partitions": str(self.buckets)}
        with _settings(rows.sparkSession, values):
            rows.write.mode("overwrite").insertInto(self.table)

    def append(self, batch: DataFrame, batch_id: int, merge: Callable[..., DataFrame] = upsert_documents) -> None:
        """Upsert one batch. Repeating the latest batch, also one that was cut off while it was stored, changes nothing.

        The batch is written first, by parts, as it is read several times.
        """
        folder = f"{self.path}/batches/batch={batch_id}"
        rows = batch.select(*BATCH_COLUMNS, self._part())
        rows.write.mode("overwrite").option("compression", _CODEC).partitionBy("name_part").parquet(folder)
        merged = self.merged(batch.sparkSession.read.schema(rows.schema).parquet(folder), batch_id, merge)
        if merged is not None:
            self.replace_parts(merged)
        jpath = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        jpath.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)
