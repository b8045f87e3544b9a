"""What several operators share: reading tables, cutting lineage, working through Arrow batches."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that a task works on at once (a single longer text is worked on whole).
CHUNK_CHARS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; only a session without it (a local one) gets its own."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), "claimsift-checkpoints")
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder, without lineage; a lost executor costs nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def drop_cut(df: DataFrame) -> None:
    """Remove the files of a DataFrame that ``cut`` has returned. Nothing that reads it may be evaluated afterwards."""
    file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if file.isDefined():
        remove_folder(df.sparkSession, file.get())


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files that no DataFrame refers to any more, instead of some time later."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def crc_bucket(doc_id: Column, buckets: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % buckets).cast("int")


def chunks(lengths: Iterable[int], most: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` characters; every row is in exactly one."""
    start = size = 0
    end = 0
    for end, length in enumerate(lengths, 1):
        size += length
        if size >= most:
            yield start, end
            start, size = end, 0
    if end > start:
        yield start, end


def map_chunks(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, text: str) -> DataFrame:
    """Apply ``f`` to record batches whose ``text`` column stays near CHUNK_CHARS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.binary_length(batch.column(text)).fill_null(0).to_pylist()
            for start, end in chunks(sizes):
                out = f(batch.slice(start, end - start))
                if out is not None:
                    yield out

    return df.mapInArrow(run, schema)


def texts_of(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]
