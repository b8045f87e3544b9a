"""Micro-batches with dead letters and a log of their stages.

Every micro-batch runs through its stages once. A stage may reject rows; they leave with their reason, and only good rows go
on. What comes out feeds two sinks, good rows the store and rejected ones the dead letters; what every stage did is a third
table. All three are keyed by the batch id: a replayed batch replaces exactly what it wrote before, so a failure between
the sinks leaves nothing twice and nothing out.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from claimsift.fixed_values import UNKNOWN
from claimsift.operators.cleaning import clean_documents
from claimsift.sources.files import Extractor
from claimsift.streaming.ingest import classify_batch

DEAD_LETTERS = "file_name string, file_location string, seq bigint, stage string, reason string"
STAGE_LOG = "stage string, place int, documents bigint, rejected bigint, characters bigint, seconds double"
#: The column in which a stage says why it rejects a row; null in good rows.
REASON = "_reason"

#: Name, rows in, rows out with REASON, and the text column whose characters are logged.
Stage = tuple[str, Callable[[DataFrame], DataFrame], str]


def rejected_if(rows: DataFrame, *reasons: tuple[Column, str]) -> DataFrame:
    """Rows with the first reason whose condition holds."""
    found = F.lit(None).cast("string")
    for condition, reason in reversed(reasons):
        found = F.when(condition, F.lit(reason)).otherwise(found)
    return rows.withColumn(REASON, found)


def extract_or_reject(extractor: Extractor) -> Callable[[DataFrame], DataFrame]:
    """A stage that turns ``content`` into ``raw_text``; a file that the extractor fails on is rejected, not the batch."""

    def stage(rows: DataFrame) -> DataFrame:
        kept = [c for c in rows.columns if c not in ("content", "raw_text")]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                texts, reasons = [], []
                for content in batch["content"]:
                    try:
                        texts.append(None if content is None else extractor(bytes(content)))
                        reasons.append("no content" if content is None else None)
                    except Exception as error:  # whatever a library raises about one file
                        texts.append(None)
                        reasons.append(f"extraction failed: {type(error).__name__}")
                yield batch[kept].assign(**{"raw_text": pd.Series(texts, dtype=object, index=batch.index), REASON: pd.Series(reasons, dtype=object, index=batch.index)})

        schema = ", ".join(f"`{c}` {kind}" for c, kind in rows.dtypes if c in kept)
        return rows.select(*kept, "content").mapInPandas(run, f"{schema}, raw_text string, {REASON} string")

    return stage


def check_text(rows: DataFrame) -> DataFrame:
    text = F.col("raw_text")
    return rejected_if(rows, (F.col("file_name").isNull(), "no file name"), (text.isNull(), "no text"), (F.trim(text) == "", "blank text"))


def clean(rows: DataFrame) -> DataFrame:
    return rejected_if(clean_documents(rows), (F.col("cleaned_text") == "", "nothing left after cleaning"))


def classify(rows: DataFrame) -> DataFrame:
    """Store rows; documents that no rule knows are rejected."""
    return rejected_if(classify_batch(rows), (F.col("classified_category") == UNKNOWN, "no class"))


STAGES: list[Stage] = [("Text", check_text, "raw_text"), ("Text Cleaning", clean, "cleaned_text"), ("Classification", classify, "cleaned_text")]


class BatchSinks:
    """Dead letters and stage log under one path, a sub-folder for each batch."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _hadoop(self, path: str):
        jpath = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return jpath, jpath.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def remove(self, path: str) -> None:
        jpath, fs = self._hadoop(path)
        fs.delete(jpath, True)

    def write(self, rows: DataFrame, name: str, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch_id}")

    def _read(self, name: str, schema: str) -> DataFrame:
        folder, schema = f"{self.path}/{name}", f"{schema}, batch bigint"
        jpath, fs = self._hadoop(folder)
        if not fs.exists(jpath):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", folder).parquet(folder)

    def dead_letters(self) -> DataFrame:
        return self._read("dead_letters", DEAD_LETTERS)

    def stage_log(self) -> DataFrame:
        return self._read("stage_log", STAGE_LOG)


def run_batch(batch: DataFrame, batch_id: int, store, sinks: BatchSinks, stages: Sequence[Stage] = STAGES) -> None:
    """One batch of (file_name, file_location, seq and what the first stage reads) through all stages into three sinks.

    Every stage is written once, as the next one and the dead letters read it; its rows and characters are observed in
    that very job, so nothing is scanned to be counted.
    """
    spark = batch.sparkSession
    work = f"{sinks.path}/work/batch={batch_id}"
    rows, rejected, log = batch, [], []
    for place, (name, stage, text) in enumerate(stages):
        start = time.perf_counter()
        after = stage(rows)
        good = F.col(REASON).isNull()
        seen = Observation(f"{name} of batch {batch_id}")
        watched = after.observe(
            seen, F.count(F.lit(1)).alias("documents"), F.count_if(~good).alias("rejected"),
            F.coalesce(F.sum(F.when(good, F.length(text))), F.lit(0)).alias("characters"),
        )
        watched.write.mode("overwrite").parquet(f"{work}/{place}")
        done = spark.read.schema(after.schema).parquet(f"{work}/{place}")
        counts = seen.get
        log.append((name, place, counts["documents"], counts["rejected"], counts["characters"], time.perf_counter() - start))
        rejected.append(
            done.filter(~good).select("file_name", "file_location", F.col("seq").cast("bigint").alias("seq"), F.lit(name).alias("stage"), F.col(REASON).alias("reason"))
        )
        rows = done.filter(good).drop(REASON)
    store.append(rows, batch_id)
    sinks.write(reduce(DataFrame.unionByName, rejected), "dead_letters", batch_id)
    sinks.write(spark.createDataFrame(log, STAGE_LOG), "stage_log", batch_id)
    sinks.remove(work)


def ingest_batches(stream: DataFrame, store, sinks: BatchSinks, checkpoint: str, stages: Sequence[Stage] = STAGES):
    """Start a query that takes every micro-batch through :func:`run_batch`."""
    return (
        stream.writeStream.foreachBatch(lambda batch, batch_id: run_batch(batch, batch_id, store, sinks, stages))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
