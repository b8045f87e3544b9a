"""Line dedup over levelled sorted runs of line hashes.

Documents come in batches. The lines of a batch are hashed, counted per hash, and merge-joined with the runs written so
far: hashes that no run holds are fresh (the anti-join), the others repeat a known line. Then the batch adds its own
run. Runs are tables bucketed and sorted by hash, so a batch meets them without shuffling them again. When a level has
``fan_out`` runs they are merged into one run of the next level, so a batch meets few runs however many came before.

At the end only hashes that some row repeats, or that one batch already found often enough, are summed up over the runs;
lines met once never move again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimsift.llm.common import cut, new_folder, remove_folder, shared_folder

#: White space that is stripped from a line's ends.
STRIPPED = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(STRIPPED)), UPPER, LOWER)


class LineRuns:
    """Runs of (h1, h2, n_docs, top_id, fresh): how many documents of the run's batches hold a line, and the largest."""

    def __init__(self, spark: SparkSession, fan_out: int = 3):
        self.spark = spark
        self.fan_out = fan_out
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.folder = new_folder(spark, "line-runs")
        self.levels: list[list[str]] = []

    def names(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def _write(self, rows: DataFrame, level: int) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        writer = rows.write.format("parquet").bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2")
        writer.option("path", f"{self.folder}/{name}").saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def add(self, lines: DataFrame) -> str:
        """Take the lines (h1, h2, doc_id) of documents that no earlier batch held; the name of the new run."""
        counted = (
            lines.groupBy("h1", "h2", "doc_id").agg(F.lit(True))  # a line counts once for a document
            .groupBy("h1", "h2")
            .agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("top_id"))
        )
        known = F.lit(False)
        for k, name in enumerate(self.names()):
            run = self.spark.table(name).select("h1", "h2", F.lit(True).alias(f"in_{k}"))
            counted = counted.join(run, ["h1", "h2"], "left")
            known = known | F.coalesce(f"in_{k}", F.lit(False))
        self._write(counted.select("h1", "h2", "n_docs", "top_id", (~known).alias("fresh")), 0)
        added = self.levels[0][-1]
        level = 0
        while len(self.levels[level]) >= self.fan_out:
            self._compact(level)
            level += 1
        return added

    def _compact(self, level: int) -> None:
        merged, self.levels[level] = self.levels[level], []
        self._write(self._summed(self._rows(merged)).select("h1", "h2", "n_docs", "top_id", "fresh"), level + 1)
        for name in merged:
            self._drop(name)

    def _rows(self, names: list[str]) -> DataFrame:
        rows = self.spark.table(names[0])
        for name in names[1:]:
            rows = rows.unionByName(self.spark.table(name))
        return rows

    @staticmethod
    def _summed(rows: DataFrame) -> DataFrame:
        return rows.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("top_id").alias("top_id"), F.bool_or("fresh").alias("fresh"))

    def repeated(self, min_docs: int) -> DataFrame:
        """(h1, h2, top_id) of lines that at least ``min_docs`` documents hold."""
        rows = self._rows(self.names())
        wanted = rows.filter((~F.col("fresh")) | (F.col("n_docs") >= min_docs)).select("h1", "h2").distinct()
        return self._summed(rows.join(wanted, ["h1", "h2"], "left_semi")).filter(F.col("n_docs") >= min_docs).select("h1", "h2", "top_id")

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove_folder(self.spark, f"{self.folder}/{name}")

    def drop(self) -> None:
        for name in self.names():
            self._drop(name)
        remove_folder(self.spark, self.folder)
        self.levels = []


def dedup_lines(
    docs: DataFrame, id_col: str, text_col: str, min_chars: int = 20, min_docs: int = 3, batches: int = 4, report_col: str = "lines"
) -> DataFrame:
    """``docs`` with repeated lines removed from the text, and a struct ``report_col`` (n_lines, n_dropped).

    Lines of at least ``min_chars`` code points (stripped) that at least ``min_docs`` documents hold stay only in the
    largest id holding them. Null or empty text is one empty line. All rows with one id are one document, rows with a
    null id together are one document below all others. Repeated rows are treated alike and stay. An empty table gives
    an empty table. Other columns pass through whatever their names; a column named like the report is replaced.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    packed = docs.select(
        F.struct("*").alias("row"), F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash")
    )
    key = F.col("key")
    lines = (
        packed.select("doc_id", "text_hash", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
        .select("doc_id", "text_hash", "line_no", line_key(F.col("line")).alias("key"))
        .filter(F.char_length(key) >= min_chars)
        .select("doc_id", "text_hash", "line_no", F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2"))
        .withColumn("batch", F.pmod(F.xxhash64(F.lit("batch"), "doc_id"), F.lit(batches)).cast("int"))
    )
    folder = new_folder(spark, "lines")
    lines.write.parquet(folder)
    lines = spark.read.schema(lines.schema).parquet(folder)
    runs = LineRuns(spark)
    for batch in range(batches):
        runs.add(lines.filter(F.col("batch") == batch).select("h1", "h2", "doc_id"))
    below = F.coalesce(F.col("doc_id") < F.col("top_id"), F.col("doc_id").isNull() & F.col("top_id").isNotNull())
    dropped = (
        lines.join(cut(runs.repeated(min_docs)), ["h1", "h2"])  # cut: both sides are shuffled for the join, so a hot line is split
        .filter(below)
        .groupBy(F.col("doc_id").alias("drop_id"), F.col("text_hash").alias("drop_hash"))
        .agg(F.sort_array(F.collect_set("line_no")).alias("dropped"))
    )
    dropped = cut(dropped)
    runs.drop()
    remove_folder(spark, folder)

    joined = packed.join(dropped, (F.col("text_hash") == F.col("drop_hash")) & F.col("doc_id").eqNullSafe(F.col("drop_id")), "left")
    split = joined.select("row", F.split("text", "\n").alias("all"), F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"))
    # the kept lines are the stretches between dropped ones
    bounds = split.withColumn("bounds", F.concat(F.array(F.lit(-1)), "dropped", F.array(F.size("all"))))
    stretches = F.transform(
        F.sequence(F.lit(0), F.size("dropped")),
        lambda k: F.slice("all", F.get("bounds", k) + 2, F.get("bounds", k + 1) - F.get("bounds", k) - 1),
    )
    kept = F.when(F.size("dropped") == 0, F.array_join("all", "\n")).otherwise(F.array_join(F.flatten(stretches), "\n"))
    report = F.struct(F.size("all").cast("bigint").alias("n_lines"), F.size("dropped").cast("bigint").alias("n_dropped"))
    columns = [
        kept.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != report_col or c == text_col
    ]
    return bounds.select(*columns, report.alias(report_col))
