"""From raw documents to token counts: five stages, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of docs, whatever further columns there are.

Null and empty texts: the language stage rejects them (they have no letter). Repeated rows of one id are equal in every
stage; the near-duplicate stage keeps one of them, the smallest of rows that differ in other columns. An empty table stays
empty through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimsift.llm.byte_bpe import bpe_round_trip
from claimsift.llm.common import new_folder, remove_folder, table
from claimsift.llm.decontaminate import contaminated
from claimsift.llm.language import UNDETERMINED, UNIFORM_BITS, fit, identify
from claimsift.llm.line_runs import dedup_lines
from claimsift.llm.queries import RANKS
from claimsift.llm.simhash import simhash_groups


def _beside(docs: DataFrame) -> DataFrame:
    """(row, key, text): rows as one struct, so that no name in them can clash with a name of ours.

    The key is the id with a hash of the text: rows with a null id are different documents if their texts differ. Keys
    are ordered as ids, null ids last.
    """
    key = F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("text_hash"))
    return docs.select(F.struct("*").alias("row"), key.alias("key"), F.col("text").alias("text"))


def _like(docs: DataFrame, changed: dict) -> list:
    """The columns of docs, some of them changed, in their types."""
    return [changed.get(c, F.col(f"`{c}`")).cast(kind).alias(c) for c, kind in docs.dtypes]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter, and texts that every learned language codes worse than no model would.

    A document without a language gets the predicted one.
    """
    tree = fit(docs, "doc_id", "text", "lang")
    marked = _beside(docs).withColumn("found", identify(docs, F.col("text"), tree))
    kept = marked.filter((F.col("found.lang_pred") != UNDETERMINED) & (F.col("found.bits_per_byte") <= UNIFORM_BITS))
    known = F.coalesce(F.col("row.lang"), F.col("found.lang_pred"))
    return kept.select(*[(known if c == "lang" else F.col(f"row.`{c}`")).cast(kind).alias(c) for c, kind in docs.dtypes])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated lines; n_chars follows the text."""
    report = "__report"
    while report in docs.columns:
        report += "_"
    deduped = dedup_lines(docs, "doc_id", "text", report_col=report)
    return deduped.select(*_like(docs, {"n_chars": F.char_length("text")}))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest id, and of its repeated rows one."""
    rows = _beside(docs)
    groups = simhash_groups(rows, "key", "text")
    kept = groups.filter(F.col("key").eqNullSafe(F.col("component_id"))).groupBy(F.col("key").alias("kept")).agg(F.count("*").alias("copies"))
    found = rows.join(kept, F.col("key").eqNullSafe(F.col("kept")))
    if kept.filter("copies > 1").isEmpty():
        return found.select("row.*")
    return found.groupBy("key").agg(F.min("row").alias("row")).select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go."""
    rows = _beside(docs)
    found = contaminated(rows, "key", "text", table(spark, sf_dir, "benchmark"), "item_id", "text", shortest=1)
    gone = found.select(F.col("doc_id").alias("gone")).distinct()
    return rows.join(gone, F.col("key").eqNullSafe(F.col("gone")), "left_anti").select("row.*")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_round_trip(docs, "doc_id", "text", public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("language ID", language),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE", encoding),
]

#: The language model and the merges have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = new_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        rows = stage(spark, docs, sf_dir)
        rows.write.parquet(f"{folder}/{k}")
        if k:
            remove_folder(spark, f"{folder}/{k - 1}")
        docs = spark.read.schema(rows.schema).parquet(f"{folder}/{k}")
    return docs
