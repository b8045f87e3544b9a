"""Ingest: document files -> text -> clean -> classify -> metadata -> store, as a batch or as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimsift.fixed_values import UNKNOWN
from claimsift.operators.cleaning import clean_documents
from claimsift.operators.reporting import process_metadata
from claimsift.operators.rules import classify_by_rules
from claimsift.sources.files import file_name
from claimsift.sources.store import DocumentStore

# stage -> input column with its seconds
_SECONDS = {"OCR": "ocr_seconds", "Text Cleaning": "cleaning_seconds", "Classification": "classification_seconds"}


def classify_batch(docs: DataFrame) -> DataFrame:
    """Clean and classify (file_name, file_location, raw_text, seq) into store rows.

    Seconds per stage are taken from ``ocr_seconds``, ``cleaning_seconds`` and ``classification_seconds``
    and the cost from ``cost`` where the input has them (an extractor or a responder measures them), else 0.
    The high-confidence classes of the rules are the predicted class with its share.
    """
    measured = {c: F.col(c) if c in docs.columns else F.lit(0.0) for c in (*_SECONDS.values(), "cost")}
    docs = docs.select("file_name", "file_location", "raw_text", "seq", *[x.cast("double").alias(c) for c, x in measured.items()])
    cleaned = clean_documents(docs)
    scored = classify_by_rules(cleaned.withColumn("_scored", F.col("cleaned_text")), "_scored")
    return scored.select(
        "file_name",
        "file_location",
        "raw_text",
        "cleaned_text",
        F.col("predicted_class").alias("classified_category"),
        "confidence",
        F.to_json(
            F.when(F.col("predicted_class") == UNKNOWN, F.map_from_entries(F.array().cast("array<struct<k:string,v:double>>")))
            .otherwise(F.create_map(F.col("predicted_class"), F.round(F.col("confidence") / 100, 6)))
        ).alias("high_confidence_classes"),
        process_metadata({stage: F.col(c) for stage, c in _SECONDS.items()}, F.col("cost")).alias("process_metadata"),
        "seq",
    )


def process_documents(
    files: DataFrame, extracted: Column, store: DocumentStore, batch_id: int,
    process: Callable[[DataFrame], DataFrame] = classify_batch,
) -> DataFrame:
    """One batch of (file_location, seq and what ``extracted`` reads) through all steps; the store's table after it.

    ``extracted`` is the column that turns a file into text. Repeating a batch replaces what it stored before.
    """
    texts = files.withColumn("raw_text", extracted).withColumn("file_name", file_name(F.col("file_location")))
    store.append(process(texts), batch_id)
    return store.current()


def ingest(
    stream: DataFrame,
    store: DocumentStore,
    checkpoint: str,
    process: Callable[[DataFrame], DataFrame] = classify_batch,
):
    """Start a query that stores every new document once per file name.

    The stream needs file_name, file_location, raw_text and seq. A batch that is
    replayed after a failure replaces its own folder, and rows are keyed by file
    name, so a replay changes nothing.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        store.append(process(batch), batch_id)

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
