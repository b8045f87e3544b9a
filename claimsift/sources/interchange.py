"""JSON and CSV results, and scratch space that every executor can reach."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from claimsift.functions.plan_shape import shared_root


def shared_folder(spark: SparkSession) -> str:
    """A new path under the cluster's shared folder (``spark.checkpoint.dir``)."""
    return f"{shared_root(spark)}/claimsift-{uuid.uuid4().hex}"


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_predictions_csv(predictions: DataFrame, path: str) -> None:
    """document_id, predicted_class, confidence with a header."""
    predictions.select("document_id", "predicted_class", "confidence").write.mode(
        "overwrite"
    ).option("header", True).option("escape", '"').csv(path)


def read_predictions_csv(spark: SparkSession, path: str) -> DataFrame:
    schema = "document_id bigint, predicted_class string, confidence double"
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)


def read_keyed_json(spark: SparkSession, path: str, value_type: str, key: str = "file_name") -> DataFrame:
    """A folder of JSON objects ``{key: value, ...}``, one object per file, as rows.

    The interchange form of small result files; large corpora use :func:`read_json`.
    """
    text = spark.read.text(path, wholetext=True)
    parsed = F.from_json("value", f"map<string, {value_type}>")
    return text.select(F.explode(parsed).alias(key, "v")).select(key, "v.*")


def read_extraction_results(spark: SparkSession, path: str) -> DataFrame:
    """``{method: {total_time, per_file_times, texts}}`` as (method, file_name, seconds, text)."""
    methods = read_keyed_json(
        spark, path, "struct<per_file_times: map<string,double>, texts: map<string,string>>", "method"
    )
    return methods.select("method", "texts", F.explode("per_file_times").alias("file_name", "seconds")).select(
        "method", "file_name", "seconds", F.col("texts")[F.col("file_name")].alias("text")
    )
