import pytest
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture
def documents(spark):
    """Hand-made documents with clashing extra columns: null and empty texts, null ids, repeated rows."""

    def make(rows):
        frame = spark.createDataFrame(rows, "doc_id long, text string")
        return frame.select(
            "doc_id", "text", F.lit("en").alias("lang"), F.lit(1).alias("score"), F.lit("x").alias("row"), F.lit(2).alias("fp"),
            F.lit(3).alias("dropped"), F.lit("y").alias("h1"), F.lit("z").alias("target"),
        )

    return make
