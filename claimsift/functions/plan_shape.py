"""Helpers that keep a dear expression from being evaluated twice, and the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def settled(df: DataFrame, keep: Sequence[str], *columns: Column) -> DataFrame:
    """``df.select(*keep, *columns)`` whose new columns are computed exactly once.

    The optimizer moves a later filter below a projection by repeating the projected
    expression in the filter: for a chain of regexes that is the whole work again.
    It does not move a filter below a generator that makes the filtered column, so
    the columns come out of a one-element array.
    """
    return df.select(*keep, F.explode(F.array(F.struct(*columns))).alias("_once")).select(
        *keep, "_once.*"
    )


def shared_root(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Only a session on one machine (``local``, ``local[n]``) may lack the setting; it gets a folder then.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = os.path.join(tempfile.gettempdir(), "claimsift-checkpoints")
    return root.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read from there, without lineage.

    What is used several times is computed once, and a lost executor loses nothing.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint()
