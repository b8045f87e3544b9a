"""Cleaning chain: one projection of nested replacements, no shuffle, no Python."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimsift.fixed_values import CLEANING_PATTERNS, CLEANING_STEPS, NOISE_WORDS
from claimsift.functions.patterns import strip, unicode_pattern, whole_words
from claimsift.functions.plan_shape import settled


def clean_step(text: Column, step: int) -> Column:
    """Apply step ``step`` (1-based) of the chain alone."""
    if step == 2:
        return F.regexp_replace(text, whole_words(NOISE_WORDS), "")
    if step == CLEANING_STEPS:
        return strip(text)
    return reduce(
        lambda t, rule: F.regexp_replace(t, unicode_pattern(rule[0]), rule[1]),
        CLEANING_PATTERNS[step],
        text,
    )


def clean_text(text: Column, last_step: int = CLEANING_STEPS) -> Column:
    """Apply steps 1 to ``last_step`` in order."""
    return reduce(clean_step, range(1, last_step + 1), text)


def clean_documents(docs: DataFrame, last_step: int = CLEANING_STEPS) -> DataFrame:
    """Add ``cleaned_text``."""
    cleaned = clean_text(F.col("raw_text"), last_step).alias("cleaned_text")
    return settled(docs, docs.columns, cleaned)


def clean_effect(docs: DataFrame, label: str = "ground_truth") -> DataFrame:
    """Text lengths before and after cleaning, per label."""
    return (
        docs.select(
            F.col(label).alias("label"),
            F.length("raw_text").alias("before"),
            F.length(clean_text(F.col("raw_text"))).alias("after"),
        )
        .groupBy("label")
        .agg(
            F.count("*").alias("documents"),
            F.sum("before").cast("bigint").alias("chars_before"),
            F.sum("after").cast("bigint").alias("chars_after"),
        )
    )


def label_from_file_name(file_name: Column) -> Column:
    """The class is the first space-separated word of the file name."""
    return F.split(file_name, " ", 2)[0]
