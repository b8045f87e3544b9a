"""Registry of queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimsift.plans.views import Views, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None, **ctes: str):
    """Register ``f(views) -> DataFrame`` under its name, with the oracle SQL if any."""

    def register(f: Callable[[Views], DataFrame]):
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"duplicate query {key}")
        QUERIES[key] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql is not None:
            ORACLES[key] = oracle(sql, **ctes)
        return f

    return register


def same_as(other: str):
    """Register another way to the result of the query ``other``."""

    def register(f: Callable[[Views], DataFrame]):
        query(name=f.__name__)(f)
        ORACLES[f.__name__] = ORACLES[other]
        return f

    return register


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    """Doubles to six places, as in the oracle SQL."""
    return df.withColumns({n: F.round(F.col(n).cast("double"), places) for n in names})


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def counted(*names: str) -> list[Column]:
    return [F.col(n).cast("bigint").alias(n) for n in names]
