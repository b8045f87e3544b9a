"""Cleaning steps, the whole chain and its effect."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimsift.fixed_values import CLEANING_STEPS
from claimsift.operators import cleaning
from claimsift.plans.registry import query
from claimsift.plans.views import duck_clean


def _step(n: int):
    @query(f"SELECT id, {duck_clean('raw_text', n)} AS text FROM claims", name=f"clean_step_{n:02d}")
    def after_step(v):
        return v.raw_claims.select("id", cleaning.clean_text(F.col("raw_text"), n).alias("text"))


for _n in range(1, CLEANING_STEPS + 1):
    _step(_n)


@query("SELECT id, file_name, ground_truth, cleaned_text FROM cleaned")
def clean_text(v):
    return v.cleaned.select("id", "file_name", "ground_truth", "cleaned_text")


@query("""SELECT ground_truth AS label, count(*) AS documents, sum(length(raw_text))::BIGINT AS chars_before,
       sum(length(cleaned_text))::BIGINT AS chars_after FROM cleaned GROUP BY ground_truth""")
def clean_effect(v):
    return cleaning.clean_effect(v.raw_claims)
