"""Every query against its oracle on the smallest tables, and against emptiness."""

import pytest
from oracle_check import compare, oracle_connection

from claimsift.plans import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SMALL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_matches_oracle(spark, con, name):
    rows, problem = compare(spark, con, name, SMALL, QUERIES, ORACLES)
    assert problem is None, problem
    assert rows > 0


def test_only_row_checks_without_oracle():
    assert set(QUERIES) - set(ORACLES) == set()


@pytest.mark.parametrize("name,column", [
    ("date_pattern_counts", "matches"), ("form_field_counts", "matches"), ("time_reference_counts", "matches"),
    ("patient_info_counts", "matches"), ("measurement_counts", "matches"), ("numeric_pattern_counts", "percentages"),
    ("title_counts", "titles"), ("term_density", "term_tokens"), ("keyword_frequency", "occurrences"),
])
def test_counts_are_not_vacuous(spark, name, column):
    assert QUERIES[name](spark, SMALL).agg({column: "sum"}).first()[0] > 0


def test_every_class_and_unknown_occur(spark):
    got = {r[0] for r in QUERIES["classify_rules"](spark, SMALL).select("predicted_class").distinct().collect()}
    assert len(got) == 7
    branches = {r[0] for r in QUERIES["ovr_decision"](spark, SMALL).select("branch").distinct().collect()}
    assert branches == {"unique", "none", "several"}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(e.oracle_sql()) <= set(e.queries())
