"""The shape of the plans: what is read, what moves, what runs outside the JVM."""

import pytest

from claimsift.plans import QUERIES

SMALL = "/root/testdata/sf0.001"
PYTHON_NODES = ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "FlatMapGroupsInPandas")


def physical(spark, name):
    return QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [
    "clean_text", "classify_rules", "corpus_profile", "classify_llm", "classification_cost", "upsert_documents",
    "report_with_confidence", "cumulative_stage_time", "top_terms_by_label", "uncached_requests",
])
def test_no_python_in_the_hot_path(spark, name):
    assert not any(n in physical(spark, name) for n in PYTHON_NODES)


def test_vectors_need_no_shuffle(spark):
    plan = physical(spark, "classify_embedding")
    assert "Exchange" not in plan and "Join" not in plan and "ArrowEvalPython" in plan


@pytest.mark.parametrize("name", ["date_samples", "top_terms_by_label", "structure_first_lines", "prototype_set"])
def test_row_limits_apply_before_the_shuffle(spark, name):
    assert "WindowGroupLimit" in physical(spark, name) and "Partial" in physical(spark, name)


def test_reports_read_no_text(spark):
    scans = [x for x in physical(spark, "cost_summary").split("\n") if "FileScan" in x]
    assert scans and all("ReadSchema" not in x or "text:" not in x for x in scans)


def test_a_scan_of_the_store_leaves_the_texts_in_the_files(spark, views):
    assert {"raw_text", "cleaned_text"} <= set(views.stored_documents.columns)
    scans = [x for x in physical(spark, "scan_documents").split("\n") if "ReadSchema" in x]
    assert scans and not any("text:" in x for x in scans)


@pytest.mark.parametrize("name", ["stage_time_box", "cumulative_stage_time"])
def test_ordered_reports_read_their_table_once(spark, name):
    assert "FileScan" not in physical(spark, name)  # it was written as narrow rows, and these are read again


@pytest.mark.parametrize("name", ["upsert_documents", "partial_upsert_documents"])
def test_merged_texts_are_not_joined_again(spark, name):
    plan = physical(spark, name)
    lines = plan[: plan.index("FullOuter")].split("\n")
    assert not any("Join" in x for x in lines[:-1]) and not any("Exchange" in x for x in lines)


@pytest.mark.parametrize("name", ["classify_llm", "classification_cost"])
def test_replies_are_scored_once(spark, name):
    assert physical(spark, name).count("partial_collect_list") == 1


def test_text_is_not_shuffled_for_the_report(spark, views):
    from claimsift.operators.evaluation import report_with_confidence
    from claimsift.operators.rules import classify_by_rules

    df = report_with_confidence(classify_by_rules(views.claims.select("id", "raw_text", "ground_truth"), "raw_text"))
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    keys = [x for x in lines if "Exchange hashpartitioning" in x]
    assert keys and not any("raw_text" in x for x in keys)
    assert sum("RLIKE" in x for x in lines) == 1


def test_no_cartesian_products(spark):
    for name in ("ovr_requests", "prototype_cosine", "classify_embedding", "parse_yes_confidence"):
        plan = physical(spark, name)
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
