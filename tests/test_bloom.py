import re

from pyspark.sql import functions as F

from claimsift.functions import bloom
from claimsift.operators import requests


def test_no_key_is_lost_and_few_others_pass(spark):
    rows = spark.range(200_000).withColumn("text", F.concat(F.lit("text "), F.col("id")))
    keys = rows.filter("id % 100 = 7").select("id")
    passed = bloom.keys_kept(rows, keys, "id")
    assert passed.join(keys, "id").count() == 2000
    assert passed.count() < 2200
    assert bloom.rows_of_keys(rows, keys, "id").count() == 2000


def test_a_full_filter_only_costs_time(spark, monkeypatch):
    monkeypatch.setattr(bloom, "FILTER_BITS", (7, 7))
    rows = spark.range(5000).withColumn("text", F.lit("t"))
    keys = rows.filter("id % 3 = 0").select("id")
    assert sorted(r.id for r in bloom.rows_of_keys(rows, keys, "id").collect()) == list(range(0, 5000, 3))


def test_null_and_repeated_keys_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (2, "d")], "id long, text string")
    keys = spark.createDataFrame([(1,), (None,)], "id long")
    assert sorted(r.text for r in bloom.rows_of_keys(rows, keys, "id").collect()) == ["a", "b"]
    assert bloom.rows_of_keys(rows, keys.limit(0), "id").count() == 0
    assert bloom.rows_of_keys(rows.limit(0), keys, "id").count() == 0


def test_only_wanted_texts_are_shuffled(spark):
    """The filter stands below the exchange of the texts."""
    docs = spark.range(10_000).withColumn("cleaned_text", F.concat(F.lit("text "), F.col("id")))
    undecided = docs.filter("id % 50 = 1").select("id", F.array(F.lit("Sleep"), F.lit("Order")).alias("candidates"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = requests.few_shot_requests(undecided, docs)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert found.count() == 200
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan
    texts = plan[plan.index("SortMergeJoin") :]
    exchange, test = texts.index("Exchange hashpartitioning(id"), re.search(r"Filter .*getbit", texts)
    assert test and exchange < test.start() < texts.index("Range (0, 10000")
