import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimsift.operators import ordering as o


def test_running_totals_with_uneven_ids(spark):
    rows = [(int(i) ** 3, i % 7) for i in range(500)]
    df = spark.createDataFrame(rows, "id bigint, v bigint").repartition(5)
    got = sorted(tuple(r) for r in o.running_totals(df, "id", {"t": F.col("v")}, slices=13).collect())
    assert [r[2] for r in got] == list(np.cumsum([r[1] for r in rows]))


def test_running_totals_by_group_and_empty(spark):
    df = spark.range(100).select("id", (F.col("id") % 3).alias("g"))
    got = {r.id: r.n for r in o.running_totals(df, "id", {"n": F.lit(1)}, by=["g"], slices=4).collect()}
    assert got == {i: i // 3 + 1 for i in range(100)}
    assert o.running_totals(df.filter("id < 0"), "id", {"n": F.lit(1)}).count() == 0


def test_no_window_over_everything(spark):
    df = spark.range(100)
    plan = o.running_totals(df, "id", {"n": F.lit(1)})._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.split("\n") if "Window [" in line]
    assert any("_slice" in w.split("windowspecdefinition(")[1].split(" ASC")[0] for w in windows)


@pytest.mark.parametrize("start,stop", [(0, None), (8, None), (4, 8), (100, None), (99, None)])
def test_positional_slice(spark, start, stop):
    df = spark.range(100).select((F.col("id") * 7 % 100).alias("id")).repartition(7)
    got = sorted(r.id for r in o.positional_slice(df, "id", start, stop).collect())
    assert got == list(range(100))[start:stop]


@pytest.mark.parametrize("rule,method", [("hazen", "hazen"), ("linear", "linear")])
def test_quantiles_match_numpy(spark, rule, method):
    rng = np.random.default_rng(1)
    data = {"a": rng.integers(0, 5, 400).astype(float), "b": rng.normal(size=37), "c": np.array([2.5])}
    rows = [(k, float(x)) for k, xs in data.items() for x in xs]
    df = spark.createDataFrame(rows, "g string, x double").repartition(6)
    ps = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    for r in o.exact_quantiles(df, "x", "g", ps, rule).collect():
        assert r.quantile == pytest.approx(np.quantile(data[r.g], r.probability, method=method)), (r.g, r.probability)


def test_any_number_of_groups_and_null_groups(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 3 > 0, F.col("id")).alias("g"))
    got = o.running_totals(df, "id", {"n": F.lit(1)}, by=["g"], slices=4)
    assert got.count() == 5000
    assert got.filter("g IS NULL").agg({"n": "max"}).first()[0] == 1667 == got.filter("g IS NULL").count()


FIRST_IN_SESSION = """
from pyspark.sql import functions as F
from claimsift.operators.ordering import running_totals
from claimsift.session import local_session
spark = local_session(2, "1g")
df = spark.createDataFrame([(g, i, i) for g in range(2) for i in range(30)], "g int, id bigint, v bigint")
for r in running_totals(df, "id", {"t": F.col("v")}, by=["g"], slices=5).collect():
    assert r.t == r.id * (r.id + 1) // 2, r
print("ended")
"""


def test_the_order_may_be_the_second_column_of_a_session(tmp_path):
    env = os.environ | {"PYTHONPATH": os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "TMPDIR": str(tmp_path)}
    ran = subprocess.run([sys.executable, "-c", FIRST_IN_SESSION], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert ran.stdout.strip() == "ended", ran.stderr[-2000:]
