import os

import pytest
from pyspark.sql import functions as F
from test_store import batch, table

from claimsift.sources import interchange, store
from claimsift.sources.partitioned_store import PartitionedStore


def make(spark, **kwargs):
    return PartitionedStore(spark, interchange.shared_folder(spark), **kwargs)


def files(s):
    """partition folder -> names of its files."""
    found = {}
    for folder, _, names in os.walk(f"{s.path}/table"):
        if "name_part=" in folder:
            found[os.path.basename(folder)] = sorted(n for n in names if n.endswith(".parquet"))
    return found


def rows(spark, names, version, seq=0):
    return batch(spark, *[(n, f"/{version}/{n}", f"{version} {n}", "c", "Y", 0.1, seq + k) for k, n in enumerate(names)])


def test_untouched_parts_keep_their_files(spark):
    s = make(spark, parts=8, buckets=4)
    names = [f"n{k}" for k in range(60)]
    s.append(rows(spark, names, "v0"), 0)
    before = files(s)
    assert len(before) == 8
    s.append(rows(spark, ["n7"], "v1"), 1)
    after = files(s)
    assert sum(before[p] != after[p] for p in before) == 1
    got = table(s.current())
    assert len(got) == 60 and got["n7"].raw_text == "v1 n7" and got["n7"].file_location == "/v0/n7"
    assert sorted(r.id for r in got.values()) == list(range(1, 61)) and got["n0"].id == 1 and got["n59"].id == 60


def test_replay_changes_nothing_and_ids_go_on(spark):
    s = make(spark, parts=4, buckets=2)
    s.append(rows(spark, ["a", "b", "c"], "v0"), 0)
    second = rows(spark, ["c", "d", "e"], "v1")
    s.append(second, 1)
    once = table(s.current())
    s.append(second, 1)
    assert table(s.current()) == once
    assert {n: r.id for n, r in once.items()} == {"a": 1, "b": 2, "c": 3, "d": 4, "e": 5}
    s.append(rows(spark, [], "v2"), 2)
    assert table(s.current()) == once
    assert table(PartitionedStore(spark, s.path, 4, 2).current()) == once


def test_ids_survive_a_batch_that_was_cut_off(spark):
    """New ids were kept, but only some parts were replaced: the repeated batch gives the same ids."""
    s = make(spark, parts=4, buckets=2)
    whole = rows(spark, [f"n{k}" for k in range(20)], "v0")
    s.replace_parts(s.merged(whole, 0).filter("name_part < 2"))
    assert 0 < s.current().count() < 20
    s.append(whole, 0)
    assert {n: r.id for n, r in table(s.current()).items()} == {f"n{k}": k + 1 for k in range(20)}


@pytest.mark.parametrize("merge", [store.upsert_documents, store.partial_upsert_documents])
def test_equals_the_merge_of_whole_tables(spark, merge):
    first = rows(spark, [f"n{k}" for k in range(12)], "v0")
    second = batch(spark, ("n3", "/x", "", "c1", None, 0.0, 1), ("n3", "/x", "r2", "", "Y", 0.0, 2), ("new", "/n", "", "c", "", 0.0, 3), ("new", "/n2", "r", "", "", 0.0, 4))
    s = make(spark)
    s.append(first, 0)
    want = table(merge(s.current(), second))
    s.append(second, 1, merge)
    assert table(s.current()) == want


def shuffled_columns(plan, table_path):
    """Columns of every exchange below which the table's files are read."""
    found = []

    def reads(node):
        return table_path in node.toString() and "FileScan" in node.toString()

    def walk(node):
        name = node.nodeName()
        if "Exchange" in name and reads(node):
            output = node.output()
            found.append([output.apply(k).name() for k in range(output.size())])
        children = node.children()
        for k in range(children.size()):
            walk(children.apply(k))

    walk(plan)
    return found


def test_stored_texts_are_not_shuffled(spark):
    s = make(spark, parts=4, buckets=8)
    s.append(rows(spark, [f"n{k}" for k in range(30)], "v0"), 0)
    merged = s.merged(rows(spark, ["n1", "x"], "v1"), 1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = merged.select("*")._jdf.queryExecution().executedPlan()
        text = plan.toString()
        exchanged = shuffled_columns(plan, os.path.basename(s.path))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in text and "FullOuter" in text
    assert not any("raw_text" in columns or "cleaned_text" in columns for columns in exchanged)
    assert merged.filter(F.col("file_name") == "x").count() == 1


@pytest.mark.parametrize("merge", [store.upsert_documents, store.partial_upsert_documents])
def test_batch_texts_move_once(spark, merge):
    """A task gets one bucket of one part, and texts of a batch are shuffled to the buckets and nowhere else."""
    s = make(spark, parts=4, buckets=3, task_bytes=1)
    s.append(rows(spark, [f"n{k}" for k in range(30)], "v0"), 0)
    merged = s.merged(rows(spark, [f"n{k}" for k in range(20, 40)], "v1"), 1, merge)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")  # as replace_parts does
    try:
        plan = merged.select("*")._jdf.queryExecution().executedPlan()
        tasks = plan.execute().getNumPartitions()
        texts = [columns for columns in exchanged_columns(plan) if not set(columns) <= {"file_name", "new_id", "id"}]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert tasks == 4 * 3 and len(texts) == 4, texts


def exchanged_columns(plan):
    children = plan.children()
    below = [x for k in range(children.size()) for x in exchanged_columns(children.apply(k))]
    output = plan.output()
    here = [[output.apply(k).name() for k in range(output.size())]] if "Exchange" in plan.nodeName() else []
    return here + below


def test_loaded_buckets_are_one_file_each(spark):
    s = make(spark, parts=3, buckets=2)
    s.append(rows(spark, [f"n{k}" for k in range(50)], "v0"), 0)
    loaded = make(spark, parts=3, buckets=2)
    loaded.load(s.current())
    assert table(loaded.current()) == table(s.current())
    assert {part: len(names) for part, names in files(loaded).items()} == {f"name_part={k}": 2 for k in range(3)}
    assert all(".zstd" in n for names in files(loaded).values() for n in names)


@pytest.mark.parametrize("merge", [store.upsert_documents, store.partial_upsert_documents])
def test_branches_change_no_rows(spark, merge):
    kept = []
    for task_bytes in (1, 32 << 20):
        s = make(spark, parts=3, buckets=2, task_bytes=task_bytes)
        s.append(rows(spark, [f"n{k}" for k in range(12)], "v0"), 0)
        s.append(batch(spark, ("n3", "/x", "", "c1", None, 0.0, 1), ("n3", "/x", "r2", "", "Y", 0.0, 2), ("new", "/n", "", "c", "", 0.0, 3), ("new", "/n2", "r", "", "", 0.0, 4)), 1, merge)
        kept.append(table(s.current()))
    assert kept[0] == kept[1] and len(kept[0]) == 13
