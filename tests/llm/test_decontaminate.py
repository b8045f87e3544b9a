import re
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from claimsift.llm import decontaminate
from claimsift.llm.common import cut
from claimsift.llm.decontaminate import AGREEING, MASKS, STRETCH, blocks, contaminated
from claimsift.llm.queries import QUERIES


def test_masks_hit_every_stretch_with_three_substitutions():
    allowed = STRETCH - -(-STRETCH * AGREEING // 1)
    for wrong in combinations(range(STRETCH), int(allowed)):
        right = set(range(STRETCH)) - set(wrong)
        assert any({at + place for place in mask} <= right for mask in MASKS for at in range(STRETCH - mask[-1]))


@pytest.mark.parametrize("size", range(1, STRETCH))
def test_blocks_hit_every_copy_of_a_short_item(size):
    parts = blocks(size, AGREEING)
    assert sorted(at + k for at, n in parts for k in range(n)) == list(range(size))
    for wrong in combinations(range(size), size - int(-(-size * AGREEING // 1))):
        assert any(not set(wrong) & set(range(at, at + n)) for at, n in parts)


def test_short_items_are_found_with_substitutions(spark):
    item_words, docs, want = {}, [], set()
    for size in range(1, STRETCH):
        item_words[size] = [f"i{size}w{k}" for k in range(size)]
        for wrong in combinations(range(size), size - int(-(-size * AGREEING // 1))):
            docs.append((len(docs), "before " + " ".join("x" if k in wrong else w for k, w in enumerate(item_words[size])) + " after"))
            want.add((docs[-1][0], size))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([(size, " ".join(w)) for size, w in item_words.items()], "item_id long, text string")
    rows = contaminated(frame, "doc_id", "text", items, "item_id", "text", shortest=1).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == want
    assert {r["item_id"] for r in contaminated(frame, "doc_id", "text", items, "item_id", "text").collect()} == set(range(9, STRETCH))


def test_scripts_without_spaces(spark):
    items = [(1, "\u6c34\u306e\u6cb8\u70b9\u306f\u4f55\u5ea6\u3067\u3059\u304b"), (2, "\u4e2d\u56fd\u7684\u9996\u90fd")]
    docs = spark.createDataFrame([(k, f"\u524d\u6587{text}\u5f8c\u6587") for k, text in items] + [(3, "\u4e2d\u6587")], "doc_id long, text string")
    rows = contaminated(docs, "doc_id", "text", spark.createDataFrame(items, "item_id long, text string"), "item_id", "text", shortest=1).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == {(1, 1), (2, 2)}


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(doc, item):
    """Best stretch over all offsets, or None."""
    d, i = words(doc), words(item)
    if len(i) < 9 or len(set(i)) == 1:
        return None
    size, best = min(STRETCH, len(i)), 0
    for offset in range(-len(i) + size, len(d) - size + 1):
        equal = [k + offset >= 0 and k + offset < len(d) and d[k + offset] == i[k] for k in range(len(i))]
        for start in range(len(i) - size + 1):
            if 0 <= start + offset and start + offset + size <= len(d):
                best = max(best, sum(equal[start : start + size]))
    return best if best >= -(-size * AGREEING // 1) else None


def test_query_equals_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    items = spark.read.parquet(f"{small}/benchmark.parquet").collect()
    vocabulary = {i["item_id"]: set(words(i["text"])) for i in items}
    want = {}
    for d in docs:
        in_doc = words(d["text"])
        for i in items:
            if sum(w in vocabulary[i["item_id"]] for w in in_doc) >= 13 and (n := brute(d["text"], i["text"])):
                want[d["doc_id"], i["item_id"]] = n
    got = {(r["doc_id"], r["item_id"]): r["n_equal"] for r in QUERIES["op7_spaced_seeds"](spark, small).collect()}
    assert got == want and want


ITEM = " ".join(f"word{k}" for k in range(40))


def changed(every):
    return " ".join(w if k % every else "other" for k, w in enumerate(ITEM.split(), 1))


@pytest.mark.parametrize("text,found", [
    (ITEM, True), (f"before {ITEM} after", True), (ITEM.upper().replace(" ", ", "), True), (changed(6), True), (changed(2), False),
    (" ".join(ITEM.split()[:16]), True), (" ".join(ITEM.split()[:15]), False), (" ".join(reversed(ITEM.split())), False),
])
def test_tolerates_substitutions(spark, text, found):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    items = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    assert contaminated(docs, "doc_id", "text", items, "item_id", "text").count() == found


def test_a_full_filter_only_costs_time(spark, small, monkeypatch):
    docs, items = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "benchmark"))
    want = sorted(map(tuple, contaminated(docs, "doc_id", "text", items, "item_id", "text").collect()))
    monkeypatch.setattr(decontaminate, "FILTER_BITS", 7)
    monkeypatch.setattr(decontaminate, "FLAG_BITS", 1)
    assert sorted(map(tuple, contaminated(docs, "doc_id", "text", items, "item_id", "text").collect())) == want


def test_only_built_in_expressions(spark, small):
    plan = QUERIES["op7_spaced_seeds"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


def test_flags_and_filter_stand_in_no_plan(spark, small, monkeypatch):
    plans = []

    def written(df):
        plans.append(df._jdf.queryExecution().toString())
        return cut(df)

    monkeypatch.setattr(decontaminate, "cut", written)
    QUERIES["op7_spaced_seeds"](spark, small)
    assert plans and max(map(len, plans)) < 100_000


def test_edges(spark, documents):
    short, single = "a b c d e f g h", "same " * 30
    docs = documents([(1, None), (2, ""), (3, ITEM), (3, ITEM), (None, ITEM), (4, short), (5, single), (6, "a b c d e f g h i"), (7, ITEM * 2)])
    items = spark.createDataFrame([(1, ITEM), (1, ITEM), (2, None), (3, ""), (4, short), (5, single), (6, "a b c d e f g h i"), (None, ITEM)], "item_id long, text string").withColumn("doc_id", F.lit(0)).withColumn("words", F.lit(1))
    rows = contaminated(docs, "doc_id", "text", items, "item_id", "text").collect()
    assert sorted(((r["doc_id"] or -1, r["item_id"] or -1, r["n_equal"], r["n_compared"]) for r in rows)) == sorted(
        [(d, i, 16, 16) for d in (-1, 3, 7) for i in (-1, 1)] + [(6, 6, 9, 9)]
    )
    nothing = F.lit(False)
    assert contaminated(docs.filter(nothing), "doc_id", "text", items, "item_id", "text").count() == 0
    assert contaminated(docs, "doc_id", "text", items.filter(nothing), "item_id", "text").count() == 0
