from collections import defaultdict

import pytest
from oracle_check import compare, oracle_connection
from pyspark.sql import functions as F

from claimsift.llm.line_runs import LineRuns, dedup_lines
from claimsift.llm.queries import ORACLES, QUERIES


def test_query_equals_sql(spark, small):
    rows, problem = compare(spark, oracle_connection(small), "op10_line_runs", small, QUERIES, ORACLES)
    assert problem is None and rows > 0


def test_runs_count_over_batches(spark):
    batches = [[(1, 1, 5), (2, 2, 5), (1, 1, 6)], [(1, 1, 9), (3, 3, 8)], [(2, 2, 7), (2, 2, 7)], [], [(2, 2, 1), (1, 1, 2)], [(3, 3, 4), (3, 3, 3)], [(4, 4, 4)]]
    runs, want = LineRuns(spark, fan_out=2), defaultdict(set)
    for rows in batches:
        fresh = {(r[0], r[1]) for r in rows} - set(want)
        name = runs.add(spark.createDataFrame(rows, "h1 long, h2 long, doc_id long"))
        if spark.catalog.tableExists(name):  # not merged at once
            assert {(r["h1"], r["h2"]) for r in spark.table(name).filter("fresh").collect()} == fresh
        for h1, h2, doc in rows:
            want[h1, h2].add(doc)
    assert max(map(len, runs.levels)) < 2 and len(runs.levels) > 2
    got = {(r["h1"], r["h2"]): r["top_id"] for r in runs.repeated(3).collect()}
    assert got == {k: max(v) for k, v in want.items() if len(v) >= 3}
    names = runs.names()
    runs.drop()
    assert not any(spark.catalog.tableExists(n) for n in names)


def brute(rows, min_docs=3):
    holders = defaultdict(set)
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    order = lambda i: (i is not None, i or 0)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(holders[key(x)]) >= min_docs and i != max(holders[key(x)], key=order))]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(map(repr, out))


LONG, UMLAUT = "a line of more than twenty", "Äpfel und Birnen und noch mehr"


@pytest.mark.parametrize("rows", [
    [(1, LONG), (2, f"x\n  {LONG.upper()}\t\ny"), (3, f"{LONG}\n{LONG}"), (4, "z")],
    [(1, LONG), (2, LONG), (3, "short"), (4, "short"), (5, "short")],
    [(1, UMLAUT), (2, UMLAUT.lower()), (3, UMLAUT), (4, UMLAUT), (5, "\n\n"), (6, "")],
    [(None, LONG), (1, LONG), (2, f"{LONG}\n\n{LONG}\n"), (None, f"k\n{LONG}"), (3, None)],
    [(7, LONG), (7, LONG), (7, LONG), (8, LONG)],
    [(7, LONG), (7, LONG), (9, LONG), (8, LONG), (9, f"{LONG}\nmore")],
    [(k, f"start {k}\n{LONG}\nmiddle line that all of them have\nend {k}") for k in range(40)],
])
def test_equals_brute_force(documents, rows):
    docs = documents(rows).withColumn("lines", F.lit("clash"))
    got = dedup_lines(docs, "doc_id", "text", report_col="report")
    assert got.columns == [*docs.columns, "report"]
    assert sorted(repr((r["doc_id"], r["text"], r["report"]["n_lines"], r["report"]["n_dropped"])) for r in got.collect()) == brute(rows)


def test_empty_table(documents):
    docs = documents([(1, "x")]).filter(F.lit(False))
    assert dedup_lines(docs, "doc_id", "text").count() == 0
