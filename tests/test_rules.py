import re

import pytest
from pyspark.sql import functions as F

from claimsift.fixed_values import DEFAULT_RULES, SIMPLE_RULES
from claimsift.functions.patterns import feature_sql, fold_case, known_words, pattern_sql
from claimsift.operators import rules

EDGES = [
    "Rx:5", "Rx: 5", "Follow up:x", "Follow up: x", "50%a", "5 %", "5%", "10µV", "10 µV", "10 μV", "orders",
    "reorder", "orderé", "order_", "order", "ORDER-x", "Stage |2: 5%", "Stage N2: 5%", "Assessment: a\nPlan:",
    "Assessment: a Plan:", "Take 2 tablet(s) daily", "Physician's Notes", "physician s notes", "ſleep", "SLEEP",
    "dıagnostic", "mm Hg", "mm  Hg", "L/min", "5L/min", "l/MIN.", "events/hour", "cmH2O", "", "g", "5g 5 G", "Disp: #30",
    "Dr. Ann Lee", "used 3 out of 5 nights", "AHI<5", "K", "Kg",
]
FEATURES = sorted({f for r in DEFAULT_RULES.values() for k in list(r)[:4] for f in r[k]})
PATTERNS = [p for r in DEFAULT_RULES.values() for p in r["semantic_patterns"]]


def texts(spark, extra=()):
    return spark.createDataFrame([(i, t) for i, t in enumerate([*EDGES, *extra])], "id bigint, t string")


def check(df):
    folded = df.withColumn("f", fold_case(F.col("t"))).withColumn("w", known_words(F.col("f"), FEATURES))
    hits = [f"{feature_sql('t', 'f', 'w', x)} AS h{i}" for i, x in enumerate(FEATURES)]
    pats = [f"{pattern_sql('t', 'f', p)} AS p{i}" for i, p in enumerate(PATTERNS)]
    for row in folded.selectExpr("t", *hits, *pats).collect():
        for i, x in enumerate(FEATURES):
            want = bool(re.search(rf"\b{re.escape(x)}\b", row.t, re.IGNORECASE))
            assert row[f"h{i}"] == want, (x, row.t)
        for i, p in enumerate(PATTERNS):
            assert row[f"p{i}"] == bool(re.search(p, row.t, re.IGNORECASE)), (p, row.t)


def test_edge_strings_match_python(spark):
    check(texts(spark))


def test_every_document_matches_python(views):
    check(views.cleaned.select("id", F.col("cleaned_text").alias("t")))


def test_required_literals():
    from claimsift.functions.patterns import required_literals as needs

    assert needs(r"\d+(\.\d+)?\s*hours?\s*(per|/)\s*(night|day)") == [["hour"], ["night", "day"]]
    assert needs(r"Take\s+\d+\s+tablet\(s\)\s+\w+") == [["Take"], ["tablet(s)"]]
    assert needs(r"(?:Name|ID):\s*\S+") == [["Name:", "ID:"]]
    assert needs(r"a|b") == [] and needs(r"x*y{0,2}z+\d") == [["z"]]
    assert needs(r"(a(b|c))?d") == [["d"]]


def test_custom_feature_outside_the_folding(spark):
    df = spark.createDataFrame([("straße ÉTÉ",)], "t string")
    df = df.withColumn("f", fold_case(F.col("t"))).withColumn("w", known_words(F.col("f"), ["été"]))
    assert df.selectExpr(feature_sql("t", "f", "w", "été")).first()[0]


def score(spark, *rows):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "id bigint, cleaned_text string")
    return {r.id: r for r in rules.classify_by_rules(df).collect()}


def test_lone_measurement_is_truncated_away(spark):
    got = score(spark, "bpm", "nothing here", "assessment bpm")
    assert (got[0].predicted_class, got[0].confidence) == ("Unknown", 0.0)
    assert got[1].predicted_class == "Unknown"
    assert got[2].predicted_class == "Physician"


def test_tie_goes_to_the_first_class(spark):
    tied = {
        "B": {**dict.fromkeys(rules.FAMILIES, []), "keywords": ["x"]},
        "A": {**dict.fromkeys(rules.FAMILIES, []), "keywords": ["x"]},
    }
    df = spark.createDataFrame([(1, "x")], "id bigint, cleaned_text string")
    assert rules.classify_by_rules(df, rules=tied).first().predicted_class == "B"


def test_maximum_scores():
    assert [rules.maximum_score(DEFAULT_RULES, c) for c in DEFAULT_RULES] == [39.5, 37.5, 30.5, 27.5, 33.5, 34.5]


def by_hand(text):
    scores = {}
    for name, r in DEFAULT_RULES.items():
        total = limit = 0
        for family, weight in [("keywords", 1), ("structure_starts", 1.5), ("measurements", 0.8), ("required_fields", 2)]:
            found = sum(bool(re.search(rf"\b{re.escape(f)}\b", text, re.I)) for f in r[family])
            total, limit = total + int(found * weight), limit + int(len(r[family]) * weight)
        found = sum(bool(re.search(p, text, re.I)) for p in r["semantic_patterns"])
        scores[name] = (total + found * 1.5) / (limit + len(r["semantic_patterns"]) * 1.5) * 100
    best = max(scores, key=scores.get)
    return ("Unknown" if scores[best] < 0.4 else best), scores[best]


def test_predictions_match_python(views):
    got = rules.classify_by_rules(views.cleaned.withColumn("t", F.col("cleaned_text")), "t").collect()
    for r in got:
        label, confidence = by_hand(r.cleaned_text)
        assert (r.predicted_class, r.confidence) == (label, pytest.approx(confidence)), r.id


def test_simple_scorer(spark):
    df = spark.createDataFrame([(1, "AirView usage"), (2, "zzz")], "id bigint, cleaned_text string")
    got = {r.id: r for r in rules.classify_by_simple_rules(df).collect()}
    assert got[1].predicted_class == "Compliance" and got[1].confidence == pytest.approx(2 / 10 * 100)
    assert (got[2].predicted_class, got[2].confidence) == ("Compliance", 0.0)
    assert list(SIMPLE_RULES) == list(DEFAULT_RULES)


def test_rules_round_trip(spark):
    rows = rules.rules_table(rules.default_rules_rows(spark))
    assert rows.count() == 159
    assert rules.read_rules(rules.rules_table_to_json(rows).first().rules_json) == DEFAULT_RULES
    assert rules.read_rules(rules.rules_to_json()) == DEFAULT_RULES
    with pytest.raises(ValueError):
        rules.read_rules('{"A": {"keywords": []}}')


def test_filter_on_prediction_does_not_score_twice(views):
    df = rules.classify_by_rules(views.cleaned.select("id", "cleaned_text")).filter("predicted_class <> 'Sleep'")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("tablet") == 1
