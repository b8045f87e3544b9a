import pytest
from pyspark.sql import functions as F

from claimsift.operators import replies, requests

YES = {
    "yes, 95%": 0.95, "yes. confidence: 87.5%": 0.875, "yes 100 %": 1.0, "yes, 95": 0.95, "yes 80% or 90%": 0.8,
    "eyes 5%": 0.05, "no, 90%": 0.0, "yes": None, "Yes\n95%": None, "yes (95%)": None, "YES 7e1%": 0.7, "yes 95d%": None,
    "yes  95%": None, "": 0.0,
}


def column(spark, texts, make):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, response string")
    return [r[0] for r in df.orderBy("i").select(make(F.col("response"))).collect()]


def by_hand(reply):
    lowered = reply.lower()
    if "yes" not in lowered:
        return 0.0
    try:
        return float(lowered.split("%")[0].strip().split(" ")[-1]) / 100
    except ValueError:
        return None


def test_yes_confidence(spark):
    texts = [t for t in YES if t != "yes  95%"]
    got = column(spark, texts, replies.yes_confidence)
    assert got == [pytest.approx(YES[t]) if YES[t] is not None else None for t in texts]
    assert got == [pytest.approx(by_hand(t)) if by_hand(t) is not None else None for t in texts]
    assert column(spark, [None], replies.yes_confidence) == [0.0]


def test_canonical_label_uses_priority(spark):
    texts = ["Order, not Delivery", "Sleep_Study_Report", "order", "Physician Order", ""]
    assert column(spark, texts, replies.canonical_label) == ["Delivery", "Sleep", None, "Physician", None]


def test_line_format(spark):
    texts = [
        "Class: Sleep\nConfidence: 80%", "none", "Class: A\nClass: B \nConfidence: 5", "Confidence: high",
        "Class: X Confidence: 9%", "Confidence: 1%\nConfidence: x\nConfidence: 2%",
    ]
    got = [tuple(r) for r in column(spark, texts, replies.class_and_confidence)]
    assert got == [
        ("Sleep", 80.0), ("Unknown", 0.0), ("B", 5.0), ("Unknown", None), ("X Confidence: 9%", 0.0), ("Unknown", None),
    ]


def test_dash_format(spark):
    texts = ["Document 1 - Class: Sleep - Confidence: High", "Document 1 - Class: Order", "x", "D - Sleep - High", "D - Class: A - Confidence: Sure"]
    got = [tuple(r) for r in column(spark, texts, replies.dash_reply)]
    assert got == [("Sleep", 0.9), ("Order", 0.3), ("Unknown", 0.3), (None, None), ("A", 0.5)]


def test_batch_reply_last_line_wins(spark):
    text = "Here:\nDocument 1 - Class: A - Confidence: Low\nDocument 2 - Class: B\nDocument 1 - Class: C - Confidence: High"
    df = spark.createDataFrame([(0, text)], "batch_no bigint, response string")
    got = sorted(tuple(r)[1:] for r in replies.batch_reply_rows(df).collect())
    assert got == [("1", "C", 0.9), ("2", "B", None)]


def scored(spark, rows):
    df = spark.createDataFrame(rows, "id bigint, label_ord bigint, label string, response string")
    return replies.score_replies(df)


def test_decision_branches(spark):
    s = scored(spark, [
        (1, 0, "Compliance", "yes 90%"), (1, 1, "Sleep", "no"),
        (2, 0, "Compliance", "yes 50%"), (2, 1, "Sleep", "yes 60%"),
        (3, 0, "Compliance", "no"), (3, 1, "Sleep", "yes 49%"),
        (4, 0, "Compliance", "yes"), (4, 1, "Sleep", "yes 90%"),
    ])
    second = spark.createDataFrame([(2, "Sleep_Study"), (3, "what")], "id bigint, response string")
    d = replies.decide(s)
    got = {r.id: r for r in d.collect()}
    assert [got[i].branch for i in (1, 2, 3)] == ["unique", "several", "none"]
    assert got[2].candidates == ["Compliance", "Sleep"] and len(got[3].candidates) == 6
    out = {r.id: r for r in replies.classify_by_replies(d, second).collect()}
    assert set(out) == {1, 2}
    assert (out[1].predicted_class, out[1].confidence) == ("Compliance", 0.9)
    assert (out[2].predicted_class, out[2].confidence) == ("Sleep", 0.9)
    assert out[2].high_confidence_classes == {"Compliance": 0.5, "Sleep": 0.6}
    dead = sorted((r.id, r.round) for r in replies.dead_letters(s, d, second).collect())
    assert dead == [(3, "few_shot"), (4, "one_vs_rest")]


def test_requests_are_asked_once_per_text(spark):
    docs = spark.createDataFrame([(i, "same" if i < 90 else f"t{i}") for i in range(100)], "id bigint, cleaned_text string")
    asked = requests.one_vs_rest_requests(docs)
    first = asked.filter("label = 'Sleep'")
    cache = first.select(F.sha2("user_text", 256).alias("text_hash"), "label").distinct().withColumn("response", F.lit("cached"))
    seen = spark.sparkContext.accumulator(0)

    def responder(df):
        def run(batches):
            for b in batches:
                seen.add(len(b))
                yield b.assign(response="new")[["text_hash", "label_ord", "label", "response"]]
        return df.mapInPandas(run, "text_hash string, label_ord bigint, label string, response string")

    out = requests.answer_requests(docs, cache, responder)
    got = {(r.response, r["count"]) for r in out.groupBy("response").count().collect()}
    assert got == {("cached", 100), ("new", 500)}
    assert seen.value == 11 * 5


def test_cost_of_a_document(spark):
    s = scored(spark, [(1, 0, "Compliance", "yes 90%"), (1, 1, "Sleep", "no")])
    docs = spark.createDataFrame([(1, "a b c")], "id bigint, cleaned_text string")
    none = spark.createDataFrame([], "id bigint, response string")
    prompts = {"Compliance": "one two", "Sleep": "three"}
    kw = dict(prompts=prompts, input_price=1, output_price=10)
    row = requests.classification_cost(s.drop("score"), none, docs, **kw).first()
    assert (row.ovr_cost, row.few_shot_cost) == (3 + 4 * 10, 0)
    row = requests.classification_cost(s.drop("score"), none, docs, include_document=True, **kw).first()
    assert row.ovr_cost == 3 + 2 * 3 + 4 * 10
    with pytest.raises(ValueError):
        requests.load_prompts("[]")
