from pyspark.sql import functions as F

from claimsift.operators import responder


def test_the_second_round_gets_exactly_the_undecided(spark):
    docs = spark.createDataFrame([(1, "one"), (2, "none"), (3, "two"), (4, "unreadable"), (5, None)], "id bigint, cleaned_text string")
    said = {
        "one": ["yes 90%", "no", "no", "no", "no", "no"],
        "two": ["yes 60%", "yes 50%", "no", "no", "no", "no"],
        "unreadable": ["yes", "no", "no", "no", "no", "no"],
    }
    asked = []

    def ask_classes(rows):
        asked.append(rows.select("id", F.size("requests").alias("n")).collect())
        replies = F.create_map(*[x for k, v in said.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
        return rows.withColumn("responses", F.coalesce(F.try_element_at(replies, F.coalesce("user_text", F.lit(""))), F.array(*[F.lit("no")] * 6)))

    def ask_again(rows):
        asked.append({r.id: (r.candidates, r.prompt) for r in rows.collect()})
        return rows.withColumn("response", F.when(F.col("id") == 2, "Class: Sleep").otherwise("no idea"))

    got = responder.classify_with_responder(docs, ask_classes, ask_again)
    assert {(r.id, r.n) for r in asked[0]} == {(i, 6) for i in range(1, 6)}
    assert set(asked[1]) == {2, 3, 5}
    assert asked[1][3][0] == ["Compliance", "Sleep"] and asked[1][3][1].endswith('"two"') and len(asked[1][2][0]) == 6
    rows = {r.id: r for r in got.predictions.collect()}
    assert {i: r.predicted_class for i, r in rows.items()} == {1: "Compliance", 2: "Sleep"}
    assert rows[1].high_confidence_classes == {"Compliance": 0.9} and rows[2].confidence == 0.9
    assert sorted((r.id, r.round) for r in got.dead_letters.collect()) == [(3, "few_shot"), (4, "one_vs_rest"), (5, "few_shot")]
    costs = {r.id: r for r in got.costs.collect()}
    assert set(costs) == {1, 2} and costs[1].few_shot_cost == 0 and costs[2].few_shot_cost > 0
    assert len(asked) == 2  # nothing is asked twice, however often the result is used
