"""Reading replies and deciding on a class.

A reply that cannot be read becomes NULL here and a dead-letter row downstream;
it never fails the job.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimsift.fixed_values import (
    CONFIDENCE_WORD_OTHER,
    CONFIDENCE_WORDS,
    FEW_SHOT_CONFIDENCE,
    LABEL_PRIORITY,
    LABELS,
    REPLY_THRESHOLD,
    UNKNOWN,
)
from claimsift.functions.patterns import SPACE, split_lines, strip, to_number


def _percentage(lowered: Column) -> Column:
    """The last space-separated word before the first percent sign, as a share."""
    head = strip(F.split(lowered, "%", 2)[0])
    return to_number(F.substring_index(head, " ", -1)) / 100


def yes_confidence(response: Column) -> Column:
    """Share behind a yes, 0 without a yes (as a substring), NULL when unreadable."""
    lowered = F.lower(F.coalesce(response, F.lit("")))
    return F.when(lowered.contains("yes"), _percentage(lowered)).otherwise(F.lit(0.0))


def any_confidence(response: Column) -> Column:
    """As :func:`yes_confidence`, but a no counts with its percentage too."""
    return _percentage(F.lower(F.coalesce(response, F.lit(""))))


def canonical_label(response: Column) -> Column:
    """First class name of the priority list found in the text, NULL if none."""
    return reduce(
        lambda rest, label: F.when(response.contains(label), F.lit(label)).otherwise(rest),
        reversed(LABEL_PRIORITY),
        F.lit(None).cast("string"),
    )


def score_replies(replies: DataFrame) -> DataFrame:
    """Add ``score`` to (id, label_ord, label, response)."""
    return replies.withColumn("score", yes_confidence(F.col("response")))


def high_confidence_map(scores: DataFrame, threshold: float = REPLY_THRESHOLD) -> DataFrame:
    """(id, high_confidence_classes) as map label -> score, classes in order."""
    kept = scores.filter(F.col("score") >= threshold)
    entries = F.array_sort(F.collect_list(F.struct("label_ord", "label", "score")))
    return kept.groupBy("id").agg(
        F.map_from_entries(
            F.transform(entries, lambda e: F.struct(e.label, e.score))
        ).alias("high_confidence_classes")
    )


def decide(
    scores: DataFrame, threshold: float = REPLY_THRESHOLD, **measures: Column
) -> DataFrame:
    """(id, unreadable, high, branch, candidates, measures...), one row per document.

    ``branch`` is ``unique`` for exactly one class at or above the threshold, else
    ``none`` or ``several``; ``candidates`` are the classes a second round may
    choose from. ``measures`` are further aggregates to take in the same shuffle,
    which moves scores only, a few numbers per document.
    """
    kept = F.when(
        F.col("score") >= threshold, F.struct("label_ord", "label", "score")
    )
    per_doc = scores.groupBy("id").agg(
        F.count_if(F.col("score").isNull()).alias("unreadable"),
        F.array_sort(F.collect_list(kept)).alias("high"),
        *[m.alias(name) for name, m in measures.items()],
    )
    n = F.size("high")
    return per_doc.select(
        "id",
        "unreadable",
        "high",
        F.when(n == 1, "unique").when(n == 0, "none").otherwise("several").alias("branch"),
        F.when(n == 0, F.array(*[F.lit(x) for x in LABELS]))
        .otherwise(F.col("high.label"))
        .alias("candidates"),
        *measures,
    )


def undecided(decisions: DataFrame) -> DataFrame:
    """Readable documents that need the few-shot round."""
    return decisions.filter("unreadable = 0 AND branch <> 'unique'")


def classify_by_replies(decisions: DataFrame, second_round: DataFrame) -> DataFrame:
    """(id, branch, predicted_class, confidence, high_confidence_classes).

    ``second_round`` has (id, response). Documents with an unreadable reply are
    not in the result (see :func:`dead_letters`).
    """
    answered = settle(decisions, second_round)
    return answered.select(
        "id",
        "branch",
        "predicted_class",
        "confidence",
        F.map_from_entries(
            F.transform("high", lambda e: F.struct(e.label, e.score))
        ).alias("high_confidence_classes"),
    )


def settle(decisions: DataFrame, second_round: DataFrame) -> DataFrame:
    """Decisions with predicted_class, confidence and second_response; unreadable ones drop out.

    Both branches of the decision are one expression over one join by id, so the
    decisions are computed once.
    """
    second = second_round.select("id", F.col("response").alias("second_response"))
    only = F.col("branch") == "unique"
    first_label = F.get("high", F.lit(0))["label"]
    source = F.when(only, first_label).otherwise(F.col("second_response"))
    confidence = F.when(only, F.get("high", F.lit(0))["score"]).otherwise(
        F.lit(FEW_SHOT_CONFIDENCE)
    )
    return (
        decisions.filter("unreadable = 0")
        .join(second, "id", "left")
        .withColumn("predicted_class", canonical_label(source))
        .withColumn("confidence", confidence)
        .filter(F.col("predicted_class").isNotNull())
    )


def dead_letters(scores: DataFrame, decisions: DataFrame, second_round: DataFrame) -> DataFrame:
    """(id, round, label, response, reason) of every reply that cannot be read."""
    first = scores.filter(F.col("score").isNull()).select(
        "id",
        F.lit("one_vs_rest").alias("round"),
        "label",
        "response",
        F.lit("no percentage after yes").alias("reason"),
    )
    reply = F.col("response")
    second = (
        second_round.filter(canonical_label(F.coalesce(reply, F.lit(""))).isNull())
        .join(undecided(decisions).select("id"), "id", "left_semi")
        .select(
            "id",
            F.lit("few_shot").alias("round"),
            F.lit(None).cast("string").alias("label"),
            "response",
            F.lit("no class name").alias("reason"),
        )
    )
    return first.unionByName(second)


def best_score(replies: DataFrame, threshold: float = REPLY_THRESHOLD) -> DataFrame:
    """(id, predicted_class, confidence): highest score, Unknown below the threshold.

    The percentage counts whatever the reply says. A document with an unreadable
    reply gets NULLs.
    """
    scored = replies.withColumn("score", any_confidence(F.col("response")))
    best = F.max(F.struct("score", (-F.col("label_ord")).alias("rank"), "label"))
    return (
        scored.groupBy("id")
        .agg(best.alias("b"), F.count_if(F.col("score").isNull()).alias("unreadable"))
        .select(
            "id",
            F.when(
                F.col("unreadable") == 0,
                F.when(F.col("b.score") < threshold, UNKNOWN).otherwise(F.col("b.label")),
            ).alias("predicted_class"),
            F.when(F.col("unreadable") == 0, F.col("b.score")).alias("confidence"),
        )
    )


def class_and_confidence(response: Column) -> Column:
    """Struct (predicted_class, confidence) of ``Class:`` / ``Confidence: n%`` lines.

    The last line of each kind wins; Unknown and 0 when there is none. Any
    confidence line that is no number makes the confidence NULL.
    """
    lines = split_lines(response)
    classes = F.filter(lines, lambda x: x.contains("Class:"))
    others = F.filter(lines, lambda x: ~x.contains("Class:") & x.contains("Confidence:"))
    numbers = F.transform(
        others, lambda x: to_number(F.replace(F.split(x, "Confidence:")[1], F.lit("%"), F.lit("")))
    )
    last_class = F.transform(classes, lambda x: strip(F.split(x, "Class:")[1]))
    return F.struct(
        F.coalesce(F.try_element_at(last_class, F.lit(-1)), F.lit(UNKNOWN)).alias("predicted_class"),
        F.when(F.size(numbers) == 0, F.lit(0.0))
        .when(F.exists(numbers, lambda x: x.isNull()), F.lit(None))
        .otherwise(F.try_element_at(numbers, F.lit(-1)))
        .alias("confidence"),
    )


def confidence_word(word: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in CONFIDENCE_WORDS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, word), F.lit(CONFIDENCE_WORD_OTHER))


def _after_colon(part: Column) -> Column:
    return F.get(F.split(part, ": "), F.lit(1))


def dash_reply(response: Column) -> Column:
    """Struct (predicted_class, confidence) of ``Document X - Class: C - Confidence: W``.

    A missing class part is Unknown, a missing confidence part is Low. A part
    without a colon cannot be read and gives NULL.
    """
    parts = F.split(response, " - ")
    level = F.when(F.size(parts) > 2, _after_colon(F.get(parts, F.lit(2)))).otherwise(F.lit("Low"))
    return F.struct(
        F.when(F.size(parts) > 1, _after_colon(F.get(parts, F.lit(1))))
        .otherwise(F.lit(UNKNOWN))
        .alias("predicted_class"),
        F.when(level.isNotNull(), confidence_word(level)).alias("confidence"),
    )


def batch_reply_rows(replies: DataFrame) -> DataFrame:
    """(batch_no, document, predicted_class, confidence) from one reply per batch.

    Every line naming a document is read; within a reply the last line of a
    document wins. A line with a missing part gives NULLs.
    """
    lines = replies.select(
        "batch_no", F.posexplode_outer(split_lines(F.col("response"))).alias("pos", "line")
    ).filter(F.col("line").contains("Document"))
    parts = F.split("line", " - ")
    head = F.split(strip(F.get(parts, F.lit(0))), f"[{SPACE}]+")
    level = _after_colon(F.get(parts, F.lit(2)))
    read = lines.select(
        "batch_no",
        F.get(head, F.lit(1)).alias("document"),
        F.struct(
            "pos",
            _after_colon(F.get(parts, F.lit(1))).alias("predicted_class"),
            F.when(level.isNotNull(), confidence_word(level)).alias("confidence"),
        ).alias("r"),
    )
    return (
        read.groupBy("batch_no", "document")
        .agg(F.max("r").alias("r"))
        .select("batch_no", "document", "r.predicted_class", "r.confidence")
    )
