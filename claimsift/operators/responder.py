"""Classification by a language model that is asked while the job runs.

A responder is a plug-in with two columns-in, columns-out steps: the first gets one row per document with its requests
for all classes, the second only the documents that the first round left undecided, with the prompt that shows
examples of their candidate classes. Texts never move between tasks: the decision is taken in the document's row, and
the text of an undecided document waits in that row for its second prompt.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimsift.fixed_values import LABELS, OVR_INSTRUCTION, REPLY_THRESHOLD
from claimsift.functions.plan_shape import written
from claimsift.operators.replies import classify_by_replies, dead_letters, yes_confidence
from claimsift.operators.requests import DEFAULT_EXAMPLES, DEFAULT_PROMPTS, classification_cost, few_shot_head

# adds `responses`, an array in the order of `requests`, to (id, user_text, requests)
AskClasses = Callable[[DataFrame], DataFrame]
# adds `response` to (id, user_text, candidates, prompt)
AskAgain = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Answered:
    """What the two rounds gave; all tables are keyed by id."""

    predictions: DataFrame  # id, branch, predicted_class, confidence, high_confidence_classes
    costs: DataFrame  # id, ovr_cost, few_shot_cost, total_cost
    dead_letters: DataFrame  # id, round, label, response, reason
    second_round: DataFrame  # id, response


def classify_with_responder(
    docs: DataFrame,
    ask_classes: AskClasses,
    ask_again: AskAgain,
    text: str = "cleaned_text",
    prompts: dict[str, str] = DEFAULT_PROMPTS,
    examples: dict[str, str] = DEFAULT_EXAMPLES,
    threshold: float = REPLY_THRESHOLD,
) -> Answered:
    """Ask about every class, decide, and ask again about what is undecided.

    Replies are written to the shared folder as they come, so neither a lost executor nor
    a second use of the result asks a model twice for what is already there.
    """
    requests = F.array(
        *[
            F.struct(
                F.lit(i).cast("bigint").alias("label_ord"), F.lit(label).alias("label"),
                F.lit(OVR_INSTRUCTION[0] + prompt + OVR_INSTRUCTION[1]).alias("system_text"),
            )
            for i, (label, prompt) in enumerate(prompts.items())
        ]
    )
    asked = ask_classes(docs.select("id", F.col(text).alias("user_text"), requests.alias("requests")))
    answers = F.zip_with(
        "requests", "responses",
        lambda r, said: F.struct(r.label_ord.alias("label_ord"), r.label.alias("label"), said.alias("response"), yes_confidence(said).alias("score")),
    )
    kept = F.filter("answers", lambda a: a.score >= threshold)
    n = F.size("high")
    undecided = (F.col("unreadable") == 0) & (n != 1)
    rows = written(
        asked.select("id", "user_text", answers.alias("answers"))
        .select(
            "*", F.size(F.filter("answers", lambda a: a.score.isNull())).cast("bigint").alias("unreadable"),
            F.transform(kept, lambda a: F.struct(a.label_ord.alias("label_ord"), a.label.alias("label"), a.score.alias("score"))).alias("high"),
        )
        .select(
            "id", "answers", "unreadable", "high",
            F.when(n == 1, "unique").when(n == 0, "none").otherwise("several").alias("branch"),
            F.when(n == 0, F.array(*[F.lit(x) for x in LABELS])).otherwise(F.col("high.label")).alias("candidates"),
            F.when(undecided, F.coalesce("user_text", F.lit(""))).alias("waiting"),
        )
    )
    prompt = F.concat(few_shot_head(F.col("candidates"), examples), F.lit('"'), F.col("waiting"), F.lit('"'))
    again = rows.filter("waiting IS NOT NULL").select("id", F.col("waiting").alias("user_text"), "candidates", prompt.alias("prompt"))
    second = written(ask_again(again).select("id", "response"))
    decisions = rows.select("id", "unreadable", "high", "branch", "candidates")
    scores = rows.select("id", F.explode("answers").alias("a")).select("id", "a.*")
    return Answered(
        predictions=classify_by_replies(decisions, second),
        costs=classification_cost(scores.drop("score"), second, rows.select("id", F.col("waiting").alias(text)), text, prompts, examples),
        dead_letters=dead_letters(scores, decisions, second),
        second_round=second,
    )
