"""Requests to a language model: wording, fan-out, reuse of known replies, cost.

The model itself is a plug-in: a responder takes a DataFrame of requests and adds
a ``response`` column (``mapInPandas`` around a client, or a join with stored
replies). Everything here is columns.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimsift.fixed_values import BATCH_REPLY_FORMAT, LABELS, OVR_INSTRUCTION
from claimsift.functions.bloom import keys_kept, rows_of_keys
from claimsift.functions.patterns import token_count
from claimsift.functions.plan_shape import written
from claimsift.operators.ordering import row_numbers
from claimsift.operators.replies import decide, score_replies, settle

Responder = Callable[[DataFrame], DataFrame]

# Default class descriptions and examples; pass your own with `load_prompts`.
DEFAULT_PROMPTS = {
    "Compliance": "A device compliance report with usage days, hours per night and a compliance percentage",
    "Sleep": "The result of a clinical sleep study with apnea index, sleep time and sleep efficiency",
    "Order": "An order for medical equipment or supplies with order number, provider and items",
    "Delivery": "A receipt that confirms the delivery of medical equipment, dated and signed",
    "Physician": "Notes a physician took in a consultation with assessment, diagnosis and plan",
    "Prescription": "A prescription of a medication with dosage, quantity and refills",
}
DEFAULT_EXAMPLES = {
    "Compliance": 'Document: "Usage 01/01 to 01/31, days used 28 of 31, average 6 hours"\nClass: Compliance',
    "Sleep": 'Document: "Polysomnography, AHI 18, sleep efficiency 81 %, REM 20 %"\nClass: Sleep',
    "Order": 'Document: "Order 4711, one mask and tubing, ordered by Dr. Roe"\nClass: Order',
    "Delivery": 'Document: "Delivered on 02/03/2023, one device, signed by A. Poe"\nClass: Delivery',
    "Physician": 'Document: "Follow up visit. Assessment: stable. Plan: continue"\nClass: Physician',
    "Prescription": 'Document: "Take 1 tablet daily, quantity 30, refills 2"\nClass: Prescription',
}

# Default price per token of a request and of a reply; a vendor's price is a parameter.
INPUT_PRICE = Decimal("0.00000015")
OUTPUT_PRICE = Decimal("0.00000060")


def load_prompts(text: str) -> dict[str, str]:
    """Class descriptions or examples from a JSON object label -> text."""
    loaded = json.loads(text)
    if not loaded or not all(isinstance(v, str) for v in loaded.values()):
        raise ValueError("expected a JSON object of strings")
    return loaded


def _fan_out(prompts: dict[str, str]) -> Column:
    """One entry per class as an array in the row: no join with a class table."""
    return F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(i).cast("bigint").alias("label_ord"),
                    F.lit(label).alias("label"),
                    F.lit(OVR_INSTRUCTION[0] + prompt + OVR_INSTRUCTION[1]).alias("system_text"),
                )
                for i, (label, prompt) in enumerate(prompts.items())
            ]
        )
    )


def one_vs_rest_requests(
    docs: DataFrame, text: str = "cleaned_text", prompts: dict[str, str] = DEFAULT_PROMPTS
) -> DataFrame:
    """(id, label_ord, label, system_text, user_text): one request per document and class."""
    return docs.select("id", F.col(text).alias("user_text"), _fan_out(prompts).alias("q")).select(
        "id", "q.label_ord", "q.label", "q.system_text", "user_text"
    )


def _examples_first(examples: dict[str, str] | None) -> str:
    return "".join(f"{example}\n\n" for example in (examples or {}).values())


def direct_requests(
    docs: DataFrame, text: str = "cleaned_text", labels=tuple(LABELS), examples: dict[str, str] | None = None
) -> DataFrame:
    """(id, prompt): ask for the class and a percentage in one request, with examples in front if given."""
    head = _examples_first(examples) + (
        f"Choose one class for the document: {', '.join(labels)}. "
        "Give the class and your confidence as a percentage.\n\nDocument:\n"
    )
    return docs.select("id", F.concat(F.lit(head), F.col(text)).alias("prompt"))


def batch_requests(
    docs: DataFrame, text: str = "cleaned_text", batch_size: int = 16, labels=tuple(LABELS),
    examples: dict[str, str] | None = None,
) -> DataFrame:
    """(batch_no, documents, prompt): one request for up to ``batch_size`` documents.

    Documents are numbered in order of their unique id, so all batches but the last are full.
    """
    head = _examples_first(examples) + (
        f"Choose one class for each document: {', '.join(labels)}. Answer one line each as "
        f'"{BATCH_REPLY_FORMAT}"\n\n'
    )
    line = F.concat(F.lit("Document "), F.col("id").cast("string"), F.lit(": "), F.col(text))
    lines = F.array_sort(F.collect_list(F.struct(F.col("id"), line.alias("line"))))
    numbers = row_numbers(docs.select("id"), "id", "_n")
    batch = F.floor((F.col("_n") - 1) / F.lit(batch_size)).cast("bigint")
    return (
        docs.join(numbers.select("id", batch.alias("batch_no")), "id")
        .groupBy("batch_no")
        .agg(lines.alias("d"))
        .select(
            "batch_no",
            F.size("d").cast("bigint").alias("documents"),
            F.concat(F.lit(head), F.array_join("d.line", "\n")).alias("prompt"),
        )
    )


def few_shot_head(candidates: Column, examples: dict[str, str] = DEFAULT_EXAMPLES) -> Column:
    """Examples of the candidate classes, then the class list."""
    known = F.create_map(*[F.lit(x) for pair in examples.items() for x in pair])
    shown = F.array_join(F.transform(candidates, lambda c: known[c]), "\n\n")
    return F.concat(
        shown,
        F.lit("\n\nWhich one of the classes "),
        F.array_join(candidates, ", "),
        F.lit(" fits this text best?\nText: "),
    )


def few_shot_requests(
    undecided: DataFrame,
    docs: DataFrame,
    text: str = "cleaned_text",
    examples: dict[str, str] = DEFAULT_EXAMPLES,
) -> DataFrame:
    """(id, candidate_list, prompt) for rows (id, candidates array) that need a second look.

    Only the texts of undecided documents, and of the few that a filter takes for such, leave the scan.
    """
    wanted = undecided.select("id", "candidates")
    return rows_of_keys(docs.select("id", F.col(text).alias("_text")), wanted, "id").select(
        "id",
        F.array_join("candidates", ", ").alias("candidate_list"),
        F.concat(few_shot_head(F.col("candidates"), examples), F.lit('"'), F.col("_text"), F.lit('"')).alias("prompt"),
    )


def _text_hash(text: str) -> Column:
    """Key of a text; all NULL texts share one of their own."""
    return F.coalesce(F.sha2(F.col(text), 256), F.lit("no text"))


def _distinct_texts(docs: DataFrame, text: str) -> DataFrame:
    """(text_hash, documents, first_id); a text with many copies is one row per task before it moves."""
    return (
        docs.select("id", _text_hash(text).alias("text_hash"))
        .groupBy("text_hash")
        .agg(F.count("*").alias("documents"), F.min("id").alias("first_id"))
    )


def uncached_requests(
    docs: DataFrame,
    cache: DataFrame,
    text: str = "cleaned_text",
    prompts: dict[str, str] = DEFAULT_PROMPTS,
) -> DataFrame:
    """(text_hash, label, documents, first_id): what still has to be asked.

    Copies of a text share one request per class. Hashes move, texts do not, and the
    classes are added after the copies have been counted.
    """
    wanted = _distinct_texts(docs, text).select("*", _fan_out(prompts).alias("q"))
    known = cache.select("text_hash", "label")
    return wanted.select("text_hash", "q.label", "documents", "first_id").join(
        known, ["text_hash", "label"], "left_anti"
    )


def answer_requests(
    docs: DataFrame,
    cache: DataFrame,
    responder: Responder,
    text: str = "cleaned_text",
    prompts: dict[str, str] = DEFAULT_PROMPTS,
) -> DataFrame:
    """(id, label_ord, label, response) for every document and class.

    The responder is asked once per new (text, class); ``cache`` has
    (text_hash, label, response), unique per key, and answers the rest. The
    responder gets text_hash, label_ord, label, system_text, user_text and adds
    ``response``; a NULL text is asked about as NULL. Keys are worked out on hashes. Only
    the texts to ask about, and the few that a filter takes for such, leave the scan.
    Replies go back as one row per text; both sides of that join are shuffled for it, so
    Spark splits a text with very many copies.
    """
    hashed = docs.select("id", _text_hash(text).alias("text_hash"))
    wanted = (
        _distinct_texts(docs, text)
        .select(F.col("first_id").alias("id"), "text_hash", _fan_out(prompts).alias("q"))
        .select("id", "text_hash", "q.*")
    )
    key = ["text_hash", "label"]
    known = wanted.join(cache.select(*key, "response"), key)
    missing = (
        wanted.join(cache.select(*key), key, "left_anti")
        .groupBy("id", "text_hash")
        .agg(F.collect_list(F.struct("label_ord", "label", "system_text")).alias("q"))
    )
    asked = (
        rows_of_keys(docs.select("id", F.col(text).alias("user_text")), missing, "id")
        .select("text_hash", "user_text", F.explode_outer("q").alias("q"))
        .select("text_hash", "user_text", "q.*")
    )
    columns = ["text_hash", "label_ord", "label", "response"]
    replies = (
        known.select(columns)
        .unionByName(responder(asked).select(columns))
        .groupBy("text_hash")
        .agg(F.collect_list(F.struct("label_ord", "label", "response")).alias("a"))
    )
    return (
        hashed.join(written(replies), "text_hash")
        .select("id", F.explode_outer("a").alias("a"))
        .select("id", "a.*")
    )


def request_cost(n_tokens: Column, price: Decimal) -> Column:
    return n_tokens.cast("decimal(18,0)") * F.lit(price).cast("decimal(18,8)")


def classification_cost(
    answers: DataFrame,
    second_round: DataFrame,
    docs: DataFrame,
    text: str = "cleaned_text",
    prompts: dict[str, str] = DEFAULT_PROMPTS,
    examples: dict[str, str] = DEFAULT_EXAMPLES,
    input_price: Decimal = INPUT_PRICE,
    output_price: Decimal = OUTPUT_PRICE,
    include_document: bool = False,
) -> DataFrame:
    """(id, ovr_cost, few_shot_cost, total_cost) as decimals, per classified document.

    ``answers`` has (id, label_ord, label, response) of the one-vs-rest round,
    ``second_round`` has (id, response) of the few-shot round. A one-vs-rest request
    counts its class description only, unless ``include_document``. Only then every text
    is tokenised; otherwise only those of undecided documents are, and numbers of tokens
    are what is joined, so text is never shuffled.
    """
    described = F.create_map(*[F.lit(x) for pair in prompts.items() for x in pair])
    counted = score_replies(answers).select(
        "id", "label_ord", "label", "score",
        token_count(described[F.col("label")]).alias("asked"),
        token_count(F.lower(F.coalesce("response", F.lit("")))).alias("said"),
    )
    decisions = decide(
        counted, asked=F.sum("asked"), said=F.sum("said"), rounds=F.count("*")
    )
    settled = written(settle(decisions, second_round))
    if include_document:
        joined = settled.join(docs.select("id", token_count(F.col(text)).alias("text_tokens")), "id")
    else:
        texts = docs.select("id", F.col(text).alias("_text"))
        wanted = settled.filter("branch <> 'unique'").select("id")
        sized = keys_kept(texts, wanted, "id").select("id", token_count(F.col("_text")).alias("text_tokens"))
        joined = settled.join(sized, "id", "left")
    asked = F.col("asked")
    if include_document:
        asked = asked + F.col("rounds") * F.col("text_tokens")
    head = token_count(F.concat(few_shot_head(F.col("candidates"), examples), F.lit('""')))
    reply = token_count(F.coalesce("second_response", F.lit("")))
    few_shot = F.when(F.col("branch") == "unique", F.lit(0)).otherwise(
        request_cost(head + F.col("text_tokens"), input_price)
        + request_cost(reply, output_price)
    )
    ovr = request_cost(asked, input_price) + request_cost(F.col("said"), output_price)
    money = "decimal(28,8)"
    return joined.select(
        "id", ovr.cast(money).alias("ovr_cost"), few_shot.cast(money).alias("few_shot_cost")
    ).withColumn("total_cost", (F.col("ovr_cost") + F.col("few_shot_cost")).cast(money))
