"""Rule classifier.

The rules are a small plan-time input: every feature becomes one literal column
expression, so scoring is a single narrow projection over the documents. Text is
read once and never shuffled; documents are never joined with features.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimsift.fixed_values import (
    DEFAULT_RULES,
    FAMILY_WEIGHTS,
    PATTERN_WEIGHT,
    RULE_THRESHOLD,
    SIMPLE_RULES,
    UNKNOWN,
)
from claimsift.functions.patterns import (
    feature_sql,
    fold_case,
    known_words,
    pattern_sql,
    sql_literal,
)
from claimsift.functions.plan_shape import settled

Rules = dict[str, dict[str, list[str]]]
FAMILIES = [*FAMILY_WEIGHTS, "semantic_patterns"]
_RULES_TYPE = "map<string, struct<{}>>".format(
    ", ".join(f"{f}: array<string>" for f in FAMILIES)
)


# -- rule sets as data ---------------------------------------------------------


def rules_to_json(rules: Rules = DEFAULT_RULES) -> str:
    return json.dumps(rules, indent=2)


def read_rules(text: str) -> Rules:
    """Rules from their JSON text; every class needs every family."""
    loaded = json.loads(text)
    for name, families in loaded.items():
        if set(families) != set(FAMILIES):
            raise ValueError(f"class {name!r}: expected families {FAMILIES}")
    return {n: {f: list(loaded[n][f]) for f in FAMILIES} for n in loaded}


def rules_table(json_rows: DataFrame, column: str = "rules_json") -> DataFrame:
    """JSON rule documents to rows (class, family, position, feature)."""
    parsed = json_rows.select(F.explode(F.from_json(column, _RULES_TYPE)).alias("class", "r"))
    families = F.array(
        *[F.struct(F.lit(f).alias("family"), F.col(f"r.{f}").alias("items")) for f in FAMILIES]
    )
    return (
        parsed.select("class", F.explode(families).alias("f"))
        .select("class", "f.family", F.posexplode("f.items").alias("position", "feature"))
        .withColumn("position", F.col("position").cast("bigint"))
    )


def rules_table_to_json(rows: DataFrame) -> DataFrame:
    """Inverse of :func:`rules_table`: one row, column ``rules_json``.

    A rule set is a plan-time input of a few hundred rows.
    """
    items = F.transform(
        F.array_sort(F.collect_list(F.struct("position", "feature"))), lambda x: x.feature
    )
    families = rows.groupBy("class", "family").agg(items.alias("items"))
    empty = F.array().cast("array<string>")
    per_class = families.groupBy("class").agg(
        F.map_from_entries(F.collect_list(F.struct("family", "items"))).alias("m")
    ).select(
        "class",
        F.struct(*[F.coalesce(F.col("m")[f], empty).alias(f) for f in FAMILIES]).alias("r"),
    )
    entries = F.collect_list(F.struct("class", "r"))
    return per_class.agg(F.to_json(F.map_from_entries(entries)).alias("rules_json"))


def default_rules_rows(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit(rules_to_json()).alias("rules_json"))


# -- scoring -------------------------------------------------------------------
#
# Hundreds of similar expressions are written as SQL text: one call per DataFrame
# instead of several per feature.


def _column_names(rules: Rules) -> dict[str, str]:
    """One hit column per feature; spellings that differ only in case share it."""
    names: dict[str, str] = {}
    for families in rules.values():
        for family in FAMILY_WEIGHTS:
            for feature in families[family]:
                names.setdefault(feature.lower(), f"_hit{len(names)}")
    return names


def _quoted(columns: list[str]) -> list[str]:
    return [f"`{c}`" for c in columns]


def _hit_columns(names: dict[str, str], text: str) -> list[str]:
    return [
        f"{feature_sql(f'`{text}`', '_folded', '_words', feature)} AS {name}"
        for feature, name in names.items()
    ]


def _with_words(docs: DataFrame, features, text: str) -> DataFrame:
    """Add the folded text and its known words, each computed once per document."""
    folded = docs.withColumn("_folded", fold_case(F.col(text)))
    return folded.withColumn("_words", known_words(F.col("_folded"), features))


def with_hits(docs: DataFrame, rules: Rules, text: str) -> DataFrame:
    """Add one boolean column per distinct feature and semantic pattern; drop the text."""
    names = _column_names(rules)
    keep = [c for c in docs.columns if c != text]
    patterns = [
        f"{pattern_sql(f'`{text}`', '_folded', p)} AS _pat{c}_{i}"
        for c, families in enumerate(rules.values())
        for i, p in enumerate(families.get("semantic_patterns", []))
    ]
    return _with_words(docs, names, text).selectExpr(
        *_quoted(keep), *_hit_columns(names, text), *patterns
    )


def _total(flags: list[str]) -> str:
    return " + ".join(f"CAST({f} AS INT)" for f in flags) or "0"


def _matches(rules: Rules, label: str, family: str, names: dict[str, str]) -> str:
    return _total([names[f.lower()] for f in rules[label][family]])


def _pattern_matches(rules: Rules, label: str) -> str:
    c = list(rules).index(label)
    return _total([f"_pat{c}_{i}" for i in range(len(rules[label].get("semantic_patterns", [])))])


def _truncated(matches: str, family: str) -> str:
    """Weighted matches, cut to an integer as the scores are defined."""
    top, bottom = FAMILY_WEIGHTS[family]
    return f"(({matches}) * {top}) DIV {bottom}"


def maximum_score(rules: Rules, label: str) -> float:
    families = sum(
        len(rules[label][f]) * top // bottom for f, (top, bottom) in FAMILY_WEIGHTS.items()
    )
    return families + len(rules[label]["semantic_patterns"]) * PATTERN_WEIGHT


def feature_hits(docs: DataFrame, text: str = "cleaned_text", rules: Rules = DEFAULT_RULES):
    """One row per document and feature found: (id, class, family, feature)."""
    names = _column_names(rules)
    found = [
        f"CASE WHEN {names[f.lower()]} THEN named_struct('class', {sql_literal(label)}, "
        f"'family', '{family}', 'feature', {sql_literal(f)}) END"
        for label in rules
        for family in FAMILY_WEIGHTS
        for f in rules[label][family]
    ]
    scored = with_hits(docs.select("id", text), rules, text)
    return (
        scored.selectExpr("id", f"explode(array({', '.join(found)})) AS h")
        .filter(F.col("h").isNotNull())
        .select("id", "h.*")
    )


def family_scores(docs: DataFrame, text: str = "cleaned_text", rules: Rules = DEFAULT_RULES):
    """(id, class, family, matches, score, total) with truncated weighted scores."""
    names = _column_names(rules)
    cells = [(label, family) for label in rules for family in FAMILY_WEIGHTS]
    counts = [f"{_matches(rules, *cell, names)} AS m{i}" for i, cell in enumerate(cells)]
    rows = []
    for i, (label, family) in enumerate(cells):
        top, bottom = FAMILY_WEIGHTS[family]
        rows.append(
            f"named_struct('class', {sql_literal(label)}, 'family', '{family}', "
            f"'matches', CAST(m{i} AS BIGINT), 'score', {_truncated(f'm{i}', family)}, "
            f"'total', {len(rules[label][family]) * top // bottom}L)"
        )
    scored = with_hits(docs.select("id", text), rules, text).selectExpr("id", *counts)
    return scored.selectExpr("id", f"explode(array({', '.join(rows)})) AS s").select("id", "s.*")


def pattern_scores(docs: DataFrame, text: str = "cleaned_text", rules: Rules = DEFAULT_RULES):
    """(id, class, pattern_hits, pattern_score); this score is not truncated."""
    counts = [f"{_pattern_matches(rules, label)} AS m{i}" for i, label in enumerate(rules)]
    rows = [
        f"named_struct('class', {sql_literal(label)}, 'pattern_hits', CAST(m{i} AS BIGINT), "
        f"'pattern_score', m{i} * {PATTERN_WEIGHT}D)"
        for i, label in enumerate(rules)
    ]
    scored = with_hits(docs.select("id", text), rules, text).selectExpr("id", *counts)
    return scored.selectExpr("id", f"explode(array({', '.join(rows)})) AS s").select("id", "s.*")


def _confidence(rules: Rules, label: str, names: dict[str, str]) -> str:
    limit = maximum_score(rules, label)
    if limit == 0:
        return "0.0D"
    parts = [_truncated(_matches(rules, label, f, names), f) for f in FAMILY_WEIGHTS]
    patterns = f"({_pattern_matches(rules, label)}) * {PATTERN_WEIGHT}D"
    return f"({' + '.join(parts)} + {patterns}) / {limit}D * 100"


def _scores(labels) -> str:
    """One struct per class; the negative position makes the first class win a tie."""
    rows = [
        f"named_struct('confidence', c{i}, 'rank', {-i}, 'class', {sql_literal(label)})"
        for i, label in enumerate(labels)
    ]
    return f"array({', '.join(rows)})"


def score_documents(
    docs: DataFrame, text: str = "cleaned_text", rules: Rules = DEFAULT_RULES
) -> DataFrame:
    """Replace the text by one confidence column per class, ``c0``, ``c1``, ..."""
    names = _column_names(rules)
    keep = [c for c in docs.columns if c != text]
    scores = [f"{_confidence(rules, label, names)} AS c{i}" for i, label in enumerate(rules)]
    return with_hits(docs, rules, text).selectExpr(*_quoted(keep), *scores)


def class_confidence(docs: DataFrame, text: str = "cleaned_text", rules: Rules = DEFAULT_RULES):
    """(id, class, class_ord, confidence), confidence on the 0-100 scale."""
    return (
        score_documents(docs.select("id", text), text, rules)
        .selectExpr("id", f"explode({_scores(rules)}) AS s")
        .selectExpr("id", "s.class", "CAST(-s.rank AS BIGINT) AS class_ord", "s.confidence")
    )


def _best(scored: DataFrame, keep: list[str], labels) -> DataFrame:
    """Add ``best``: the highest confidence, a tie going to the first class in rule order."""
    return settled(scored, keep, F.expr(f"array_max({_scores(labels)})").alias("best"))


def classify_by_rules(
    docs: DataFrame,
    text: str = "cleaned_text",
    rules: Rules = DEFAULT_RULES,
    threshold: float = RULE_THRESHOLD,
) -> DataFrame:
    """Replace the text by ``predicted_class`` and ``confidence``. No shuffle."""
    keep = [c for c in docs.columns if c != text]
    best = _best(score_documents(docs, text, rules), keep, rules)
    return best.select(
        *keep,
        F.when(F.col("best.confidence") < threshold, UNKNOWN)
        .otherwise(F.col("best.class"))
        .alias("predicted_class"),
        F.col("best.confidence").alias("confidence"),
    )


def classify_by_simple_rules(
    docs: DataFrame, text: str = "cleaned_text", rules: Rules = SIMPLE_RULES
) -> DataFrame:
    """Unweighted scorer: structure counts once, by the start of the text; no threshold."""
    keep = [c for c in docs.columns if c != text]
    names = _column_names({k: {**r, "structure_starts": []} for k, r in rules.items()})
    starts = [
        " OR ".join(f"startswith(`{text}`, {sql_literal(s)})" for s in r["structure_starts"])
        for r in rules.values()
    ]
    scored = _with_words(docs, names, text).selectExpr(
        *_quoted(keep),
        *_hit_columns(names, text),
        *[f"{s or 'false'} AS _start{c}" for c, s in enumerate(starts)],
    )
    confidences = []
    for c, r in enumerate(rules.values()):
        words = [f for g in ("keywords", "required_fields", "measurements") for f in r[g]]
        points = _total([*[names[f.lower()] for f in words], f"_start{c}"])
        criteria = len(words) + bool(r["structure_starts"])
        share = f"({points}) / {criteria}D * 100" if criteria else "0.0D"
        confidences.append(f"{share} AS c{c}")
    best = _best(scored.selectExpr(*_quoted(keep), *confidences), keep, rules)
    return best.select(
        *keep,
        F.col("best.class").alias("predicted_class"),
        F.col("best.confidence").alias("confidence"),
    )


def hits_and_misses(predictions: DataFrame, truth: str = "ground_truth") -> DataFrame:
    """Mark every prediction as a hit or a miss."""
    right = F.col("predicted_class") == F.col(truth)
    return predictions.withColumn("outcome", F.when(right, "hit").otherwise("miss"))

