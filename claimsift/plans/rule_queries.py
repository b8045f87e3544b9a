"""Rule classifier."""

from __future__ import annotations

from claimsift.fixed_values import DEFAULT_RULES, SIMPLE_RULES
from claimsift.functions.patterns import SPACE, SPACE_CLASS, WORD, escape_literal, unicode_pattern
from claimsift.operators import rules
from claimsift.plans.registry import query, quoted, rounded


def _edge(feature: str) -> str:
    """Whole-feature regex for an engine without lookaround."""
    word = lambda c: c.isalnum() or c == "_"
    left = rf"(?:^|[^{WORD}])" if word(feature[0]) else f"[{WORD}]"
    right = rf"(?:$|[^{WORD}])" if word(feature[-1]) else f"[{WORD}]"
    return left + escape_literal(feature) + right


def _flags(rule_set, families) -> str:
    """A list of structs with one constant-pattern test per feature; an empty family keeps a row."""
    rows = [
        (o, c, f, x)
        for o, (c, r) in enumerate(rule_set.items())
        for f in families
        for x in (r[f] or [None])
    ]
    return ", ".join(
        f"{{'class_ord': {o}, 'class': {quoted(c)}, 'family': {quoted(f)}, "
        + (
            f"'feature': {quoted(x)}, 'hit': regexp_matches(cleaned_text, {quoted(_edge(x))}, 'i')}}"
            if x
            else "'feature': NULL, 'hit': false}"
        )
        for o, c, f, x in rows
    )


_WEIGHTED = ["keywords", "structure_starts", "measurements", "required_fields"]
_PATTERN_FLAGS = ", ".join(
    f"{{'class_ord': {o}, 'class': {quoted(c)}, "
    f"'hit': regexp_matches(cleaned_text, {quoted(unicode_pattern(p).replace(SPACE_CLASS, f'[{SPACE}]'))}, 'i')}}"
    for o, (c, r) in enumerate(DEFAULT_RULES.items())
    for p in r["semantic_patterns"]
)
_WEIGH = "CASE family WHEN 'structure_starts' THEN {0} * 3 // 2 WHEN 'measurements' THEN {0} * 4 // 5 WHEN 'required_fields' THEN {0} * 2 ELSE {0} END"

CTES = {
    "flags": f"SELECT id, unnest([{_flags(DEFAULT_RULES, _WEIGHTED)}], recursive := true) FROM cleaned",
    "family_counts": "SELECT id, class_ord, class, family, count(*) FILTER (hit) AS matches, count(feature) AS n FROM flags GROUP BY ALL",
    "family_scores": f"SELECT id, class_ord, class, family, matches, {_WEIGH.format('matches')} AS score, {_WEIGH.format('n')} AS total FROM family_counts",
    "pattern_flags": f"SELECT id, unnest([{_PATTERN_FLAGS}], recursive := true) FROM cleaned",
    "pattern_scores": "SELECT id, class_ord, class, count(*) FILTER (hit) AS pattern_hits, count(*) AS n FROM pattern_flags GROUP BY ALL",
    "confidences": """
SELECT f.id, f.class_ord, f.class, (sum(f.score) + any_value(p.pattern_hits) * 1.5) / (sum(f.total) + any_value(p.n) * 1.5) * 100 AS confidence
FROM family_scores f JOIN pattern_scores p ON p.id = f.id AND p.class_ord = f.class_ord GROUP BY f.id, f.class_ord, f.class""",
    "best": "SELECT * FROM confidences QUALIFY row_number() OVER (PARTITION BY id ORDER BY confidence DESC, class_ord) = 1",
    "rule_predictions": """
SELECT c.id, c.file_name, c.ground_truth, CASE WHEN b.confidence < 0.4 THEN 'Unknown' ELSE b.class END AS predicted_class, b.confidence::DOUBLE AS confidence
FROM claims c JOIN best b ON b.id = c.id""",
}


def rule_predictions(v):
    """(id, file_name, ground_truth, predicted_class, confidence)."""
    return rules.classify_by_rules(
        v.cleaned.select("id", "file_name", "ground_truth", "cleaned_text")
    )


@query("SELECT id, class, family, feature FROM flags WHERE hit", **CTES)
def rule_feature_hits(v):
    return rules.feature_hits(v.cleaned)


@query("SELECT id, class, family, matches, score::BIGINT AS score, total::BIGINT AS total FROM family_scores", **CTES)
def rule_family_scores(v):
    return rules.family_scores(v.cleaned)


@query("SELECT id, class, pattern_hits, round(pattern_hits * 1.5, 6)::DOUBLE AS pattern_score FROM pattern_scores", **CTES)
def rule_pattern_scores(v):
    return rounded(rules.pattern_scores(v.cleaned), "pattern_score")


@query("SELECT id, class, class_ord::BIGINT AS class_ord, round(confidence::DOUBLE, 6) AS confidence FROM confidences", **CTES)
def rule_class_confidence(v):
    return rounded(rules.class_confidence(v.cleaned), "confidence")


@query("SELECT id, class, round(confidence::DOUBLE, 6) AS confidence FROM best", **CTES)
def rule_best_class(v):
    best = rules.classify_by_rules(v.cleaned.select("id", "cleaned_text"), threshold=float("-inf"))
    return rounded(best, "confidence").withColumnRenamed("predicted_class", "class")


@query("SELECT id, file_name, ground_truth, predicted_class, round(confidence, 6) AS confidence FROM rule_predictions", **CTES)
def classify_rules(v):
    return rounded(rule_predictions(v), "confidence")


_SIMPLE_STARTS = ", ".join(
    f"({o}, {quoted(x)})" for o, r in enumerate(SIMPLE_RULES.values()) for x in r["structure_starts"]
)
_SIMPLE_SIZES = ", ".join(
    f"({o}, {quoted(c)}, {sum(len(r[f]) for f in ('keywords', 'measurements', 'required_fields')) + bool(r['structure_starts'])})"
    for o, (c, r) in enumerate(SIMPLE_RULES.items())
)


@query("SELECT id, class AS predicted_class, round(confidence::DOUBLE, 6) AS confidence FROM simple_scores QUALIFY row_number() OVER (PARTITION BY id ORDER BY confidence DESC, class_ord) = 1",
       simple_flags=f"SELECT id, unnest([{_flags(SIMPLE_RULES, ['keywords', 'measurements', 'required_fields'])}], recursive := true) FROM cleaned",
       simple_points="SELECT id, class_ord, count(*) FILTER (hit) AS points FROM simple_flags GROUP BY ALL",
       simple_starts=f"""
SELECT DISTINCT c.id, s.class_ord FROM cleaned c CROSS JOIN (VALUES {_SIMPLE_STARTS}) s(class_ord, start) WHERE starts_with(c.cleaned_text, s.start)""",
       simple_scores=f"""
SELECT p.id, z.class_ord, z.class, (p.points + CASE WHEN s.id IS NULL THEN 0 ELSE 1 END) / z.n * 100 AS confidence
FROM simple_points p JOIN (VALUES {_SIMPLE_SIZES}) z(class_ord, class, n) ON z.class_ord = p.class_ord
LEFT JOIN simple_starts s ON s.id = p.id AND s.class_ord = p.class_ord""")
def classify_rules_simple(v):
    return rounded(rules.classify_by_simple_rules(v.cleaned.select("id", "cleaned_text")), "confidence")


@query("""SELECT id, file_name, ground_truth, predicted_class, round(confidence, 6) AS confidence,
       CASE WHEN predicted_class = ground_truth THEN 'hit' ELSE 'miss' END AS outcome FROM rule_predictions""", **CTES)
def rule_hits_and_misses(v):
    return rounded(rules.hits_and_misses(rule_predictions(v)), "confidence")
