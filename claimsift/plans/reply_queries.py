"""Language-model classifier as table work."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimsift.fixed_values import BATCH_REPLY_FORMAT, LABEL_PRIORITY, LABELS, OVR_INSTRUCTION
from claimsift.functions.patterns import SPACE, TOKEN
from claimsift.operators import replies, requests, responder
from claimsift.plans.registry import query, quoted, rounded

def _strip(text: str) -> str:
    return f"regexp_replace({text}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def _tokens(text: str) -> str:
    return f"len(regexp_extract_all({text}, {quoted(TOKEN)}))"


_NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _number(text: str) -> str:
    trimmed = _strip(text)
    return f"CASE WHEN regexp_matches({trimmed}, '{_NUMBER}') THEN TRY_CAST({trimmed} AS DOUBLE) END"


_HEAD = _strip("split_part(lower(coalesce(response, '')), '%', 1)")
_PERCENT = f"({_number(f'string_split({_HEAD}, chr(32))[-1]')}) / 100"
_CANONICAL = "CASE " + " ".join(
    f"WHEN contains({{0}}, '{x}') THEN '{x}'" for x in LABEL_PRIORITY
) + " END"
_PROMPT_ROWS = ", ".join(
    f"({i}, {quoted(k)}, {quoted(p)}, {quoted(requests.DEFAULT_EXAMPLES[k])})"
    for i, (k, p) in enumerate(requests.DEFAULT_PROMPTS.items())
)

CTES = {
    "prompts": f"SELECT * FROM (VALUES {_PROMPT_ROWS}) p(label_ord, label, prompt, example)",
    "reply_scores": f"""
SELECT *, CASE WHEN contains(lower(coalesce(response, '')), 'yes') THEN {_PERCENT} ELSE 0.0 END::DOUBLE AS score FROM llm_responses""",
    "decisions": """
SELECT id, count(*) FILTER (score IS NULL) AS unreadable, count(*) FILTER (score >= 0.5) AS n_high,
       CASE count(*) FILTER (score >= 0.5) WHEN 1 THEN 'unique' WHEN 0 THEN 'none' ELSE 'several' END AS branch,
       string_agg(label, ', ' ORDER BY label_ord) FILTER (score >= 0.5) AS high_labels,
       string_agg(concat(label, '=', printf('%.4f', score)), ';' ORDER BY label_ord) FILTER (score >= 0.5) AS high_map,
       max(label) FILTER (score >= 0.5) AS top_label, max(score) AS top_score
FROM reply_scores GROUP BY id""",
    "candidates": """
SELECT d.id, p.label_ord, p.label, p.example FROM decisions d JOIN reply_scores s ON s.id = d.id JOIN prompts p ON p.label_ord = s.label_ord
WHERE d.unreadable = 0 AND d.branch <> 'unique' AND (d.branch = 'none' OR s.score >= 0.5)""",
    "few_shot_heads": """
SELECT id, string_agg(label, ', ' ORDER BY label_ord) AS candidate_list,
       concat(string_agg(example, chr(10) || chr(10) ORDER BY label_ord), chr(10), chr(10),
              'Which one of the classes ', string_agg(label, ', ' ORDER BY label_ord), ' fits this text best?', chr(10), 'Text: ') AS head
FROM candidates GROUP BY id""",
    "reply_predictions": f"""
SELECT id, branch, top_label AS predicted_class, top_score AS confidence, high_map FROM decisions WHERE unreadable = 0 AND branch = 'unique'
UNION ALL
SELECT d.id, d.branch, {_CANONICAL.format('f.response')} AS predicted_class, 0.9::DOUBLE AS confidence, d.high_map
FROM decisions d JOIN few_shot_responses f ON f.id = d.id
WHERE d.unreadable = 0 AND d.branch <> 'unique' AND {_CANONICAL.format('f.response')} IS NOT NULL""",
}


def _map_text(column):
    """The map as 'label=0.1234;...' in class order, comparable across engines."""
    entries = F.map_entries(column)
    return F.nullif(
        F.array_join(F.transform(entries, lambda e: F.format_string("%s=%.4f", e.key, e.value)), ";"),
        F.lit(""),
    )


def _decisions(v):
    return replies.decide(replies.score_replies(v.llm_responses))


def reply_predictions(v):
    """(id, branch, predicted_class, confidence, high_confidence_classes)."""
    return replies.classify_by_replies(_decisions(v), v.few_shot_responses)


@query(f"""SELECT c.id, p.label_ord::BIGINT AS label_ord, p.label, concat({quoted(OVR_INSTRUCTION[0])}, p.prompt, {quoted(OVR_INSTRUCTION[1])}) AS system_text,
       c.cleaned_text AS user_text FROM cleaned c CROSS JOIN prompts p""", **CTES)
def ovr_requests(v):
    return requests.one_vs_rest_requests(v.cleaned)


@query("SELECT id, label, response, round(score, 6) AS score FROM reply_scores", **CTES)
def parse_yes_confidence(v):
    scored = replies.score_replies(v.llm_responses)
    return rounded(scored.select("id", "label", "response", "score"), "score")


@query("""SELECT id, string_agg(concat(label, '=', printf('%.4f', score)), ';' ORDER BY label_ord) AS high_confidence_classes
FROM reply_scores WHERE score >= 0.5 GROUP BY id""", **CTES)
def high_confidence_map(v):
    maps = replies.high_confidence_map(replies.score_replies(v.llm_responses))
    return maps.select("id", _map_text(F.col("high_confidence_classes")).alias("high_confidence_classes"))


@query(f"SELECT id, unreadable, n_high, branch, CASE WHEN n_high = 0 THEN {quoted(', '.join(LABELS))} ELSE high_labels END AS candidate_list FROM decisions", **CTES)
def ovr_decision(v):
    return _decisions(v).select(
        "id", "unreadable", F.size("high").cast("bigint").alias("n_high"), "branch",
        F.array_join("candidates", ", ").alias("candidate_list"),
    )


@query("SELECT h.id, h.candidate_list, concat(h.head, '\"', c.cleaned_text, '\"') AS prompt FROM few_shot_heads h JOIN cleaned c ON c.id = h.id", **CTES)
def few_shot_requests(v):
    return requests.few_shot_requests(replies.undecided(_decisions(v)), v.cleaned)


@query(f"SELECT id, response, {_CANONICAL.format('response')} AS label FROM few_shot_responses")
def canonical_label(v):
    return v.few_shot_responses.select(
        "id", "response", replies.canonical_label(F.col("response")).alias("label")
    )


@query("SELECT id, branch, predicted_class, round(confidence, 6) AS confidence, high_map AS high_confidence_classes FROM reply_predictions", **CTES)
def classify_llm(v):
    return rounded(
        reply_predictions(v).withColumn("high_confidence_classes", _map_text(F.col("high_confidence_classes"))),
        "confidence",
    )


# replies that a responder made of columns takes from the text: a word for each class
_CUES = dict(zip(LABELS, ["compliance", "apnea", "order", "deliver", "physician", "prescription"]))
_CUE_ROWS = ", ".join(f"({i}, '{label}', '{cue}')" for i, (label, cue) in enumerate(_CUES.items()))
ASKED = {
    **CTES,
    "llm_responses": f"""
SELECT c.id, l.label_ord::BIGINT AS label_ord, l.label,
       CASE WHEN NOT contains(lower(c.raw_text), l.cue) THEN 'No, 5%' WHEN length(c.raw_text) % 29 = 0 THEN 'Yes'
            ELSE concat('Yes, ', 40 + (length(c.raw_text) + 7 * l.label_ord) % 60, '%') END AS response
FROM claims c CROSS JOIN (VALUES {_CUE_ROWS}) l(label_ord, label, cue)""",
    "few_shot_responses": f"""
SELECT id, CASE WHEN length(raw_text) % 23 = 0 THEN 'I cannot tell'
            ELSE concat('Class: ', ([{', '.join(f"'{x}'" for x in LABELS)}])[length(raw_text) % {len(LABELS)} + 1]) END AS response FROM claims""",
}


def _ask_classes(asked):
    cues = F.create_map(*[F.lit(x) for pair in _CUES.items() for x in pair])
    size = F.length("user_text")

    def said(request):
        share = F.concat(F.lit("Yes, "), (40 + (size + 7 * request.label_ord) % 60).cast("string"), F.lit("%"))
        known = F.lower("user_text").contains(F.element_at(cues, request.label))
        return F.when(~known, "No, 5%").when(size % 29 == 0, "Yes").otherwise(share)

    return asked.withColumn("responses", F.transform("requests", said))


def _ask_again(asked):
    size = F.length("user_text")
    label = F.element_at(F.array(*[F.lit(x) for x in LABELS]), size % len(LABELS) + 1)
    return asked.withColumn("response", F.when(size % 23 == 0, "I cannot tell").otherwise(F.concat(F.lit("Class: "), label)))


def _answered(v):
    return responder.classify_with_responder(v.raw_claims.select("id", "raw_text"), _ask_classes, _ask_again, "raw_text")


@query("SELECT id, branch, predicted_class, round(confidence, 6) AS confidence, high_map AS high_confidence_classes FROM reply_predictions", **ASKED)
def classify_by_responder(v):
    """Both rounds are asked while the job runs, from the text."""
    maps = _map_text(F.col("high_confidence_classes"))
    return rounded(_answered(v).predictions.withColumn("high_confidence_classes", maps), "confidence")


@query(f"""
SELECT id, 'one_vs_rest' AS round, label, response FROM reply_scores WHERE score IS NULL
UNION ALL
SELECT f.id, 'few_shot', NULL, f.response FROM few_shot_responses f JOIN decisions d ON d.id = f.id
WHERE d.unreadable = 0 AND d.branch <> 'unique' AND {_CANONICAL.format('f.response')} IS NULL""", **ASKED)
def responder_dead_letters(v):
    return _answered(v).dead_letters.select("id", "round", "label", "response")


@query("SELECT f.id, f.response FROM few_shot_responses f JOIN decisions d ON d.id = f.id WHERE d.unreadable = 0 AND d.branch <> 'unique'", **ASKED)
def responder_second_round(v):
    """Exactly the undecided documents are asked about again."""
    return _answered(v).second_round


@query(f"""
SELECT id, CASE WHEN unreadable = 0 THEN CASE WHEN score < 0.5 THEN 'Unknown' ELSE label END END AS predicted_class,
       CASE WHEN unreadable = 0 THEN round(score, 6) END AS confidence FROM (
  SELECT *, count(*) FILTER (score IS NULL) OVER (PARTITION BY id) AS unreadable,
         row_number() OVER (PARTITION BY id ORDER BY score DESC NULLS LAST, label_ord) AS place
  FROM (SELECT *, {_PERCENT} AS score FROM llm_responses)) WHERE place = 1""")
def ovr_best_score(v):
    return rounded(replies.best_score(v.llm_responses), "confidence")


_LINES = "string_split(response, chr(10))"
_CLASS_LINES = f"list_filter({_LINES}, lambda x: contains(x, 'Class:'))"
_CONF_LINES = f"list_filter({_LINES}, lambda x: NOT contains(x, 'Class:') AND contains(x, 'Confidence:'))"
_CLASS_PART = f"split_part({_CLASS_LINES}[-1], 'Class:', 2)"
_CONF_PART = f"replace(split_part({_CONF_LINES}[-1], 'Confidence:', 2), '%', '')"


@query(f"""SELECT id, CASE WHEN len({_CLASS_LINES}) = 0 THEN 'Unknown' ELSE {_strip(_CLASS_PART)} END AS predicted_class,
       CASE WHEN len({_CONF_LINES}) = 0 THEN 0.0 ELSE {_number(_CONF_PART)} END::DOUBLE AS confidence FROM few_shot_responses""")
def parse_class_confidence_lines(v):
    read = replies.class_and_confidence(F.col("response")).alias("r")
    return v.few_shot_responses.select("id", read).select("id", "r.predicted_class", "r.confidence")


_WORD = "CASE {0} WHEN 'Low' THEN 0.3 WHEN 'Medium' THEN 0.6 WHEN 'High' THEN 0.9 ELSE 0.5 END"


@query(f"""
SELECT id, CASE WHEN len(parts) > 1 THEN string_split(parts[2], ': ')[2] ELSE 'Unknown' END AS predicted_class,
       CASE WHEN len(parts) <= 2 THEN 0.3 WHEN len(string_split(parts[3], ': ')) < 2 THEN NULL
            ELSE {_WORD.format("string_split(parts[3], ': ')[2]")} END::DOUBLE AS confidence
FROM (SELECT id, string_split(response, ' - ') AS parts FROM dash_responses)""")
def parse_dash_response(v):
    read = replies.dash_reply(F.col("response")).alias("r")
    return v.dash_responses.select("id", read).select("id", "r.predicted_class", "r.confidence")


@query(f"""
SELECT batch_no, regexp_split_to_array(trim(parts[1]), '\\s+')[2] AS document, string_split(parts[2], ': ')[2] AS predicted_class,
       CASE WHEN len(string_split(parts[3], ': ')) < 2 OR len(parts) < 3 THEN NULL
            ELSE {_WORD.format("string_split(parts[3], ': ')[2]")} END::DOUBLE AS confidence
FROM (SELECT batch_no, string_split(line, ' - ') AS parts FROM (
  SELECT batch_no, unnest(string_split(response, chr(10))) AS line FROM batch_responses) WHERE contains(line, 'Document'))""")
def parse_batch_response(v):
    return replies.batch_reply_rows(v.batch_responses)


_BATCH_HEAD = (
    f"Choose one class for each document: {', '.join(LABELS)}. Answer one line each as "
    f'"{BATCH_REPLY_FORMAT}"'
)


@query(f"""SELECT (n // 16)::BIGINT AS batch_no, count(*) AS documents,
       concat({quoted(_BATCH_HEAD)}, chr(10), chr(10), string_agg(concat('Document ', id, ': ', cleaned_text), chr(10) ORDER BY id)) AS prompt
FROM (SELECT *, row_number() OVER (ORDER BY id) - 1 AS n FROM cleaned) GROUP BY ALL""")
def batch_requests(v):
    return requests.batch_requests(v.cleaned)


_EXAMPLES = "".join(f"{e}\n\n" for e in requests.DEFAULT_EXAMPLES.values())


@query(f"""SELECT (n // 16)::BIGINT AS batch_no, count(*) AS documents,
       concat({quoted(_EXAMPLES + _BATCH_HEAD)}, chr(10), chr(10), string_agg(concat('Document ', id, ': ', cleaned_text), chr(10) ORDER BY id)) AS prompt
FROM (SELECT *, row_number() OVER (ORDER BY id) - 1 AS n FROM cleaned) GROUP BY ALL""")
def batch_requests_with_examples(v):
    return requests.batch_requests(v.cleaned, examples=requests.DEFAULT_EXAMPLES)


@query(f"""SELECT id, concat({quoted(_EXAMPLES + "Choose one class for the document: " + ', '.join(LABELS) + ". Give the class and your confidence as a percentage.")},
       chr(10), chr(10), 'Document:', chr(10), cleaned_text) AS prompt FROM cleaned""")
def direct_requests_with_examples(v):
    return requests.direct_requests(v.cleaned, examples=requests.DEFAULT_EXAMPLES)


@query(f"""SELECT id, concat({quoted("Choose one class for the document: " + ', '.join(LABELS) + ". Give the class and your confidence as a percentage.")},
       chr(10), chr(10), 'Document:', chr(10), cleaned_text) AS prompt FROM cleaned""")
def direct_requests(v):
    return requests.direct_requests(v.cleaned)


def _cost_sql(text: str) -> str:
    return f"""
SELECT id, round(ovr::DOUBLE, 8) AS ovr_cost, round(few::DOUBLE, 8) AS few_shot_cost, round((ovr + few)::DOUBLE, 8) AS total_cost FROM (
  SELECT r.id, (o.asked * {requests.INPUT_PRICE} + o.said * {requests.OUTPUT_PRICE:f})::DECIMAL(28,8) AS ovr,
         CASE WHEN h.id IS NULL THEN 0 ELSE ({_tokens("h.head || chr(34) || chr(34)")} + {_tokens(f"c.{text}")}) * {requests.INPUT_PRICE:f}
              + {_tokens("f.response")} * {requests.OUTPUT_PRICE:f} END::DECIMAL(28,8) AS few
  FROM reply_predictions r JOIN {'cleaned' if text == 'cleaned_text' else 'claims'} c ON c.id = r.id
  JOIN (SELECT s.id, sum({_tokens("p.prompt")}) AS asked, sum({_tokens("lower(s.response)")}) AS said
        FROM llm_responses s JOIN prompts p ON p.label_ord = s.label_ord GROUP BY s.id) o ON o.id = r.id
  LEFT JOIN few_shot_heads h ON h.id = r.id LEFT JOIN few_shot_responses f ON f.id = r.id)""".replace(str(requests.INPUT_PRICE), f"{requests.INPUT_PRICE:f}")


@query(_cost_sql("cleaned_text"), **CTES)
def classification_cost(v):
    costs = requests.classification_cost(v.llm_responses, v.few_shot_responses, v.cleaned)
    return rounded(costs, "ovr_cost", "few_shot_cost", "total_cost", places=8)


@query(_cost_sql("raw_text"), **ASKED)
def responder_cost(v):
    return rounded(_answered(v).costs, "ovr_cost", "few_shot_cost", "total_cost", places=8)


@query("""
SELECT text_hash, label, documents, first_id FROM (
  SELECT sha256(text) AS text_hash, l.label, count(*) AS documents, min(d.doc_id) AS first_id FROM doc_class d CROSS JOIN label_dim l GROUP BY ALL)
WHERE (text_hash, label) NOT IN (SELECT (sha256(text), l.label) FROM doc_class d JOIN label_dim l ON l.label_ord = d.truth_ord)""")
def uncached_requests(v):
    """Every text was asked about its own class before; the other classes are new."""
    docs, cache = _docs_and_cache(v)
    return requests.uncached_requests(docs, cache, "text")


def _docs_and_cache(v):
    texts = v.doc_class.select(F.col("doc_id").alias("id"), "text", "truth_ord")
    asked = texts.join(F.broadcast(v.label_dim), F.col("label_ord") == F.col("truth_ord"))
    cache = asked.select(F.sha2("text", 256).alias("text_hash"), "label").distinct()
    return texts.select("id", "text"), cache.withColumn("response", F.lit("known"))


@query("""
SELECT d.doc_id AS id, CAST(l.label_ord AS BIGINT) AS label_ord, l.label,
       CASE WHEN k.label IS NULL THEN concat('Yes, ', length(d.text) % 100, '%') ELSE 'known' END AS response
FROM doc_class d CROSS JOIN label_dim l
LEFT JOIN (SELECT DISTINCT text, c.label FROM doc_class JOIN label_dim c ON c.label_ord = truth_ord) k ON k.text = d.text AND k.label = l.label""")
def answer_requests(v):
    """Known replies from the cache, the others from a responder made of columns."""
    docs, cache = _docs_and_cache(v)
    answer = F.concat(F.lit("Yes, "), (F.length("user_text") % 100).cast("string"), F.lit("%"))
    return requests.answer_requests(
        docs, cache, lambda asked: asked.withColumn("response", answer), "text"
    )


@query(f"""
SELECT id, 'one_vs_rest' AS round, label, response, 'no percentage after yes' AS reason FROM reply_scores WHERE score IS NULL
UNION ALL
SELECT f.id, 'few_shot', NULL, f.response, 'no class name' FROM few_shot_responses f JOIN decisions d ON d.id = f.id
WHERE d.unreadable = 0 AND d.branch <> 'unique' AND {_CANONICAL.format('f.response')} IS NULL""", **CTES)
def dead_letter_rows(v):
    scores = replies.score_replies(v.llm_responses)
    return replies.dead_letters(scores, replies.decide(scores), v.few_shot_responses)
