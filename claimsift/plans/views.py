"""Test corpora derived from the given tables, in Spark and as SQL for the oracle.

The given documents have almost no claim-like text, so each gets the lines of a
claim form in front of its own whole text. Every view covers its whole table. The
SQL text is shared by both engines except for row fan-out, which Spark writes as a
generator over an array in the row and the oracle as a join with a small list.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimsift.fixed_values import LABELS
from claimsift.functions.patterns import SPACE, WORD
from claimsift.operators.cleaning import clean_text
from claimsift.operators.prototypes import first_vectors_per_label

TABLES = ["documents", "embeddings", "pages", "conversations", "labels", "benchmark"]
METHODS = ["plain", "no_marks", "split_hyphens"]


def _fan_out(engine: str, alias: str, ordinal: str, name: str, items: list[str]) -> str:
    if engine == "spark":
        listed = ", ".join(f"'{x}'" for x in items)
        return f"LATERAL VIEW posexplode(array({listed})) {alias} AS {ordinal}, {name}"
    listed = ", ".join(f"({i}, '{x}')" for i, x in enumerate(items))
    return f"CROSS JOIN (VALUES {listed}) {alias}({ordinal}, {name})"


def view_sql(engine: str) -> dict[str, str]:
    """View name -> SQL, in order of dependence."""
    label_fan = _fan_out(engine, "l", "label_ord", "label", LABELS)
    method_fan = _fan_out(engine, "m", "method_ord", "method", METHODS)
    version_fan = _fan_out(engine, "s", "version", "version_name", ["first", "second"])
    label_rows = ", ".join(f"({i}, '{x}')" for i, x in enumerate(LABELS))
    views = {}

    views["doc_class"] = """
SELECT doc_id, source, lang, text, n_chars, doc_id % 6 AS truth_ord,
       CASE WHEN doc_id % 11 = 0 THEN -1 WHEN doc_id % 7 = 0 THEN (doc_id + 1) % 6 ELSE doc_id % 6 END AS body_ord
FROM documents"""

    views["label_dim"] = f"""
SELECT * FROM (VALUES {label_rows}) t(label_ord, label)"""

    views["claims"] = """
SELECT d.doc_id AS id,
       concat(l.label, ' ', d.source, ' ', d.doc_id, '.pdf') AS file_name,
       concat('/claims/', l.label, ' ', d.source, ' ', d.doc_id, '.pdf') AS file_location,
       concat(replace(CASE d.body_ord
         WHEN 0 THEN 'AirView Compliance Report|Usage days 25, compliance percentage 85%|Average usage 5 hours per night|Therapy hours 176,leak rate 12L/min, AHI 3.5|Phone: 555-0101|'
         WHEN 1 THEN 'MUSC Sleep Study Report|Patient Name: Kim|Study date 03/27/2023|AHI: 22.5, apnea index 4, total sleep time 5 hours|Sleep efficiency: 84%|REM arousal hypopnea oxygen saturation|'
         WHEN 2 THEN 'Order Date: 4-5-2023|MRN # 12345|Medical record: 12345|Provider: Lee|Equipment description: mask|Order # 77, authorized supply requested|Fax: 555-0102|'
         WHEN 3 THEN 'DELIVERY RECEIPT|Name: Bo|Address: Main|Delivery date 09/15/2023|Delivered on: 09/15/2023|Received by: Al Bo|Delivery ID: X77|Signature on file|'
         WHEN 4 THEN 'Progress Notes|Patient name: Sam|DOB: 1/2/1960|Physician Dr. Ann Lee, MD|Diagnosis: OSA|Assessment: stable, Plan: treatment 5 mg, 80 kg|Symptoms at 10:20 AM in the morning on Apr 27, 2023|'
         WHEN 5 THEN 'Rx:5|Prescription medication name: Z|Dosage 5 MG, quantity 30|Take 2 tablet(s) daily|Refills: 3|Disp: #30|Email: rx@example.com|'
         ELSE '' END, '|', chr(10)),
         d.text, chr(10), '** ref', d.doc_id, ' oor e 5%,x  : y', chr(10), chr(10), 'Page ', d.doc_id % 9 + 1) AS raw_text,
       l.label AS ground_truth
FROM doc_class d JOIN label_dim l ON l.label_ord = d.truth_ord"""

    views["llm_responses"] = f"""
SELECT d.doc_id AS id, CAST(l.label_ord AS BIGINT) AS label_ord, l.label,
       CASE WHEN l.label_ord = d.body_ord AND d.doc_id % 5 <> 0 THEN concat('Yes, ', 60 + (d.doc_id * 31) % 40, '%')
            WHEN (d.doc_id * 31 + l.label_ord * 17) % 100 = 13 THEN 'Yes'
            WHEN (d.doc_id * 31 + l.label_ord * 17) % 100 < 6 THEN concat('Yes. Confidence: ', 50 + (d.doc_id * 31 + l.label_ord * 17) % 100, '.5%')
            WHEN (d.doc_id * 31 + l.label_ord * 17) % 100 < 26 THEN concat('Yes, ', (d.doc_id * 31 + l.label_ord * 17) % 100, '%')
            ELSE concat('No, ', (d.doc_id * 31 + l.label_ord * 17) % 100, '%') END AS response
FROM doc_class d {label_fan}"""

    views["few_shot_responses"] = """
SELECT d.doc_id AS id,
       CASE WHEN d.doc_id % 23 = 0 THEN 'I cannot tell' ELSE concat('Class: ', l.label, '_Report', chr(10), 'Confidence: ', 50 + d.doc_id % 50, '%') END AS response
FROM doc_class d JOIN label_dim l ON l.label_ord = CASE WHEN d.body_ord < 0 THEN d.truth_ord ELSE d.body_ord END"""

    views["dash_responses"] = """
SELECT d.doc_id AS id,
       CASE WHEN d.doc_id % 23 = 0 THEN 'no answer'
            WHEN d.doc_id % 19 = 0 THEN concat('Document ', d.doc_id, ' - Class: ', l.label)
            WHEN d.doc_id % 17 = 0 THEN concat('Document ', d.doc_id, ' - ', l.label, ' - High')
            ELSE concat('Document ', d.doc_id, ' - Class: ', l.label, ' - Confidence: ',
                 CASE d.doc_id % 4 WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' WHEN 2 THEN 'High' ELSE 'Certain' END) END AS response
FROM doc_class d JOIN label_dim l ON l.label_ord = CASE WHEN d.body_ord < 0 THEN d.truth_ord ELSE d.body_ord END"""

    views["process_log"] = """
SELECT doc_id AS id,
       CASE WHEN doc_id % 17 = 0 THEN NULL WHEN doc_id % 19 = 0 THEN '{bad' WHEN doc_id % 29 = 0 THEN '{}'
            WHEN doc_id % 37 = 0 THEN '[1]'
            WHEN doc_id % 41 = 0 THEN '{"OCR": null, "Classification": {"time": 1.5}}'
            WHEN doc_id % 43 = 0 THEN '{"OCR": {"time": 1.5}, "Text Cleaning": 5}'
            WHEN doc_id % 47 = 0 THEN '{"OCR": {"time": null}, "Classification": {"time": 2.5, "cost": null}}'
            WHEN doc_id % 53 = 0 THEN '{"OCR": {"time": 0.0000001}, "Text Cleaning": {}}'
            ELSE concat('{"OCR": {"time": ', n_chars % 97, '.5}, "Text Cleaning": {"time": 0.', n_chars % 13 + 10, '}, "Classification": {"time": ', n_chars % 11, '.25',
                 CASE WHEN doc_id % 31 = 0 THEN '' ELSE concat(', "cost": 0.000', n_chars % 89 + 10) END, '}}') END AS process_metadata
FROM documents"""

    views["stored_documents"] = """
SELECT d.doc_id AS id, concat(l.label, ' ', d.source, ' ', d.doc_id, '.pdf') AS file_name,
       p.label AS classified_category, CAST(50 + d.doc_id % 50 AS DOUBLE) / 100 AS confidence,
       CASE WHEN d.doc_id % 13 = 0 THEN '' ELSE concat('{"', l.label, '": 0.', 50 + d.doc_id % 50, '}') END AS high_confidence_classes,
       g.process_metadata, d.text AS raw_text, lower(d.text) AS cleaned_text,
       CASE WHEN d.doc_id % 10 = 0 THEN NULL ELSE l.label END AS ground_truth
FROM doc_class d JOIN label_dim l ON l.label_ord = d.truth_ord LEFT JOIN label_dim p ON p.label_ord = d.body_ord
JOIN process_log g ON g.id = d.doc_id"""

    views["page_texts"] = """
SELECT conv_id AS doc_id, turn AS page_no, text AS page_text FROM conversations"""

    views["extractions"] = f"""
SELECT m.method, concat(d.source, ' ', d.doc_id, '.pdf') AS file_name, d.doc_id AS id,
       CAST(d.n_chars % 50 + m.method_ord * 10 AS DOUBLE) / 10 AS seconds,
       CASE m.method_ord WHEN 0 THEN d.text WHEN 1 THEN translate(d.text, '.,;:!?-', '') ELSE replace(d.text, '-', ' ') END AS text
FROM documents d {method_fan}"""

    views["line_corpus"] = """
SELECT id, ground_truth AS label, CASE WHEN id % 3 = 0 THEN raw_text ELSE replace(raw_text, chr(10), ' ') END AS text FROM claims"""

    views["flat_corpus"] = """
SELECT id, ground_truth AS label, CASE WHEN id % 6 IN (0, 1) OR (id % 6 IN (2, 3) AND id < 150) THEN replace(raw_text, chr(10), ' ') ELSE raw_text END AS text FROM claims"""

    views["docs_existing"] = """
SELECT id, file_name, file_location, raw_text, lower(raw_text) AS cleaned_text, 'Unknown' AS classified_category,
       CAST(0 AS DOUBLE) AS confidence, CAST(NULL AS STRING) AS high_confidence_classes, CAST(NULL AS STRING) AS process_metadata,
       CASE WHEN id % 10 = 0 THEN NULL ELSE ground_truth END AS ground_truth
FROM claims"""

    views["docs_batch"] = f"""
SELECT CASE WHEN c.id % 11 = 0 THEN concat('Revised ', c.file_name) ELSE c.file_name END AS file_name,
       concat('/moved', s.version, c.file_location) AS file_location, c.id * 2 + s.version AS seq,
       concat(c.raw_text, chr(10), 'v', s.version) AS raw_text, CASE WHEN c.id % 9 = 0 THEN '' ELSE concat(lower(c.raw_text), ' v', s.version) END AS cleaned_text,
       c.ground_truth AS classified_category, CASE WHEN c.id % 12 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(c.id % 100 + s.version AS DOUBLE) / 100 END AS confidence,
       '{{}}' AS high_confidence_classes, '{{"OCR": {{"time": 1.5}}}}' AS process_metadata
FROM claims c {version_fan}"""

    if engine != "spark":
        views["prototypes"] = """
SELECT vec_id, label, embedding FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings) t WHERE rn <= 4"""
        views["test_vectors"] = """
SELECT vec_id, label, embedding FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM prototypes)"""
        views["batch_responses"] = """
SELECT id // 16 AS batch_no, string_agg(response, chr(10) ORDER BY id) AS response FROM dash_responses GROUP BY ALL"""
        views["cleaned"] = f"""
SELECT id, file_name, file_location, ground_truth, raw_text, {duck_clean('raw_text')} AS cleaned_text FROM claims"""
        views["corpus"] = """
SELECT id, ground_truth AS label, cleaned_text AS text FROM cleaned"""
    return views


def duck_clean_steps() -> list:
    """The cleaning steps once more, for an engine without lookaround."""
    w, s = WORD, SPACE

    def rx(t: str, pattern: str, by: str) -> str:
        return f"regexp_replace({t}, '{pattern}', {by}, 'g')"

    def words(t: str) -> str:
        marked = rx(t, f"([{w}]+)", r"chr(2) || '\1' || chr(3)")
        gone = f"regexp_replace({marked}, chr(2) || '(oor|eee|aye|e)' || chr(3), '', 'g')"
        return f"regexp_replace({gone}, '[' || chr(2) || chr(3) || ']', '', 'g')"

    def space_after(t: str) -> str:
        marked = rx(t, "([.,])", r"'\1' || chr(1)")
        kept = f"regexp_replace({marked}, chr(1) || '([{s}])', '\\1', 'g')"
        return f"replace(regexp_replace({kept}, chr(1) || '\\z', ''), chr(1), ' ')"

    return [
        lambda t: rx(t, f"[^{w}{s}:/.,%-]+", "''"),
        words,
        lambda t: rx(t, r"\n+", "chr(10)"),
        lambda t: rx(t, f"[{s}]{{2,}}", "' '"),
        space_after,
        lambda t: rx(t, r"(Phone|Fax|Email):? [^\n]*\n", "''"),
        lambda t: rx(t, rf"\A[^{w}]+", "''"),
        lambda t: rx(t, r"(\p{Nd})(cmH20|L/min|%)", r"'\1 \2'"),
        lambda t: rx(rx(t, f"[{s}]+([:,])", r"'\1'"), f"([:,])[{s}]+", r"'\1 '"),
        lambda t: rx(t, rf"\A[{s}]+|[{s}]+\z", "''"),
    ]


def duck_clean(column: str, last_step: int = 10) -> str:
    expr = column
    for step in duck_clean_steps()[:last_step]:
        expr = step(expr)
    return expr


def _closure(views: dict[str, str], sql: str) -> list[str]:
    """Views a query needs, directly or through other views, in order."""
    needed: set[str] = set()
    queue = [sql]
    while queue:
        words = set(re.findall(r"\w+", queue.pop()))
        for name in views:
            if name in words and name not in needed:
                needed.add(name)
                queue.append(views[name])
    return [name for name in views if name in needed]


# dear to compute and used more than once
_COMPUTE_ONCE = {"cleaned", "flags", "simple_flags", "confidences", "cosines", "reply_scores", "rule_predictions"}


def oracle(sql: str, **ctes: str) -> str:
    """Complete oracle SQL: the needed views as CTEs, then ``ctes``, then ``sql``."""
    views = {**view_sql("duckdb"), **ctes}
    parts = [
        f"{n} AS {'MATERIALIZED ' if n in _COMPUTE_ONCE else ''}({views[n].strip()})"
        for n in _closure(views, sql)
    ]
    return (f"WITH {', '.join(parts)}\n" if parts else "") + sql.strip()


class Views:
    """The given tables and derived views of one data folder as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        views = view_sql("spark")
        if name in TABLES:
            return self.table(name)
        if name not in views:
            raise AttributeError(name)
        sql = f"SELECT * FROM {name}"
        ctes = [f"{n} AS ({views[n].strip()})" for n in _closure(views, sql)]
        text = f"WITH {', '.join(ctes)} {sql}"
        given = rf"\bFROM ({'|'.join(TABLES)})\b"
        return self.spark.sql(
            re.sub(given, lambda m: f"FROM parquet.`{self.sf_dir}/{m[1]}.parquet`", text)
        )

    def claims_from(self, documents: DataFrame) -> DataFrame:
        """The ``claims`` view over another documents DataFrame, such as a stream."""
        views = view_sql("spark")
        ctes = [f"{n} AS ({views[n].strip()})" for n in ("doc_class", "label_dim", "claims")]
        text = f"WITH {', '.join(ctes)} SELECT * FROM claims".replace(
            "FROM documents", "FROM {documents}"
        )
        return self.spark.sql(text, documents=documents)

    def spread(self, df: DataFrame, key: str) -> DataFrame:
        """Deal the rows out to as many tasks as the session setting ``spark.claimsift.spreadTasks`` says.

        For tables of one row group on a single machine, where one task would do all
        regex work. Without the setting, as on a cluster, rows stay as they were scanned.
        """
        tasks = self.spark.conf.get("spark.claimsift.spreadTasks", None)
        return df.repartition(int(tasks), key) if tasks else df

    @property
    def raw_claims(self) -> DataFrame:
        return self.spread(self.claims, "id")

    @property
    def cleaned(self) -> DataFrame:
        """claims with ``cleaned_text`` instead of ``raw_text``."""
        return self.raw_claims.select(
            "id", "file_name", "file_location", "ground_truth",
            clean_text(F.col("raw_text")).alias("cleaned_text"),
        )

    @property
    def corpus(self) -> DataFrame:
        return self.cleaned.select(
            "id", F.col("ground_truth").alias("label"), F.col("cleaned_text").alias("text")
        )

    @property
    def prototypes(self) -> DataFrame:
        return first_vectors_per_label(self.embeddings).select("vec_id", "label", "embedding")

    @property
    def batch_responses(self) -> DataFrame:
        """Replies of 16 documents in one, by ranges of the unique id."""
        lines = F.array_sort(F.collect_list(F.struct("id", "response")))
        return (
            self.dash_responses.groupBy(F.floor(F.col("id") / 16).cast("bigint").alias("batch_no"))
            .agg(lines.alias("d"))
            .select("batch_no", F.array_join("d.response", "\n").alias("response"))
        )
