"""Scans, sources, sinks and the documents table."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from claimsift.fixed_values import DEFAULT_RULES
from claimsift.operators import rules as rule_ops
from claimsift.operators.ordering import positional_slice
from claimsift.plans.registry import query, quoted, rounded, same_as
from claimsift.plans.views import METHODS
from claimsift.sources import files, interchange, store
from claimsift.sources.partitioned_store import PartitionedStore


@query("SELECT id, regexp_extract(file_location, '[^/]*$') AS file_name, file_location FROM claims")
def file_name_from_path(v):
    return v.claims.select(
        "id", files.file_name(F.col("file_location")).alias("file_name"), "file_location"
    )


@query(r"""
SELECT page_id, regexp_replace(regexp_replace(t9, '[ \t]*\n\s*', chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text FROM (
SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(
  regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<script\b.*?</script\s*>', '', 'g'), '(?is)<style\b.*?</style\s*>', '', 'g'),
  '(?i)<(?:br|/p|/h[1-6]|/li|/div|/title|/nav|/article|/footer)\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g'),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS t9
FROM pages)""")
def extract_html_text(v):
    return v.spread(v.pages, "page_id").select("page_id", files.html_text(F.col("html")).alias("text"))


@query("""SELECT doc_id, (s // 300)::BIGINT AS part_no, string_agg(page_text || chr(10), '' ORDER BY page_no) AS text FROM (
  SELECT *, sum(strlen(page_text) + 1) OVER (PARTITION BY doc_id ORDER BY page_no) - strlen(page_text) - 1 AS s FROM page_texts)
GROUP BY ALL""")
def assemble_pages(v):
    """Parts are small here, so that many documents have several."""
    return files.assemble_pages(v.page_texts, part_bytes=300)


@query("SELECT doc_id, page_text AS text FROM page_texts QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY page_no) = 1")
def first_page_only(v):
    return files.first_pages(v.page_texts)


@query("""SELECT method, count(*) AS files, round(sum(CAST(seconds AS DECIMAL(18,1)))::DOUBLE, 6) AS total_seconds
FROM extractions GROUP BY method""")
def extraction_time_by_method(v):
    return rounded(files.extraction_times(v.extractions), "total_seconds")


@query("""SELECT m.method, concat(page_id, '.html') AS file_name, CASE m.method WHEN 'source' THEN html ELSE regexp_replace(html, '<[^>]*>', '', 'g') END AS text,
       true AS timed FROM pages CROSS JOIN (VALUES ('source'), ('no_tags')) m(method)""")
def run_extractors(v):
    """Two extractors on the same files; of the seconds only that they are not negative is compared."""
    found = v.pages.select(
        F.concat(F.lit("/pages/"), F.col("page_id"), F.lit(".html")).alias("path"), F.encode("html", "UTF-8").alias("content")
    )
    extractors = {
        "source": lambda content: content.decode(),
        "no_tags": lambda content: re.sub("<[^>]*>", "", content.decode()),
    }
    return files.run_extractors(found, extractors).select("method", "file_name", "text", (F.col("seconds") >= 0).alias("timed"))


_WORDS = r"len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))"


@query(f"""SELECT file_name, {', '.join(f"sum({_WORDS}) FILTER (method = '{m}')::BIGINT AS {m}" for m in METHODS)}
FROM extractions GROUP BY file_name""")
def extraction_word_counts(v):
    return files.extraction_word_counts(v.extractions, METHODS)


@query(f"""SELECT file_name, {', '.join(f"sum({_WORDS}) FILTER (method = '{m}')::BIGINT AS {m}" for m in METHODS)}
FROM extractions WHERE id IN (SELECT id FROM extractions WHERE method = 'plain' ORDER BY id LIMIT 5) GROUP BY file_name""")
def extraction_word_counts_top(v):
    """The comparison chart shows the first five files."""
    return files.extraction_word_counts(v.extractions, METHODS, first=5)


@query("SELECT file_name, seconds, text FROM extractions WHERE method = 'no_marks'")
def select_extraction_method(v):
    return files.select_method(v.extractions, "no_marks").select("file_name", "seconds", "text")


_RESULT_SCHEMA = "method string, file_name string, id bigint, seconds double, text string"


@query("SELECT method, file_name, id, seconds, text FROM extractions")
def json_roundtrip(v):
    path = interchange.shared_folder(v.spark)
    interchange.write_json(v.extractions, path)
    return interchange.read_json(v.spark, path, _RESULT_SCHEMA)


@query("SELECT id AS document_id, classified_category AS predicted_class, confidence FROM stored_documents")
def csv_predictions_roundtrip(v):
    path = interchange.shared_folder(v.spark)
    predictions = v.stored_documents.select(
        F.col("id").alias("document_id"),
        F.col("classified_category").alias("predicted_class"),
        "confidence",
    )
    interchange.write_predictions_csv(predictions, path)
    return interchange.read_predictions_csv(v.spark, path)


@query("SELECT id, file_name, classified_category, confidence, high_confidence_classes, process_metadata, ground_truth FROM stored_documents")
def scan_documents(v):
    """The table as a report reads it: the text columns stay in the files."""
    return v.stored_documents.select(
        "id", "file_name", "classified_category", "confidence",
        "high_confidence_classes", "process_metadata", "ground_truth",
    )


_NEW_IDS = """
SELECT file_name, row_number() OVER (ORDER BY min(seq)) + (SELECT coalesce(max(id), 0) FROM docs_existing) AS new_id
FROM docs_batch WHERE file_name NOT IN (SELECT file_name FROM docs_existing) GROUP BY file_name"""


@query("""
SELECT coalesce(t.id, n.new_id) AS id, coalesce(t.file_name, s.file_name) AS file_name,
       coalesce(t.file_location, f.file_location) AS file_location,
       CASE WHEN s.file_name IS NULL THEN t.raw_text ELSE s.raw_text END AS raw_text,
       CASE WHEN s.file_name IS NULL THEN t.cleaned_text ELSE s.cleaned_text END AS cleaned_text,
       CASE WHEN s.file_name IS NULL THEN t.classified_category ELSE s.classified_category END AS classified_category,
       CASE WHEN s.file_name IS NULL THEN t.confidence ELSE s.confidence END AS confidence,
       CASE WHEN s.file_name IS NULL THEN t.high_confidence_classes ELSE s.high_confidence_classes END AS high_confidence_classes,
       CASE WHEN s.file_name IS NULL THEN t.process_metadata ELSE s.process_metadata END AS process_metadata,
       t.ground_truth
FROM docs_existing t FULL JOIN lasts s ON s.file_name = t.file_name
LEFT JOIN firsts f ON f.file_name = s.file_name LEFT JOIN new_ids n ON n.file_name = s.file_name""",
    lasts="SELECT * FROM docs_batch QUALIFY row_number() OVER (PARTITION BY file_name ORDER BY seq DESC) = 1",
    firsts="SELECT * FROM docs_batch QUALIFY row_number() OVER (PARTITION BY file_name ORDER BY seq) = 1",
    new_ids=_NEW_IDS)
def upsert_documents(v):
    return store.upsert_documents(v.docs_existing, v.docs_batch)


def _upserted(v, merge):
    """The existing table at rest in parts, after the batch."""
    kept = PartitionedStore(v.spark, interchange.shared_folder(v.spark))
    kept.load(v.docs_existing)
    kept.append(v.docs_batch, 0, merge)
    return kept.current()


@same_as("upsert_documents")
def upsert_partitioned(v):
    return _upserted(v, store.upsert_documents)


@query("""
SELECT coalesce(t.id, n.new_id) AS id, coalesce(t.file_name, s.file_name) AS file_name,
       coalesce(t.file_location, s.file_location) AS file_location,
       coalesce(s.raw_text, t.raw_text) AS raw_text,
       coalesce(s.cleaned_text, t.cleaned_text, CASE WHEN t.file_name IS NULL THEN '' END) AS cleaned_text,
       coalesce(s.classified_category, t.classified_category) AS classified_category,
       coalesce(s.confidence, t.confidence, CASE WHEN t.file_name IS NULL THEN 0.0 END)::DOUBLE AS confidence,
       t.high_confidence_classes, t.process_metadata, t.ground_truth
FROM docs_existing t FULL JOIN filled s ON s.file_name = t.file_name LEFT JOIN new_ids n ON n.file_name = s.file_name""",
    filled="""
SELECT file_name, arg_min(file_location, seq) AS file_location,
       arg_max(nullif(raw_text, ''), seq) FILTER (raw_text <> '') AS raw_text,
       arg_max(cleaned_text, seq) FILTER (cleaned_text <> '') AS cleaned_text,
       arg_max(classified_category, seq) FILTER (classified_category <> '') AS classified_category,
       arg_max(confidence, seq) FILTER (confidence <> 0) AS confidence
FROM docs_batch GROUP BY file_name""",
    new_ids=_NEW_IDS)
def partial_upsert_documents(v):
    return store.partial_upsert_documents(v.docs_existing, v.docs_batch)


@same_as("partial_upsert_documents")
def partial_upsert_partitioned(v):
    return _upserted(v, store.partial_upsert_documents)


_RULE_ROWS = ", ".join(
    f"({quoted(c)}, {quoted(f)}, {i}, {quoted(x)})"
    for c, families in DEFAULT_RULES.items()
    for f, xs in families.items()
    for i, x in enumerate(xs)
)


@query(f"""
SELECT r.class, r.family, r.position::BIGINT AS position, r.feature, count(c.id) AS class_documents
FROM (VALUES {_RULE_ROWS}) r(class, family, position, feature) LEFT JOIN claims c ON c.ground_truth = r.class
GROUP BY ALL""")
def rules_table(v):
    """The rule set as rows, each with the number of documents of its class."""
    rows = rule_ops.rules_table(rule_ops.default_rules_rows(v.spark))
    sizes = v.claims.groupBy(F.col("ground_truth").alias("class")).agg(
        F.count("*").alias("class_documents")
    )
    return rows.join(sizes, "class", "left").na.fill(0, ["class_documents"])


@query("SELECT id, file_name, split_part(file_name, ' ', 1) AS label FROM claims")
def label_from_file_name(v):
    from claimsift.operators.cleaning import label_from_file_name as label

    return v.claims.select("id", "file_name", label(F.col("file_name")).alias("label"))


@query("SELECT id, file_name, ground_truth FROM claims ORDER BY id OFFSET 8")
def positional_subset(v):
    """Everything from position 8 on."""
    return positional_slice(v.claims, "id", 8).select("id", "file_name", "ground_truth")


@query("SELECT id, file_name, ground_truth FROM claims ORDER BY id LIMIT 4 OFFSET 4")
def positional_range(v):
    """Positions 4 to 7: a row range is the operator itself."""
    return positional_slice(v.claims.select("id", "file_name", "ground_truth"), "id", 4, 8)
