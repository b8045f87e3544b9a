"""The registered queries of this subpackage, with oracle SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimsift.llm.byte_bpe import bpe_round_trip
from claimsift.llm.common import crc_bucket, table
from claimsift.llm.decontaminate import contaminated
from claimsift.llm.filter_audit import audit_filters
from claimsift.llm.language import fit, identify
from claimsift.llm.licenses import scan_licenses
from claimsift.llm.line_runs import dedup_lines
from claimsift.llm.page_text import extract_main_text
from claimsift.llm.paragraph_sketch import fingerprint_versions
from claimsift.llm.parity_join import jaccard_groups
from claimsift.llm.prefix_trie import conversation_trie
from claimsift.llm.simhash import simhash_groups
from claimsift.llm.token_counts import section_tokens
from claimsift.llm.toxicity import TOXIC_FROM, score_documents
from claimsift.llm.toxicity import fit as fit_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: The rank file and the pattern of the byte-level BPE.
COUNTING_RANKS = "byte_bpe_50k.tiktoken"
RANKS = "byte_bpe_multi_50k.tiktoken"


def query(f: Callable[[SparkSession, str], DataFrame]):
    QUERIES[f.__name__] = f
    return f


@query
def op1_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return section_tokens(docs, "doc_id", "text", public_tokenizers.path(COUNTING_RANKS), public_tokenizers.PATTERN)


@query
def op2_language_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = crc_bucket(F.col("doc_id"), 5) == 0
    tree = fit(docs.filter(~held_out), "doc_id", "text", "lang")
    return docs.select("doc_id", held_out.alias("held_out"), identify(docs, F.col("text"), tree).alias("found")).select(
        "doc_id", "held_out", "found.*"
    )


@query
def op3_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"), "page_id", "url", "html").select("page_id", "url", "text", "n_chars")


@query
def op4_simhash_bit_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return simhash_groups(docs, "doc_id", "text").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


@query
def op5_toxicity_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_bucket(F.col("doc_id"), 3) == 1
    labels = table(spark, sf_dir, "labels").filter(~held_out)
    network = fit_toxicity(docs.filter(~held_out), "doc_id", "text", labels, "toxic")
    scored = score_documents(docs, "doc_id", "text", network, held_out.alias("held_out"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


@query
def op6_bpe_segment_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe_round_trip(docs, "doc_id", "text", public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


@query
def op7_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return contaminated(docs, "doc_id", "text", items, "item_id", "text", shortest=1)


@query
def op8_paragraph_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return fingerprint_versions(docs, "doc_id", "text").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"
    )


def file_paths() -> Column:
    """Documents as files: source/language/two levels/name; every 50th is a licence file, on one of the four levels."""
    id_ = F.coalesce("doc_id", F.lit(0))
    folders = [F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.concat(F.lit("a"), id_ % 7), F.concat(F.lit("b"), id_ % 11)]
    level = (F.floor(id_ / 50) % 4 + 1).cast("int")
    license_path = F.concat(F.array_join(F.slice(F.array(*folders), F.lit(1), level), "/"), F.lit("/LICENSE"))
    return F.when(id_ % 50 == 0, license_path).otherwise(F.concat_ws("/", *folders, F.concat(id_, F.lit(".txt"))))


@query
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    files = docs.select("doc_id", "text", file_paths().alias("path"))
    return scan_licenses(files, "doc_id", "path", "text")


@query
def op10_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, "doc_id", "text").select(
        "doc_id", "lines.n_lines", "lines.n_dropped", F.sha2("text", 256).alias("kept_sha256")
    )


ORACLES["op10_line_runs"] = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS line_no
  FROM documents
), keyed AS (
  SELECT doc_id, line, line_no,
         translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), repeated AS (
  SELECT key, max(doc_id) AS top_id FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT k.doc_id, k.line, k.line_no, r.key IS NOT NULL AND k.doc_id < r.top_id AS gone
  FROM keyed k LEFT JOIN repeated r ON r.key = k.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return audit_filters(docs, "doc_id", "source", "text", table(spark, sf_dir, "labels"))


ORACLES["op12_filter_audit"] = r"""
WITH words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), firsts AS (
  SELECT text, min(doc_id) AS least FROM words GROUP BY text
), marks AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id
), failed AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         CASE WHEN len(words) < 200 THEN 1 ELSE 0 END
         + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
         + CASE WHEN 100 * length(regexp_replace(w.text, '[^A-Z]+', '', 'g')) > 2 * length(w.text) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(w.text, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN w.doc_id > f.least THEN 16 ELSE 0 END AS mask
  FROM words w JOIN firsts f ON f.text = w.text LEFT JOIN marks m ON m.doc_id = w.doc_id
), cells AS (
  SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY part, mask
), letters AS (
  SELECT substr('ABCDE', k, 1) AS letter, CAST(pow(2, k - 1) AS INT) AS bit FROM range(1, 6) t(k)
), orders AS (
  SELECT concat(a.letter, b.letter, c.letter, d.letter, e.letter) AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31
), steps AS (
  SELECT filter_order, CAST(k AS INT) AS step, l.bit,
         (SELECT coalesce(sum(x.bit), 0) FROM letters x WHERE strpos(filter_order, x.letter) < k) AS earlier
  FROM orders, range(1, 6) t(k), letters l WHERE l.letter = substr(filter_order, k, 1)
), counted AS (
  SELECT part, filter_order, step, bit,
         coalesce(sum(n) FILTER (WHERE mask & (earlier::INT | bit) = 0), 0) AS kept,
         coalesce(sum(n) FILTER (WHERE mask & earlier::INT = 0 AND mask & bit > 0), 0) AS removed,
         coalesce(sum(n) FILTER (WHERE mask & earlier::INT > 0 AND mask & bit > 0), 0) AS redundant,
         coalesce(sum(n) FILTER (WHERE mask = bit), 0) AS unique_fails,
         coalesce(sum(good) FILTER (WHERE mask & earlier::INT = 0 AND mask & bit > 0), 0) AS good_lost,
         coalesce(sum(toxic) FILTER (WHERE mask & earlier::INT = 0 AND mask & bit > 0), 0) AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM counted
"""


@query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")


# crc32 bit by bit: 0xEDB88320 is its reversed polynomial
ORACLES["op13_prefix_trie"] = r"""
WITH RECURSIVE turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), lengths AS (
  SELECT conv_id, count(*) AS own FROM turns GROUP BY conv_id
), crc AS (
  SELECT conv_id, CAST(conv_id AS VARCHAR) AS digits, 0 AS bits, 4294967295::BIGINT AS state FROM lengths
  UNION ALL
  SELECT conv_id, digits, bits + 1,
         CASE WHEN mixed % 2 = 1 THEN xor(mixed // 2, 3988292384::BIGINT) ELSE mixed // 2 END
  FROM (SELECT *, CASE WHEN bits % 8 = 0 THEN xor(state, ord(substr(digits, bits // 8 + 1, 1))::BIGINT) ELSE state END AS mixed
        FROM crc WHERE bits < 8 * length(digits))
), heads AS (
  SELECT c.conv_id, c.conv_id - c.conv_id % 20 AS base, xor(state, 4294967295::BIGINT) % 4 AS head
  FROM crc c WHERE bits = 8 * length(digits)
), led AS (
  SELECT h.*, least(head, coalesce(l.own, 0)) AS lead FROM heads h LEFT JOIN lengths l ON l.conv_id = h.base
), rebuilt AS (
  SELECT t.conv_id, t.pos - l.head + l.lead AS pos, role, text FROM turns t JOIN led l ON l.conv_id = t.conv_id WHERE t.pos > l.head
  UNION ALL
  SELECT l.conv_id, t.pos, role, text FROM led l JOIN turns t ON t.conv_id = l.base WHERE t.pos <= l.lead
), paths AS (
  SELECT conv_id, pos AS depth, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
         string_agg(sha256(concat(length(role), ':', role, text)), ',') OVER (PARTITION BY conv_id ORDER BY pos) AS prefix
  FROM rebuilt
  UNION ALL
  SELECT conv_id, 0, 0, '' FROM lengths
), nodes AS (
  SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words FROM paths GROUP BY depth, prefix
), member AS (
  SELECT p.conv_id AS member, p.depth, n.conv_id, p.depth = max(p.depth) OVER (PARTITION BY p.conv_id) AS last
  FROM paths p JOIN nodes n ON n.depth = p.depth AND n.prefix = p.prefix
), linked AS (
  SELECT n.*, m.conv_id AS parent_conv_id FROM nodes n LEFT JOIN member m ON m.member = n.conv_id AND m.depth = n.depth - 1
), children AS (
  SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM linked WHERE depth > 0 GROUP BY ALL
), sums AS (
  SELECT m.conv_id, m.depth, count(*) FILTER (WHERE c.n_children IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.words) AS saved_tokens
  FROM nodes n JOIN member m ON m.member = n.conv_id AND m.depth <= n.depth
  LEFT JOIN children c ON c.conv_id = n.conv_id AND c.depth = n.depth
  GROUP BY m.conv_id, m.depth
), ends AS (
  SELECT conv_id, depth, sha256(string_agg(CAST(member AS VARCHAR), ',' ORDER BY member)) AS ends_sha256
  FROM member WHERE last GROUP BY conv_id, depth
)
SELECT l.conv_id, l.depth::BIGINT AS depth, l.parent_conv_id, l.n_convs::BIGINT AS n_convs, coalesce(c.n_children, 0)::BIGINT AS n_children,
       s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, coalesce(e.ends_sha256, sha256('')) AS ends_sha256
FROM linked l JOIN sums s ON s.conv_id = l.conv_id AND s.depth = l.depth
LEFT JOIN children c ON c.conv_id = l.conv_id AND c.depth = l.depth
LEFT JOIN ends e ON e.conv_id = l.conv_id AND e.depth = l.depth
"""


@query
def op11_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"), "doc_id", "text")
