"""Document files: finding them, extracting text, assembling pages, comparing extractors."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimsift.functions.patterns import SPACE_CHARS, strip
from claimsift.operators.ordering import running_totals

Extractor = Callable[[bytes], str]


def path_exists(spark: SparkSession, path: str) -> bool:
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath)


def find_files(spark: SparkSession, path: str, suffix: str = ".pdf") -> DataFrame:
    """Binary files directly under ``path`` (or the one file): path, length, content, ....

    The suffix is case-sensitive. Select only the columns you need: without
    ``content`` no file is opened.
    """
    if not path_exists(spark, path):
        raise ValueError(f"neither a {suffix} file nor a directory: {path}")
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", f"*{suffix}")
        .option("recursiveFileLookup", "false")
        .load(path)
    )


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extract_text(files: DataFrame, extractor: Extractor) -> DataFrame:
    """(file_name, file_location, raw_text) from (path, content) by a plug-in.

    Files are read and converted inside the tasks, one Arrow batch at a time; any
    library the extractor needs is imported on the worker.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(
                {"file_location": batch["path"], "raw_text": [extractor(bytes(c)) for c in batch["content"]]}
            )

    rows = files.select("path", "content").mapInPandas(
        run, "file_location string, raw_text string"
    )
    return rows.select(file_name(F.col("file_location")).alias("file_name"), "file_location", "raw_text")


def run_extractors(files: DataFrame, extractors: dict[str, Extractor]) -> DataFrame:
    """(method, file_name, seconds, text): every extractor on every file of (path, content), each timed alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                for method, extractor in extractors.items():
                    start = time.perf_counter()
                    text = extractor(bytes(content))
                    rows.append((method, path, time.perf_counter() - start, text))
            yield pd.DataFrame(rows, columns=["method", "path", "seconds", "text"])

    found = files.select("path", "content").mapInPandas(run, "method string, path string, seconds double, text string")
    return found.select("method", file_name(F.col("path")).alias("file_name"), "seconds", "text")


# What the default extractor drops and the entities it decodes.
_HTML_DROPPED = [
    r"(?s)<!--.*?-->",
    r"(?is)<script\b.*?</script\s*>",
    r"(?is)<style\b.*?</style\s*>",
]
_HTML_BREAKS = r"(?i)<(?:br|/p|/h[1-6]|/li|/div|/title|/nav|/article|/footer)\b[^>]*>"
_HTML_TAG = r"<[^>]*>"
_HTML_ENTITIES = [
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "),
    ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"),
]


def html_text(html: Column) -> Column:
    """Visible text of a page as one expression: a line per block, entities decoded."""
    text = html
    for dropped in _HTML_DROPPED:
        text = F.regexp_replace(text, dropped, "")
    text = F.regexp_replace(text, _HTML_BREAKS, "\n")
    text = F.regexp_replace(text, _HTML_TAG, "")
    for entity, char in _HTML_ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    text = F.regexp_replace(text, r"[ \t]*\n\s*", "\n")
    return strip(text)


def assemble_pages(pages: DataFrame, part_bytes: int = 64 << 20) -> DataFrame:
    """(doc_id, part_no, text): page texts in page order, each followed by a newline.

    A page belongs to the part in which its first byte falls when the document is
    cut every ``part_bytes`` bytes. The parts of a document in order are its text;
    no task collects more than about one part.
    """
    sizes = pages.select("doc_id", "page_no", (F.octet_length("page_text") + 1).cast("bigint").alias("_size"))
    ends = running_totals(sizes, "page_no", {"_end": F.col("_size")}, by=["doc_id"])
    parts = ends.select(
        F.col("doc_id").alias("_doc"), F.col("page_no").alias("_page"),
        F.floor((F.col("_end") - F.col("_size")) / F.lit(part_bytes)).cast("bigint").alias("part_no"),
    )
    here = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("page_no") == F.col("_page"))
    pages = pages.join(parts, here)
    ordered = F.array_sort(F.collect_list(F.struct("page_no", "page_text")))
    lines = F.transform(ordered, lambda p: F.concat(p.page_text, F.lit("\n")))
    return pages.groupBy("doc_id", "part_no").agg(F.array_join(lines, "").alias("text"))


def first_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, text): the variant that keeps the first page of a document only."""
    return pages.groupBy("doc_id").agg(F.min_by("page_text", "page_no").alias("text"))


#: Bytes of texts whose words are counted at once.
COUNTED_BYTES = 1 << 20
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[ord(c) for c in SPACE_CHARS if ord(c) < 128]] = True
# white space of several bytes: first byte -> the bytes after it
_WIDE_SPACES: dict[int, list[bytes]] = {}
for _char in SPACE_CHARS:
    if ord(_char) >= 128:
        _WIDE_SPACES.setdefault(_char.encode()[0], []).append(_char.encode()[1:])
_IS_LEAD = np.zeros(256, bool)
_IS_LEAD[list(_WIDE_SPACES)] = True


def _spaces(data: np.ndarray) -> np.ndarray:
    """Which bytes of whole UTF-8 texts belong to white space."""
    space = _IS_SPACE[data]
    leads = np.flatnonzero(_IS_LEAD[data])
    for lead, wide in _WIDE_SPACES.items() if len(leads) else ():
        at = leads[data[leads] == lead]
        for rest in wide:
            here = at[at + len(rest) < len(data)]
            for k, byte in enumerate(rest, 1):
                here = here[data[here + k] == byte]
            for k in range(len(rest) + 1):
                space[here + k] = True
    return space


def _word_counts(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Words of the texts that stand in ``data`` from one of ``ends`` to the next; a text's end ends a word."""
    space = _spaces(data)
    after_space = np.concatenate([[True], space])
    after_space[ends] = True
    first = np.flatnonzero(~space & after_space[:-1])
    return np.diff(np.searchsorted(first, ends))


def _count_words(texts: pa.Array) -> pa.Array:
    if not len(texts):
        return pa.array([], pa.int32())
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    counts, start = [], 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(ends, ends[start] + COUNTED_BYTES, "right")) - 1)
        counts.append(_word_counts(data[ends[start] : ends[end]], ends[start : end + 1] - ends[start]))
        start = end
    return pa.array(np.concatenate(counts), pa.int32(), mask=texts.is_null().to_numpy(zero_copy_only=False))


def word_count(text: Column) -> Column:
    """Number of whitespace-separated words, counted in Arrow batches: a regex makes an array of all words to count them."""
    return F.arrow_udf(_count_words, "int")(text)


def extraction_times(extractions: DataFrame) -> DataFrame:
    """(method, files, total_seconds)."""
    return extractions.groupBy("method").agg(
        F.count("*").alias("files"), F.sum("seconds").alias("total_seconds")
    )


def extraction_word_counts(
    extractions: DataFrame, methods: list[str], first: int | None = None
) -> DataFrame:
    """One row per file, one word-count column per method; ``first`` files by id on request."""
    if first is not None:
        chosen = extractions.filter(F.col("method") == methods[0]).orderBy("id").limit(first)
        extractions = extractions.join(F.broadcast(chosen.select("file_name")), "file_name", "left_semi")
    counted = extractions.select("file_name", "method", word_count(F.col("text")).alias("words"))
    return counted.groupBy("file_name").agg(
        *[F.sum(F.when(F.col("method") == m, F.col("words"))).alias(m) for m in methods]
    )


def select_method(extractions: DataFrame, method: str) -> DataFrame:
    return extractions.filter(F.col("method") == method)
