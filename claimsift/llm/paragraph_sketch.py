"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraphs: its lines, and within a line runs of ``run_words`` words. The digests of the paragraphs
(a repeated paragraph counts on, so a second copy is another element) are added to three cells each of a small table;
a cell holds a count, a sum of digests and a sum of their checks. The sketch of one version subtracted from that of
another leaves only paragraphs that differ. Cells with a single one left name it; taking it out of its other cells frees
more (peeling). If something remains, both sketches are made anew four times larger.

What is recovered gives the likeness of two versions: paragraphs in common by paragraphs in either. Many documents of a
task are sketched, subtracted and peeled together, as array operations.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimsift.llm.common import CHUNK_CHARS

RUN_WORDS = 4
#: Cells of a fingerprint, a multiple of HASHES; larger sketches are only made to recover a difference.
CELLS, HASHES, GROWTH = 18, 3, 4
# odd multipliers of the cell hashes and of the check
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)
LEAST_ID = -(1 << 63)
#: Texts worked on at once; their numbers, and those of their edited versions, fit in 16 bits.
CHUNK_TEXTS = 30_000


def paragraph_pattern(run_words: int) -> re.Pattern:
    return re.compile(rf"\S+(?:[^\S\n]+\S+){{0,{run_words - 1}}}")


def digests(texts: list[str], pattern: re.Pattern) -> tuple[np.ndarray, np.ndarray]:
    """(text number, digest of paragraph and its occurrence number), sorted by text.

    Text numbers take 16 bits and digests of paragraphs 48, so that one sort of plain numbers groups both.
    """
    h = xxhash.xxh64_intdigest
    lists = [[h(p) for p in pattern.findall(t)] for t in texts]
    owner = np.repeat(np.arange(len(texts), dtype=np.uint64), [len(x) for x in lists])
    both = np.sort(np.array(list(chain.from_iterable(lists)), dtype=np.uint64) >> np.uint64(16) | owner << np.uint64(48))
    owner, keys = (both >> np.uint64(48)).astype(np.int64), both & np.uint64((1 << 48) - 1)
    new = np.ones(len(both), bool)
    new[1:] = both[1:] != both[:-1]
    start = np.maximum.accumulate(np.where(new, np.arange(len(both)), 0))
    occurrence = (np.arange(len(both)) - start).astype(np.uint64)
    # 16 bits of the occurrence number stand above the digest; the rest of a larger one is spread over all bits
    return owner, _mixed(keys + (occurrence << np.uint64(48)) + (occurrence >> np.uint64(16)) * MULTIPLIERS[1] + np.uint64(1))


def _mixed(keys: np.ndarray) -> np.ndarray:
    keys = (keys ^ (keys >> np.uint64(31))) * MULTIPLIERS[3]
    return keys ^ (keys >> np.uint64(29))


def _check(keys: np.ndarray) -> np.ndarray:
    return _mixed(keys * MULTIPLIERS[0] + MULTIPLIERS[2])


def _places(owner: np.ndarray, keys: np.ndarray, cells: int) -> np.ndarray:
    """Flat cell numbers, one row for each hash."""
    part = cells // HASHES
    rows = [owner * cells + k * part + (_mixed(keys * MULTIPLIERS[k]) >> np.uint64(20)).astype(np.int64) % part for k in range(HASHES)]
    return np.stack(rows)


class Sketches:
    """One sketch for each of ``n`` texts."""

    def __init__(self, n: int, cells: int):
        self.n, self.cells = n, cells
        self.count = np.zeros(n * cells, np.int64)
        self.keys = np.zeros(n * cells, np.uint64)
        self.checks = np.zeros(n * cells, np.uint64)

    def add(self, owner: np.ndarray, keys: np.ndarray, sign: np.ndarray | int = 1) -> None:
        sign = np.broadcast_to(np.asarray(sign, np.int64), keys.shape)
        factor = sign.astype(np.uint64)  # -1 wraps around, as the sums do
        signed_keys, signed_checks = keys * factor, _check(keys) * factor
        for place in _places(owner, keys, self.cells):
            np.add.at(self.count, place, sign)
            np.add.at(self.keys, place, signed_keys)
            np.add.at(self.checks, place, signed_checks)

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(more in the first, more in the second, complete) for each difference; empties the sketches."""
        more, less = np.zeros(self.n, np.int64), np.zeros(self.n, np.int64)
        at = np.nonzero(np.abs(self.count) == 1)[0]
        while len(at):
            sign = self.count[at]
            keys = self.keys[at] * sign.astype(np.uint64)
            single = (np.abs(sign) == 1) & (self.checks[at] == _check(keys) * sign.astype(np.uint64))
            owner, keys, sign = at[single] // self.cells, keys[single], sign[single]
            if not len(keys):
                break
            # one that is single in several cells is taken once
            _, first = np.unique(_mixed(owner.astype(np.uint64) * MULTIPLIERS[2] + keys), return_index=True)
            owner, keys, sign = owner[first], keys[first], sign[first]
            more += np.bincount(owner[sign > 0], minlength=self.n)
            less += np.bincount(owner[sign < 0], minlength=self.n)
            self.add(owner, keys, -sign)
            at = _places(owner, keys, self.cells).ravel()
            at = np.unique(at[np.abs(self.count[at]) == 1])
        left = (self.count != 0) | (self.keys != 0) | (self.checks != 0)
        return more, less, ~left.reshape(self.n, self.cells).any(axis=1)


def _of(owner: np.ndarray, keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Elements of the wanted texts (which may repeat), renumbered in the order of ``wanted``."""
    start, end = np.searchsorted(owner, wanted), np.searchsorted(owner, wanted, side="right")
    lengths = end - start
    new = np.repeat(np.arange(len(wanted)), lengths)
    index = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(start, lengths)
    return new, keys[index]


def likeness(owner: np.ndarray, keys: np.ndarray, first: np.ndarray, second: np.ndarray, cells: int = CELLS) -> np.ndarray:
    """Paragraphs in common by paragraphs in either, for pairs of text numbers; 1 for two texts without paragraphs."""
    out = np.ones(len(first))
    pairs = np.arange(len(first))
    while len(pairs):
        sketch = Sketches(len(pairs), cells)
        own, own_keys = _of(owner, keys, first[pairs])
        sketch.add(own, own_keys)
        sketch.add(*_of(owner, keys, second[pairs]), -1)
        more, less, complete = sketch.peel()
        sizes = np.bincount(own, minlength=len(pairs))
        either = sizes + less
        done = complete & (either > 0)
        out[pairs[done]] = (sizes - more)[done] / either[done]
        pairs = pairs[~complete]
        cells *= GROWTH
    return out


def fingerprint_strings(owner: np.ndarray, keys: np.ndarray, n: int, cells: int = CELLS) -> list[str]:
    """Number of paragraphs, then the cells (count, digest sum, check sum: 4, 8 and 4 bytes, little-endian) in hex."""
    sketch = Sketches(n, cells)
    sketch.add(owner, keys)
    rows = np.zeros(n * cells, dtype=[("count", "<i4"), ("keys", "<u8"), ("checks", "<u4")])
    rows["count"], rows["keys"], rows["checks"] = sketch.count, sketch.keys, sketch.checks & np.uint64(0xFFFFFFFF)
    sizes = np.bincount(owner, minlength=n).astype("<u4")
    return [size.tobytes().hex() + row.tobytes().hex() for size, row in zip(sizes, rows.reshape(n, cells))]


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many (or all) of the next text."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


RESULT = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def sketch_chunk(texts: list[str], following: str, pattern: re.Pattern) -> list[pa.Array]:
    """Result columns of texts in descending order of their ids; ``following`` is the text after the last."""
    n = len(texts)
    after = [*texts[1:], following]
    changed = [edited(t, f) for t, f in zip(texts, after)]
    owner, keys = digests([*texts, following, *changed], pattern)
    own, versions = np.arange(n), np.arange(n) + n + 1
    marks = fingerprint_strings(owner, keys, 2 * n + 1)
    near = likeness(owner, keys, np.concatenate([own, own]), np.concatenate([versions, own + 1]))
    return [
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(c.encode()).hexdigest() for c in changed], pa.string()),
        pa.array(marks[:n], pa.string()),
        pa.array(marks[n + 1 :], pa.string()),
        pa.array(near[:n]),
        pa.array(near[n:]),
    ]


def neighbour_parts(docs: DataFrame, id_col: str, text_col: str, parts: int) -> DataFrame:
    """Rows (part, guest, order_id, id, text) so that each part, sorted by (guest, order_id desc, text), holds a stretch
    of the descending ids and behind it, as a guest, the row that comes next.

    The stretches are cut at approximate quantiles of the ids; their first ids (one for each part) are all that the
    driver sees. Texts are shuffled once, and only the first rows of the stretches twice.
    """
    rows = docs.select(
        F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(LEAST_ID)).alias("order_id"),
        F.col(f"`{id_col}`").alias("id"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
    )
    shares = [k / parts for k in range(1, parts)] + [1.0]
    cuts = rows.agg(F.percentile_approx("order_id", shares, 100 * parts), F.max("order_id")).first()
    firsts = np.array(sorted({*(cuts[0] or []), *([] if cuts[1] is None else [cuts[1]])}), dtype=np.int64)

    @F.arrow_udf("array<struct<part int, guest boolean>>")
    def targets(ids: pa.Array) -> pa.Array:
        values = ids.to_numpy()
        at = np.searchsorted(firsts, values)  # the stretch whose first id is the next one not below
        number = len(firsts) - 1 - at
        return pa.array(
            [
                [{"part": n, "guest": False}] + ([{"part": (n - 1) % len(firsts), "guest": True}] if firsts[a] == v else [])
                for n, a, v in zip(number.tolist(), at.tolist(), values.tolist())
            ],
            pa.list_(pa.struct([("part", pa.int32()), ("guest", pa.bool_())])),
        )

    return (
        rows.withColumn("target", F.explode(targets("order_id")))
        .select("target.part", "target.guest", "order_id", "id", "text")
        .repartitionById(max(1, len(firsts)), F.col("part"))
        .sortWithinPartitions("part", "guest", F.desc("order_id"), "text")
    )


def fingerprint_versions(docs: DataFrame, id_col: str, text_col: str, run_words: int = RUN_WORDS) -> DataFrame:
    """Id, fingerprint, fingerprint of the edited text, and the likeness of both and of the next document's.

    The next document is the one with the next smaller integer id; after the last comes the first. Null text counts as
    empty; its fingerprint has no paragraph, and two such texts are alike (1). Repeated ids stand in the order of their
    texts; null ids come after all others. A single document is its own next. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    dealt = neighbour_parts(docs, id_col, text_col, int(spark.conf.get("spark.sql.shuffle.partitions")))
    pattern = paragraph_pattern(run_words)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[str] = []
        size = part = 0
        closed = False  # the rest of the part are further guests

        def finished(following: str) -> pa.RecordBatch:
            columns = [pa.array(ids, id_type), *sketch_chunk(texts, following, pattern)]
            ids.clear()
            texts.clear()
            return pa.RecordBatch.from_arrays(columns, names=[id_col, *(c.split()[0] for c in RESULT.split(", "))])

        for batch in batches:
            id_type = batch.column(3).type
            for row_part, guest, id_, text in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4))):
                if row_part != part:
                    part, closed = row_part, False
                if closed:
                    continue
                if texts and (guest or size >= CHUNK_CHARS or len(texts) >= CHUNK_TEXTS):
                    yield finished(text)
                    size = 0
                if guest:
                    closed = True
                else:
                    ids.append(id_)
                    texts.append(text)
                    size += len(text)

    return dealt.mapInArrow(work, f"`{id_col}` {dict(dealt.dtypes)['id']}, {RESULT}")
