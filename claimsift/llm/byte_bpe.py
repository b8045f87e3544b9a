"""Byte-level BPE with a segment tree over byte positions.

A piece of text (one match of the splitting pattern) starts as single bytes. Leaf i of the tree holds the rank of the
pair that starts at byte i, every inner node the smaller rank of its two children, so that the root is the smallest
rank and the walk that prefers the left child finds its leftmost place. A merge changes three leaves: the merged part,
its left neighbour, and the swallowed right neighbour, each updated along one path to the root. Trees of many pieces
stand in the rows of one array, so that a step of all of them is a few array operations.

Null text counts as empty: no tokens, digests of nothing. Rows are independent: repeated rows give equal results.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from claimsift.llm.common import map_chunks, texts_of

NO_PAIR = 2**31 - 1
#: Encoded pieces that a task remembers.
REMEMBERED = 800_000
#: Leaves of all trees that are worked on at once.
TREE_LEAVES = 1 << 17
#: The codec of this Python worker, by a digest of its ranks and pattern; later tasks go on with it.
CODECS: dict[str, "Codec"] = {}
RESULT = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PairRanks:
    """Rank of two neighbouring tokens: the token that their bytes form, whichever way it splits in two."""

    def __init__(self, ranks: dict[bytes, int]):
        self.base = max(ranks.values()) + 1
        pairs = {}
        for token, rank in ranks.items():
            for middle in range(1, len(token)):
                left, right = ranks.get(token[:middle]), ranks.get(token[middle:])
                if left is not None and right is not None:
                    pairs[left * self.base + right] = rank
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.ranks = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int32)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(left.shape, NO_PAIR, np.int32)
        key = left.astype(np.int64) * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((left >= 0) & (right >= 0) & (self.keys[at] == key), self.ranks[at], NO_PAIR).astype(np.int32)


def merge_pieces(pieces: list[bytes], byte_ids: np.ndarray, pairs: PairRanks) -> list[bytes]:
    """Ids of each piece of two bytes or more, as bytes. All pieces work at once, each on its own row and tree."""
    out: list[bytes] = [b""] * len(pieces)
    by_width: dict[int, list[int]] = {}
    for k, piece in enumerate(pieces):
        by_width.setdefault(1 << (len(piece) - 1).bit_length(), []).append(k)
    for width, members in by_width.items():
        step = max(1, TREE_LEAVES // width)
        for first in range(0, len(members), step):
            some = members[first : first + step]
            for k, ids in zip(some, _merge_rows([pieces[k] for k in some], width, byte_ids, pairs)):
                out[k] = ids
    return out


def _merge_rows(pieces: list[bytes], width: int, byte_ids: np.ndarray, pairs: PairRanks) -> list[bytes]:
    lengths = np.array([len(p) for p in pieces])
    n = len(pieces)
    raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
    inside = np.arange(width) < lengths[:, None]
    ids = np.full((n, width + 1), -1, np.int32)  # the last column is the end of a full row
    ids[:, :width][inside] = byte_ids[raw[inside]]
    after = np.tile(np.arange(1, width + 2, dtype=np.int32), (n, 1))
    before = np.tile(np.arange(-1, width, dtype=np.int32), (n, 1))
    tree = np.full((n, 2 * width), NO_PAIR, np.int32)
    tree[:, width:] = pairs.of(ids[:, :width], ids[:, 1:])
    level = width // 2
    while level:
        np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2], out=tree[:, level : 2 * level])
        level //= 2

    row = np.nonzero(tree[:, 1] != NO_PAIR)[0]
    while len(row):
        least = tree[row, 1]
        at = np.ones(len(row), np.int64)
        for _ in range(width.bit_length() - 1):  # down to the leftmost place of the smallest rank
            at *= 2
            at += tree[row, at] != least
        place = at - width
        gone = after[row, place]
        following = after[row, gone]
        after[row, place] = following
        before[row, np.minimum(following, width)] = place
        ids[row, place] = least  # a token's id is its rank
        ids[row, gone] = -1
        previous = before[row, place]
        has_previous = previous >= 0
        changed = [
            (row, gone, np.full(len(row), NO_PAIR, np.int32)),
            (row, place, pairs.of(least, ids[row, np.minimum(following, width)])),
            (r := row[has_previous], p := previous[has_previous], pairs.of(ids[r, p], least[has_previous])),
        ]
        for rows, leaf, rank in changed:
            tree[rows, width + leaf] = rank
        for rows, leaf, _ in changed:
            up = (width + leaf) >> 1
            for _ in range(width.bit_length() - 1):
                tree[rows, up] = np.minimum(tree[rows, 2 * up], tree[rows, 2 * up + 1])
                up >>= 1
        row = row[tree[row, 1] != NO_PAIR]

    live = ids[:, :width] >= 0
    flat = ids[:, :width][live].astype("<u4").tobytes()
    ends = 4 * np.cumsum(live.sum(axis=1))
    return [flat[start:end] for start, end in zip([0, *ends[:-1].tolist()], ends.tolist())]


class Codec:
    """Encodes and decodes texts; remembers the ids of pieces it has met (little-endian, 4 bytes each)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pairs = PairRanks(ranks)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.pieces = regex.compile(pattern).findall
        self.token_bytes = {rank: token for token, rank in ranks.items()}
        self.known: dict[str, bytes] = {}

    def learn(self, pieces: set[str]) -> None:
        fresh = pieces - self.known.keys()
        if len(self.known) + len(fresh) > REMEMBERED:
            self.known, fresh = {}, pieces
        unmerged = []
        for piece in fresh:
            whole = self.ranks.get(piece.encode())
            if whole is None:
                unmerged.append(piece)
            else:
                self.known[piece] = whole.to_bytes(4, "little")
        self.known.update(zip(unmerged, merge_pieces([p.encode() for p in unmerged], self.byte_ids, self.pairs)))

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.pieces(t) for t in texts]
        self.learn(set().union(*split))
        ids_of = self.known.__getitem__
        return [b"".join(map(ids_of, pieces)) for pieces in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def whole_text_pattern(pattern: str) -> str:
    """White space as Unicode defines it, which is what the splitting pattern means."""
    return pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")


def bpe_round_trip(docs: DataFrame, id_col: str, text_col: str, ranks_path: str, pattern: str, ids_col: str | None = None) -> DataFrame:
    """Id, number of tokens, digest of the ids and of the decoded bytes; the ids themselves in ``ids_col`` if named.

    Only the id and the text are read, so other columns of any name do no harm.
    """
    ranks, pattern = read_ranks(ranks_path), whole_text_pattern(pattern)
    name = hashlib.sha256(repr((sorted(ranks.items()), pattern)).encode()).hexdigest()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        if name not in CODECS:
            CODECS.clear()
            CODECS[name] = Codec(ranks, pattern)
        codec = CODECS[name]
        encoded = codec.encode(texts_of(batch.column(1)))
        columns = [
            batch.column(0),
            pa.array([len(e) // 4 for e in encoded], pa.int64()),
            pa.array([hashlib.sha256(e).hexdigest() for e in encoded]),
            pa.array([hashlib.sha256(codec.decode(e)).hexdigest() for e in encoded]),
        ]
        if ids_col:
            columns.append(pa.array([np.frombuffer(e, dtype="<u4").tolist() for e in encoded], pa.list_(pa.int64())))
        names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256", *([ids_col] if ids_col else [])]
        return pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(id_col, text_col)
    schema = f"`{id_col}` {rows.dtypes[0][1]}, {RESULT}" + (f", `{ids_col}` array<bigint>" if ids_col else "")
    return map_chunks(rows, work, schema, text_col)
