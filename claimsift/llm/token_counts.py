"""Token counts of sections, from one encoding of the whole document.

The document is encoded once. The lengths of its tokens give each token's span; sections are spans of the same text;
both lists are ordered, so the interval join of a document is a binary search of one in the other. A token that crosses
a section's end goes whole to one section, by an explicit rule:

- ``start``: the section that holds the token's first byte,
- ``majority``: the section that holds most of its bytes, the earlier one of equals.

So the counts of a document's sections add up to the tokens of the whole document, which separate encodings of the
sections would not give.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from claimsift.llm.byte_bpe import read_ranks, whole_text_pattern
from claimsift.llm.common import map_chunks, texts_of

RULES = ("start", "majority")
ENCODINGS: dict[str, tuple[tiktoken.Encoding, np.ndarray]] = {}


def encoding(name: str, ranks: dict[bytes, int], pattern: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoding and the number of bytes of each token; kept for later tasks of this Python worker."""
    if name not in ENCODINGS:
        lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            lengths[rank] = len(token)
        ENCODINGS.clear()
        ENCODINGS[name] = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths
    return ENCODINGS[name]


def token_ids(coder: tiktoken.Encoding, pieces, text: str) -> np.ndarray:
    """The tokens of a text. One whose runs of white space are too long for the library's pattern is split by ``pieces``."""
    try:
        return coder.encode_to_numpy(text, disallowed_special=())
    except ValueError:  # the pattern ran out of room to backtrack
        return np.fromiter(chain.from_iterable(map(coder._encode_single_piece, pieces(text))), np.int64)


def line_starts(data: np.ndarray) -> np.ndarray:
    """First bytes of the lines of a text; a line holds its line feed. Empty text is one empty line."""
    ends = np.nonzero(data == 10)[0] + 1
    return np.concatenate([[0], ends])


def attribute(token_lengths: np.ndarray, starts: np.ndarray, size: int, rule: str) -> np.ndarray:
    """Number of tokens of each section; sections start at ``starts`` and cover ``size`` bytes."""
    token_end = np.cumsum(token_lengths)
    token_start = token_end - token_lengths
    section = np.searchsorted(starts, token_start, side="right") - 1
    if rule == "majority" and len(section):
        last = np.searchsorted(starts, token_end - 1, side="right") - 1
        crossing = np.nonzero(last > section)[0]
        covered = last[crossing] - section[crossing] + 1
        token = np.repeat(crossing, covered)
        part = np.arange(covered.sum()) - np.repeat(np.cumsum(covered) - covered, covered) + section[token]
        ends = np.append(starts[1:], size)
        overlap = np.minimum(ends[part], token_end[token]) - np.maximum(starts[part], token_start[token])
        best = np.lexsort((part, -overlap, token))  # of each token: the largest, then the earliest
        first = best[np.unique(token[best], return_index=True)[1]]
        section[token[first]] = part[first]
    return np.bincount(section, minlength=len(starts))


def section_tokens(
    docs: DataFrame, id_col: str, text_col: str, ranks_path: str, pattern: str, rule: str = "start", sections=line_starts
) -> DataFrame:
    """(id, section, start, end, n_tokens): code points from start to before end of each section of each document.

    ``sections`` maps the bytes of a text to the first bytes of its sections, the first of them 0. Null text counts as
    empty: one empty section without tokens. An empty last line (after a final line feed) is a section of its own.
    Repeated rows give repeated results; an empty table gives an empty table. Only the id and the text are read. Texts may
    hold runs of letters, marks or white space of any length.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {', '.join(RULES)}")
    ranks = read_ranks(ranks_path)
    name = hashlib.sha256(repr((sorted(ranks.items()), pattern)).encode()).hexdigest()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder, lengths = encoding(name, ranks, pattern)
        pieces = regex.compile(whole_text_pattern(pattern)).findall
        rows, numbers, begins, ends, counts = [], [], [], [], []
        for row, text in enumerate(texts_of(batch.column(1))):
            data = np.frombuffer(text.encode(), np.uint8)
            starts = sections(data)
            counts.append(attribute(lengths[token_ids(coder, pieces, text)], starts, len(data), rule))
            points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points before each byte
            begin = points[starts]
            begins.append(begin)
            ends.append(np.append(begin[1:], points[-1]))
            numbers.append(np.arange(len(starts)))
            rows.append(np.full(len(starts), row))
        together = lambda x: np.concatenate(x or [np.empty(0, np.int64)]).astype(np.int64)
        columns = [batch.column(0).take(pa.array(together(rows))), *(pa.array(together(x)) for x in (numbers, begins, ends, counts))]
        return pa.RecordBatch.from_arrays(columns, names=[id_col, "section", "start", "end", "n_tokens"])

    chosen = docs.select(f"`{id_col}`", f"`{text_col}`")
    return map_chunks(chosen, work, f"`{id_col}` {chosen.dtypes[0][1]}, section bigint, start bigint, end bigint, n_tokens bigint", text_col)
