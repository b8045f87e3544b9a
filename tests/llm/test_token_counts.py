from collections import Counter

import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from claimsift.llm.byte_bpe import read_ranks, whole_text_pattern
from claimsift.llm.queries import COUNTING_RANKS, QUERIES
from claimsift.llm.token_counts import section_tokens, token_ids

PATH = public_tokenizers.path(COUNTING_RANKS)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})


def brute(library, text, rule):
    """(start, end, tokens) of each line, byte by byte."""
    data = text.encode()
    lines, at = [], 0
    for line in text.split("\n"):
        lines.append((at, at + len(line.encode()) + 1))
        at = lines[-1][1]
    lines[-1] = (lines[-1][0], len(data))
    counts, at = Counter(), 0
    for token in library.encode_ordinary(text):
        size = len(library.decode_single_token_bytes(token))
        held = Counter(next(k for k in range(len(lines)) if b < lines[k][1] or k == len(lines) - 1) for b in range(at, at + size))
        counts[min(held) if rule == "start" else min(held, key=lambda k: (-held[k], k))] += 1
        at += size
    return [(len(data[:a].decode()), len(data[:b].decode()), counts[k]) for k, (a, b) in enumerate(lines)]


TEXTS = ["", "a", "\n", "\n\n\n", "one\ntwo three\n\n\n  four\n", "é\n日本\n\U0001f600", " \n \n\t\n\nx", "a.\n\n\nb", "\r\n\r\n z"]


@pytest.mark.parametrize("rule", ["start", "majority"])
def test_equals_brute_force(spark, library, documents, rule):
    docs = documents(list(enumerate(TEXTS)))
    rows = section_tokens(docs, "doc_id", "text", PATH, public_tokenizers.PATTERN, rule).orderBy("doc_id", "section").collect()
    for k, text in enumerate(TEXTS):
        assert [(r["start"], r["end"], r["n_tokens"]) for r in rows if r["doc_id"] == k] == brute(library, text, rule), text


def test_query_equals_brute_force(spark, library, small):
    rows = QUERIES["op1_section_tokens"](spark, small).orderBy("doc_id", "section").collect()
    for r in spark.read.parquet(f"{small}/documents.parquet").filter("length(text) < 3000").collect():
        mine = [(x["start"], x["end"], x["n_tokens"]) for x in rows if x["doc_id"] == r["doc_id"]]
        assert mine == brute(library, r["text"], "start")


def split_by_hand(library, text):
    """Tokens of runs: the library's pattern cannot take a long run of white space."""
    if text.isspace():
        return library._encode_single_piece(text)
    if text[-1:].isspace():
        body = text.rstrip()
        return library.encode_ordinary(body) + library._encode_single_piece(text[len(body) :])
    return library.encode_ordinary(text)


@pytest.mark.parametrize("text", ["x" + "\n" * 2_000_000, " " * 2_000_000, "a" * 2_000_000, "é\t" + "\n " * 600_000])
def test_runs_of_any_length(documents, library, text):
    docs = documents([(1, text), (2, "a b")])
    want = len(split_by_hand(library, text))
    counted = section_tokens(docs, "doc_id", "text", PATH, public_tokenizers.PATTERN)
    got = {r["doc_id"]: (r["n"], r["sections"], r["end"]) for r in counted.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("sections"), F.max("end").alias("end")).collect()}
    assert got == {1: (want, text.count("\n") + 1, len(text)), 2: (2, 1, 3)}


def test_the_way_round_gives_the_same_tokens(library):
    pieces = regex.compile(whole_text_pattern(public_tokenizers.PATTERN)).findall

    class Refusing:
        _encode_single_piece = library._encode_single_piece

        def encode_to_numpy(self, *args, **kwargs):
            raise ValueError

    for text in [*TEXTS, "it's 12 a's  b c  \u0085 x\x1c y", "  \n\n  word", "tab\t\tend  "]:
        assert token_ids(Refusing(), pieces, text).tolist() == library.encode_ordinary(text), text


def test_edges(documents):
    docs = documents([(1, None), (2, "a\n"), (2, "a\n"), (None, "b")])
    rows = section_tokens(docs, "doc_id", "text", PATH, public_tokenizers.PATTERN).orderBy("doc_id", "section").collect()
    assert [tuple(r)[:4] for r in rows] == [(None, 0, 0, 1), (1, 0, 0, 0), (2, 0, 0, 2), (2, 0, 0, 2), (2, 1, 2, 2), (2, 1, 2, 2)]
    assert section_tokens(docs.filter(F.lit(False)), "doc_id", "text", PATH, public_tokenizers.PATTERN).count() == 0
    with pytest.raises(ValueError):
        section_tokens(docs, "doc_id", "text", PATH, public_tokenizers.PATTERN, "other")
