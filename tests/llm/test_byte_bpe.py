import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from claimsift.llm.byte_bpe import Codec, PairRanks, bpe_round_trip, merge_pieces, read_ranks, whole_text_pattern
from claimsift.llm.queries import QUERIES, RANKS

PATH = public_tokenizers.path(RANKS)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return Codec(read_ranks(PATH), whole_text_pattern(public_tokenizers.PATTERN))


def ids(codec, text):
    return np.frombuffer(codec.encode([text])[0], "<u4").tolist()


@pytest.mark.parametrize("text", [
    "", "a", "   x  y\n\n z ", "\x1c\x1d a\x85b c　d", "é²½ⅧⅨ１２", " 's'll don't", "a" * 3000, "ab" * 1500, "日本語" * 200,
    "̀abc\U0001f600\U0001f600 x", "<|endoftext|>", "\0\0", "x" + " " * 500 + "y",
])
def test_equals_the_library(codec, library, text):
    assert ids(codec, text) == library.encode_ordinary(text)
    assert codec.decode(codec.encode([text])[0]) == text.encode()


def test_equals_the_library_on_random_text(codec, library):
    rng = random.Random(5)
    ranges = [(32, 127), (9, 14), (28, 32), (0x80, 0x250), (0x2000, 0x2070), (0x3000, 0x30FF), (0x370, 0xD7FF), (0x10000, 0x1FFFF)]
    texts = ["".join(chr(rng.randrange(*rng.choice(ranges))) for _ in range(rng.randrange(80))) for _ in range(1500)]
    for text, got in zip(texts, codec.encode(texts)):
        assert np.frombuffer(got, "<u4").tolist() == library.encode_ordinary(text)


def test_the_leftmost_of_equal_ranks_merges_first():
    ranks = {bytes([b]): b for b in range(256)} | {b"aa": 256, b"aaa": 257}
    byte_ids = np.arange(256, dtype=np.int32)
    got = [np.frombuffer(x, "<u4").tolist() for x in merge_pieces([b"aaaaa", b"baaa"], byte_ids, PairRanks(ranks))]
    assert got == [[256, 257], [98, 257]]  # aa|a|aa: the first pairs, then what is left joins


def test_forgetting_pieces_changes_nothing(library, monkeypatch):
    monkeypatch.setattr("claimsift.llm.byte_bpe.REMEMBERED", 3)
    small = Codec(read_ranks(PATH), whole_text_pattern(public_tokenizers.PATTERN))
    for text in ("one two three four five", "five six seven", "one"):
        assert ids(small, text) == library.encode_ordinary(text)


def test_query_equals_the_library(spark, library, small):
    rows = QUERIES["op6_bpe_segment_tree"](spark, small).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        want = library.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(want)
        assert r["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_edges(documents):
    docs = documents([(1, None), (2, ""), (None, "a b"), (3, "x"), (3, "x")])
    rows = bpe_round_trip(docs, "doc_id", "text", PATH, public_tokenizers.PATTERN, ids_col="ids").orderBy("doc_id").collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert [(r["doc_id"], r["n_tokens"]) for r in rows] == [(None, 2), (1, 0), (2, 0), (3, 1), (3, 1)]
    assert rows[1]["ids_sha256"] == rows[1]["decoded_sha256"] == empty and rows[1]["ids"] == []
    assert bpe_round_trip(docs.filter(F.lit(False)), "doc_id", "text", PATH, public_tokenizers.PATTERN).count() == 0
