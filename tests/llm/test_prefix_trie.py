import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from oracle_check import compare, oracle_connection
from pyspark.sql import functions as F

from claimsift.llm import prefix_trie
from claimsift.llm.prefix_trie import conversation_trie, joined_ids_sha256
from claimsift.llm.queries import ORACLES, QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows, heads=True):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append(((turn is not None, turn or 0), role.encode(), hashlib.md5(text.encode()).hexdigest(), role, text))
    own = {c: [t[3:] for t in sorted(turns)] for c, turns in own.items()}
    built = own
    if heads:
        built = {}
        for c, turns in own.items():
            h = zlib.crc32(str(c).encode()) % 4
            base = c - (c % 20 if c >= 0 else -(-c % 20))
            built[c] = own.get(base, [])[:h] + turns[h:]
    members, below = defaultdict(list), defaultdict(set)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
            if d:
                below[tuple(built[c][: d - 1])].add(tuple(built[c][:d]))
    out = {}
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        children = [out[child] for child in below[node]]
        ends = [c for c in members[node] if len(built[c]) == len(node)]
        out[node] = [
            members[node][0], len(node), members[node[:-1]][0] if node else None, len(members[node]), len(children),
            sum(c[5] for c in children) or 1, sum(c[6] for c in children) + (len(members[node]) - 1) * words,
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ]
    return sorted(out.values(), key=lambda r: r[:2])


def found(frame):
    return sorted(([*r] for r in frame.collect()), key=lambda r: r[:2])


def random_turns(rng, convs, longest):
    rows = []
    trunks = [[(rng.choice(["user", "assistant"]), f"trunk {t} word {k}") for k in range(longest)] for t in range(3)]
    for c in convs:
        turns = list(rng.choice(trunks)[: rng.randint(0, longest)]) + [("user", f"own {rng.randint(0, 2)}") for _ in range(rng.randint(0, 3))]
        rows += [(c, k, role, text) for k, (role, text) in enumerate(turns or [("user", "x")])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block_turns", [1, 3, 8])
def test_equals_brute_force(spark, monkeypatch, block_turns):
    monkeypatch.setattr(prefix_trie, "RUN_BLOCKS", 2)
    monkeypatch.setattr(prefix_trie, "PIECE_CHARS", 10)
    rng = random.Random(block_turns)
    rows = random_turns(rng, [*range(-30, 60, 2), 1000, 1001], 21)
    frame = spark.createDataFrame(rows, SCHEMA)
    assert found(conversation_trie(frame, "conv_id", "turn", "role", "text", block_turns=block_turns)) == brute(rows)
    assert found(conversation_trie(frame, "conv_id", "turn", "role", "text", heads=None, block_turns=block_turns)) == brute(rows, heads=False)


def test_edges(spark):
    rows = [
        (20, None, "user", "first"), (20, 1, None, None), (20, 1, "", "tie"), (20, 1, "", "tie"), (20, 2, "a", "  \t "),
        (23, 0, "user", "only"), (45, 0, "u", "base is absent"), (None, 0, "user", "no id"), (41, 0, "x", ""), (42, 0, "x", ""), (43, 0, "x", "   "),
        (24, 0, "q", "z " * 300_000), (26, 1, "q", "z " * 300_000), (26, -1, "user", "x"),
    ]
    frame = spark.createDataFrame(rows, SCHEMA).select("*", F.lit(1).alias("conv"), F.lit(2).alias("depth"), F.lit(3).alias("n"), F.lit(4).alias("a"))
    assert found(conversation_trie(frame, "conv_id", "turn", "role", "text")) == brute(rows)
    assert found(conversation_trie(frame, "conv_id", "turn", "role", "text", heads=None)) == brute(rows, heads=False)
    assert conversation_trie(frame.limit(0), "conv_id", "turn", "role", "text").count() == 0


def test_one_conversation_over_many_slices_and_equal_conversations(spark):
    rows = [(100, k, "user", f"t{k}") for k in range(3000)] + [(c, k, "user", f"t{k}") for c in range(0, 100, 20) for k in range(40)]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert found(conversation_trie(frame, "conv_id", "turn", "role", "text")) == brute(rows)


def test_only_turnless_conversations(spark):
    c = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 >= 2)
    rows = [(c, 0, "user", "gone"), (c + 1000 * 20, 0, "user", "x")]
    assert found(conversation_trie(spark.createDataFrame(rows[:1], SCHEMA), "conv_id", "turn", "role", "text")) == brute(rows[:1])


def test_hash_of_joined_ids(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE_CHARS", 30)
    frame = spark.range(1000).select((F.col("id") % 3).alias("g"), (F.col("id") - 500).alias("conv"))
    got = {r["g"]: r["sha"] for r in joined_ids_sha256(frame, ["g"]).collect()}
    assert got == {g: hashlib.sha256(",".join(str(k - 500) for k in range(1000) if k % 3 == g).encode()).hexdigest() for g in range(3)}


def test_query_equals_oracle_and_brute_force(spark, small):
    rows, problem = compare(spark, oracle_connection(small), "op13_prefix_trie", small, QUERIES, ORACLES)
    assert problem is None and rows > 10
    turns = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(QUERIES["op13_prefix_trie"](spark, small)) == brute(turns)
