import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimsift.llm import parity_join
from claimsift.llm.common import drop_cut
from claimsift.llm.components import components
from claimsift.llm.parity_join import Bands, jaccard_groups, near_in_block, passing, shingle_sets, signatures, sketch, sketches, word_filter, word_hashes
from claimsift.llm.queries import QUERIES


def brute_set(text, size=4):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {" ".join(words[k : k + size]) for k in range(len(words) - size + 1)} or ({" ".join(words)} if words else set())


def brute(rows, percent=85):
    sets = [brute_set(t) for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]) and group[a] != group[b]:
                group = [group[b] if g == group[a] else g for g in group]
    least = {}
    for (i, _), g in zip(rows, group):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    return sorted(((i if i is not None else -1), len(s), least.get(g, -1)) for (i, _), s, g in zip(rows, sets, group))


def found(frame):
    return sorted((r[0] if r[0] is not None else -1, r[1], r[2] if r[2] is not None else -1) for r in frame.collect())


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        words[at : at + 1] = rng.choice([[f"new{rng.random()}"], [], [words[at], f"more{rng.random()}"]])
    return words


def test_sizes_of_similar_sets_are_at_most_one_band_apart():
    for percent in (50, 85, 97):
        bands = Bands(percent)
        for small in range(1, 3000):
            large = 100 * small // percent
            assert bands.of(large) - bands.of(small) <= 1
            differing, _ = bands.shape(bands.of(large))
            common = small
            assert large - common <= differing


def test_sketch_distance_is_at_most_the_difference():
    rng = np.random.default_rng(2)
    for _ in range(200):
        pool = np.unique(rng.integers(0, 2**64, 60, dtype=np.uint64))
        a, b = (np.sort(rng.choice(pool, rng.integers(1, 50), replace=False)) for _ in range(2))
        words = int(rng.integers(1, 20))
        got = int(np.bitwise_count(sketch(a, words) ^ sketch(b, words)).sum())
        want = len(np.setxor1d(a, b))
        assert got <= want and (want - got) % 2 == 0
        slow = np.zeros(words, np.uint64)
        for h in a.tolist():
            slow[(h >> 32) * words >> 32] ^= np.uint64(1 << (h & 63))
        assert (slow == sketch(a, words)).all()


def enough(mine, others):
    every = np.concatenate([sigs for _, _, sigs in others])
    return any(len(np.intersect1d(sigs, every)) >= need for _, need, sigs in mine)


@pytest.mark.parametrize("percent", [78, 85, 95])
def test_similar_sets_always_share_a_signature(percent, largest=900):
    rng = np.random.default_rng(percent)
    bands, tried = Bands(percent), 0
    for _ in range(800):
        n = int(rng.integers(6, 40) if rng.random() < 0.7 else rng.integers(40, largest))
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        most = (100 - percent) * len(a) // 100
        gone, fresh = int(rng.integers(0, most + 2)), int(rng.integers(0, most + 2))
        b = np.unique(np.concatenate([rng.choice(a, max(1, len(a) - gone), replace=False), rng.integers(0, 2**64, fresh, dtype=np.uint64)]))
        if parity_join.similar(a, b, percent) and len(np.setxor1d(a, b)):
            tried += 1
            one, two = signatures(sketches(a, bands), bands), signatures(sketches(b, bands), bands)
            assert enough(one, two) and enough(two, one)
    assert tried > 100


def test_light_words_join_in_pairs(monkeypatch):
    monkeypatch.setattr(parity_join, "LIGHT_BITS", 64)  # all words are light
    test_similar_sets_always_share_a_signature(85, 150)


def test_filter_holds_all(spark):
    sigs = np.random.default_rng(0).integers(-(2**63), 2**63, 5000)
    held = word_filter(spark.createDataFrame([(int(s),) for s in sigs], "sig long"))
    assert passing(sigs.view(np.uint64), held).all()
    other = np.random.default_rng(1).integers(0, 2**64, 5000, dtype=np.uint64)
    assert passing(other, held).sum() < 200


@pytest.mark.parametrize("text", ["", " \t", "a", "A b\x0bc", "a b c d", "a b c d a B c d", "one two three four five one two three four", "é\x85x y z w", "w " * 500])
def test_sets_have_one_hash_for_each_shingle(text, monkeypatch):
    monkeypatch.setattr(parity_join, "HASHED_BYTES", 7)
    before, found, after = shingle_sets(["q r s t u", text, "v w"], 4)
    assert len(found) == len(brute_set(text)) and (np.diff(found.astype(object)) > 0).all()
    assert (shingle_sets([text.upper().lower()], 4)[0] == found).all() and len(before) == 2 and len(after) == 1
    assert not len(np.intersect1d(found, shingle_sets(["one two three"], 4)[0]))


def test_words_have_the_same_hash_wherever_they_stand(monkeypatch):
    words = ["a", "b", "ab", "ba", "a" * 300, "b" * 300, "a" * 299, "é", "\x00", "\x00\x00"]
    want = {w: int(word_hashes(w.encode())[1][0]) for w in words}
    assert len(set(want.values())) == len(words)
    text = "  ".join(words * 3).encode()
    for size in (5, 64, 1 << 21):
        monkeypatch.setattr(parity_join, "HASHED_BYTES", size)
        starts, hashes = word_hashes(text)
        assert hashes.tolist() == [want[w] for w in words * 3]
        assert [text[s:].split()[0].decode() for s in starts] == words * 3


def test_block_comparison_finds_what_is_near():
    rng = np.random.default_rng(5)
    base = np.unique(rng.integers(0, 2**64, 100, dtype=np.uint64))
    sets = [np.sort(rng.choice(base, 95, replace=False)) for _ in range(20)] + [np.unique(rng.integers(0, 2**64, 95, dtype=np.uint64)) for _ in range(20)]
    words, sizes = np.array([sketch(s, 20) for s in sets]), np.full(40, 95)
    pairs = set(zip(*(x.tolist() for x in near_in_block(words, sizes, np.arange(40), np.zeros(40), 85))))
    similar = {(i, j) for i in range(40) for j in range(i + 1, 40) if parity_join.similar(sets[i], sets[j], 85)}
    assert similar <= pairs and all(j < 20 for _, j in pairs) and len(similar) == 190
    assert not len(near_in_block(words, sizes, np.repeat([0, 1], 20), np.zeros(40), 85)[0])
    across = near_in_block(words, sizes, np.arange(40), np.arange(40) % 2, 85)
    assert len(across[0]) == 100 and ((across[0] - across[1]) % 2 == 1).all()


@pytest.mark.parametrize("block", [None, 3])
def test_chains_and_near_copies_equal_brute_force(spark, monkeypatch, block):
    if block:
        monkeypatch.setattr(parity_join, "BLOCK_SETS", block)
        monkeypatch.setattr(parity_join, "BLOCK_HASHES", 1)
        monkeypatch.setattr(parity_join, "PIVOTS", 1)
    rng = random.Random(7)
    texts = []
    for k in range(6):  # chains: neighbours are similar, ends are not
        words = [f"c{k}w{i}" for i in range(rng.choice([9, 14, 40, 120]))]
        for _ in range(12):
            texts.append(" ".join(words))
            words = edited(rng, words, rng.randint(1, 2))
    stock = [f"stock{i}" for i in range(60)]  # a passage in unrelated documents
    texts += [" ".join(stock + [f"d{k}x{i}" for i in range(rng.randint(0, 12))]) for k in range(30)]
    short = [f"s{i}" for i in range(10)]
    texts += [" ".join(rng.sample(short, rng.randint(1, 9))) for _ in range(60)]
    rng.shuffle(texts)
    rows = list(enumerate(texts, 100))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute(rows)
    assert len({w[2] for w in want}) < len(rows)
    assert found(jaccard_groups(frame, "doc_id", "text")) == want


def test_edges(spark, documents):
    long = "y " * 400_000 + "end"
    rows = [(9, None), (8, ""), (7, " \t"), (6, "A b c"), (5, "a B  c"), (5, "a B  c"), (4, "a b"), (None, "a b"), (None, "n u l l"), (3, long), (2, long.upper()), (1, "x" * 3_000_000)]
    assert found(jaccard_groups(documents(rows), "doc_id", "text")) == brute(rows)
    odd = documents(rows).select(F.col("doc_id").alias("doc.id"), F.col("text").alias("the text"), F.lit(1).alias("key"), F.lit(2).alias("n"), F.lit(3).alias("id"))
    assert found(jaccard_groups(odd, "doc.id", "the text")) == brute(rows)
    assert jaccard_groups(documents(rows).limit(0), "doc_id", "text").count() == 0


def test_query_equals_brute_force(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    want = brute(rows)
    assert found(QUERIES["op11_parity_join"](spark, small)) == want
    assert len({w[2] for w in want}) < len(rows)


def test_a_forest_connects_what_all_near_pairs_connect():
    rng = np.random.default_rng(5)
    groups = [rng.integers(0, 2**63, 300, dtype=np.uint64) for _ in range(3)]
    sets = [np.unique(np.concatenate([g[k : k + 280], rng.integers(0, 2**63, 5, dtype=np.uint64)])) for k in range(20) for g in groups]
    words = np.array([sketch(h, 60) for h in sets])
    given = (words, np.array([len(h) for h in sets]), np.arange(len(sets)), np.zeros(len(sets), np.int64), 85)

    def connected(pairs):
        of = list(range(len(sets)))
        for a, b in zip(*pairs):
            of = [of[a] if x == of[b] else x for x in of]
        return [of.index(x) for x in of]

    every, forest = near_in_block(*given), near_in_block(*given, forest=True)
    assert connected(every) == connected(forest) and len(forest[0]) == len(sets) - len(set(connected(every))) < len(every[0])


@pytest.mark.parametrize("percent", [75, 85, 97])
def test_signatures_of_many_sets_are_those_of_each(percent):
    rng = np.random.default_rng(percent)
    bands = Bands(percent)
    sets = [np.unique(rng.integers(0, 2**64, int(n), dtype=np.uint64)) for n in [0, 1, 2, 700, 0, *rng.integers(0, 60, 150), *rng.integers(0, 900, 30)]]
    for some in (sets, sets[:1], []):
        found = parity_join.signature_lists(some, bands)
        ends = np.cumsum(found.sizes)
        got = [(i, t, n, found.sigs[end - size : end].tolist()) for i, t, n, size, end in zip(found.of, found.tag, found.need, found.sizes, ends)]
        assert got == [(i, t, n, sigs.tolist()) for i, h in enumerate(some) for t, n, sigs in signatures(sketches(h, bands), bands)]


def test_few_edges_stay_in_few_files(spark):
    edges = spark.range(300).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v")).repartition(37)
    found = components(edges)
    assert found.rdd.getNumPartitions() == 1
    assert sorted(map(tuple, found.collect())) == [(k, 0) for k in range(1, 301)]


def test_files_of_what_is_no_longer_read_are_removed(spark, small, monkeypatch):
    dropped = []
    monkeypatch.setattr(parity_join, "drop_cut", lambda df: (dropped.append(df._jdf.queryExecution().logical().rdd().getCheckpointFile().get()), drop_cut(df)))
    assert QUERIES["op11_parity_join"](spark, small).count() == spark.read.parquet(f"{small}/documents.parquet").count()
    assert len(dropped) >= 4 and not any(os.path.exists(path.removeprefix("file:")) for path in dropped)


def test_of_what_lists_share_enough_is_kept():
    """Signatures of large groups are dropped, and two lists still share what both need less the larger number dropped."""
    rng = np.random.default_rng(3)
    frequent = np.zeros(1 << 6, np.uint64)
    frequent[:20] = np.uint64(2**64 - 1)  # lets about a tenth through
    some, fewer = 0, 0
    for _ in range(300):
        pool = rng.integers(0, 2**64, 60, dtype=np.uint64)
        pool[:40] &= ~np.uint64(2**12 - 1) | np.uint64(1023)
        pool[:40] &= np.uint64(2**63 - 1 >> 1)
        pool = np.unique(pool)
        sets = [rng.choice(pool, int(rng.integers(10, len(pool))), replace=False) for _ in range(2)]
        common = len(np.intersect1d(*sets))
        need = rng.integers(1, common + 1, 2) if common else np.ones(2, np.int64)
        sizes = np.array([len(s) for s in sets])
        lists = parity_join.Lists(np.arange(2), np.zeros(2, np.int64), need, sizes, np.concatenate(sets))
        kept, dropped = parity_join.kept_signatures(lists, frequent)
        assert (~kept).sum() == dropped.sum() and (dropped <= np.maximum(need - parity_join.LEAST_SHARED, 0)).all()
        assert passing(lists.sigs[~kept], frequent).all()
        left = [lists.sigs[: sizes[0]][kept[: sizes[0]]], lists.sigs[sizes[0] :][kept[sizes[0] :]]]
        if common:
            assert len(np.intersect1d(*left)) >= need.max() - dropped.max() >= 1
        some, fewer = some + bool(dropped.sum()), fewer + (len(np.intersect1d(*left)) < common)
    assert some > 100 and fewer > 50


@pytest.mark.parametrize("at_once", [1, 3, 7, 1000])
def test_groups_cross_batches(spark, monkeypatch, at_once):
    monkeypatch.setattr(parity_join, "PIVOTS", 3)
    rng = random.Random(at_once)
    rows = [(owner, 2, 1, 0, sig) for sig, n in enumerate([1, 2, 4, 5, 4, 3, 9, 20, 1]) for owner in rng.sample(range(40), n)]
    members, shared = Counter(r[4] for r in rows), Counter()
    for sig in members:
        of_sig = sorted(r[0] for r in rows if r[4] == sig)
        shared.update((u, v) for k, v in enumerate(of_sig[:3]) for u in of_sig[k + 1 :])
    want = {(u, v, 2) for u, v in shared} | {(r[0], r[4], -3) for r in rows if members[r[4]] > 4}
    frame = spark.createDataFrame(rows, "owner bigint, tag bigint, need bigint, dropped bigint, sig bigint")
    with parity_join._small_batches(spark):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(at_once))
        assert sorted(map(tuple, parity_join.pairs_and_members(frame).collect())) == sorted(want)
        twice = parity_join.pairs_and_members(frame.withColumn("need", F.lit(3)).withColumn("dropped", F.lit(1)))
        assert {(r.u, r.v) for r in twice.filter("tag > 0").collect()} == {pair for pair, n in shared.items() if n >= 2}


def test_no_similar_pair_is_far_by_compared_sketches(spark):
    """Far ones are left out before their hashes are shuffled."""
    rng = np.random.default_rng(8)
    bands, rows, sets = Bands(85), [], {}
    for k in range(40):
        base = np.unique(rng.integers(0, 2**64, int(rng.integers(20, 600)), dtype=np.uint64))
        for part in (0.99, 0.95, 0.85, 0.6):
            sets[len(sets)] = np.sort(rng.choice(base, max(1, int(part * len(base))), replace=False))
    rows = [(k, len(h), h.tobytes()) for k, h in sets.items()]
    frame = spark.createDataFrame(rows, "owner bigint, n bigint, hashes binary")
    pairs = [(u, v, bands.of(max(len(sets[u]), len(sets[v])))) for u in sets for v in range(u // 4 * 4, u) if abs(bands.of(len(sets[u])) - bands.of(len(sets[v]))) <= 1]
    pairs += [(u, v, bands.of(len(sets[u]))) for u in sets for v in range(u // 4 * 4) if bands.of(len(sets[u])) == bands.of(len(sets[v]))]
    sketched = parity_join.compared_sketches(frame, bands)
    near = {tuple(r) for r in parity_join.near_pairs(spark.createDataFrame(pairs, "u bigint, v bigint, band bigint"), sketched, 85).collect()}
    similar = {(u, v) for u, v, _ in pairs if parity_join.similar(sets[u], sets[v], 85)}
    assert similar <= near and len(similar) > 40 and len(near) < len(similar) + 0.1 * len(pairs) < len(pairs)


def test_few_bytes_of_a_set_are_compared_in_lists():
    """At scale the hashes and whole sketches of lists' members were most of what was shuffled."""
    bands = Bands(85)
    for n in (100, 1000, 10_000):
        assert 8 * bands.compared_words(bands.of(n)) < 0.07 * 8 * n
