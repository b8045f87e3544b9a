"""Prefix trie of conversations by hashing blocks of turns.

A turn is reduced to two 64-bit hashes and a word count where it is read. The hash of a sequence is the exclusive or of
its turns' hashes, each mixed with its position; so sequences can be hashed in pieces of any size. Conversations are cut
into blocks of a fixed number of turns. Conversations that agree in all blocks before form siblings in the next one. Where
all siblings have the same block, its turns are nodes of the same members and nothing is hashed below the block; only where
siblings diverge are prefixes hashed turn by turn.

Positions come from one global sort in slices, so a conversation of any length spreads over tasks. Sums over subtrees are
made for nodes of several members only (a node of one member is a chain with one leaf that saves nothing), by doubling the
distance over which a node hands its sum upwards: as many rounds as the longest shared prefix has binary digits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimsift.llm.common import cut

BLOCK_TURNS = 8
#: Blocks whose hashes are run up in one window; the sums of such runs are run up in a second one.
RUN_BLOCKS = 1024
#: Characters of joined ids that one row carries to the final hash.
PIECE_CHARS = 1 << 16
SPACES = r"[\x20\x09-\x0D]+"


def ordered_turns(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, pos, t1, t2, words): the turns of every conversation, numbered from 1."""
    role = F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit(""))
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = turns.filter(F.col(f"`{conv_col}`").isNotNull()).select(
        F.col(f"`{conv_col}`").cast("bigint").alias("conv"), F.col(f"`{turn_col}`").alias("turn"), role.alias("role"),
        F.md5(text.cast("binary")).alias("text_md5"), F.xxhash64(role, text).alias("t1"), F.xxhash64(text, F.lit(1), role).alias("t2"),
        F.size(F.array_remove(F.split(text, SPACES), "")).cast("bigint").alias("words"),
    )
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "text_md5"]
    spread = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slices = cut(rows.repartitionByRange(spread, *order).sortWithinPartitions(*order).select("conv", "t1", "t2", "words"))
    numbered = slices.withColumn("slice", F.spark_partition_id()).withColumn("seq", F.monotonically_increasing_id())
    # as many rows for a conversation as it has slices
    pieces = numbered.groupBy("conv", "slice").agg(F.min("seq").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("conv").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select("conv", "slice", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1).alias("shift"))
    return numbered.join(offsets, ["conv", "slice"]).select("conv", (F.col("seq") + F.col("shift")).alias("pos"), "t1", "t2", "words")


def shared_heads(conv: Column) -> tuple[Column, Column]:
    """(conversation whose first turns are taken over, how many of them)."""
    return conv - conv % 20, (F.crc32(conv.cast("string")) % 4).cast("bigint")


def rebuild(turns: DataFrame, heads=shared_heads, longest_head: int = 3) -> tuple[DataFrame, DataFrame]:
    """Turns and (conv, length) after the first turns of each conversation are replaced by those of another one."""
    lengths = cut(turns.groupBy("conv").agg(F.max("pos").alias("own")))
    base, head = heads(F.col("conv"))
    convs = lengths.select("conv", "own", base.alias("base"), head.alias("head"))
    there = lengths.select(F.col("conv").alias("base"), F.col("own").alias("of_base"))
    led = cut(
        convs.join(there, "base", "left")
        .withColumn("lead", F.least("head", F.coalesce("of_base", F.lit(0))))
        .select("conv", "base", "head", "lead", (F.col("lead") + F.greatest(F.col("own") - F.col("head"), F.lit(0))).alias("length"))
    )
    own = turns.join(led.select("conv", "head", "lead"), "conv").filter("pos > head").select(
        "conv", (F.col("pos") - F.col("head") + F.col("lead")).alias("pos"), "t1", "t2", "words"
    )
    first = turns.filter(F.col("pos") <= longest_head).withColumnRenamed("conv", "base")
    taken = led.filter("lead > 0").join(first, "base").filter("pos <= lead").select("conv", "pos", "t1", "t2", "words")
    return own.unionByName(taken), led.select("conv", "length")


def block_prefixes(blocks: DataFrame) -> DataFrame:
    """Add xa, xb: the hash of all blocks of the conversation before this one. ``blocks`` is (conv, block, a, b)."""
    parts = blocks.withColumn("run", F.expr(f"block div {RUN_BLOCKS}"))
    inside = Window.partitionBy("conv", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    runs = parts.groupBy("conv", "run").agg(F.bit_xor("a").alias("ra"), F.bit_xor("b").alias("rb"))
    before = Window.partitionBy("conv").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("bigint")
    earlier = runs.select("conv", "run", *[F.coalesce(F.bit_xor(r).over(before), none).alias(r) for r in ("ra", "rb")])
    local = parts.select("*", *[F.coalesce(F.bit_xor(c).over(inside), none).alias(f"i{c}") for c in ("a", "b")])
    return local.join(earlier, ["conv", "run"]).select(
        "conv", "block", "a", "b", F.col("ia").bitwiseXOR(F.col("ra")).alias("xa"), F.col("ib").bitwiseXOR(F.col("rb")).alias("xb")
    )


def trie_nodes(turns: DataFrame, lengths: DataFrame, block_turns: int) -> tuple[DataFrame, DataFrame]:
    """Nodes (conv, depth, n, words, da, db, qa, qb), and (conv, depth, da, db) of the node where each conversation ends.

    da, db hash the node's sequence, qa, qb its parent's; both are null inside a block that all siblings share, where the
    parent has the same members.
    """
    hashed = cut(
        turns.select(
            "conv", "pos", "words", F.expr(f"(pos - 1) div {block_turns}").alias("block"),
            F.xxhash64("pos", "t1", "t2").alias("a"), F.xxhash64("t2", "pos", "t1").alias("b"),
        )
    )
    blocks = cut(
        block_prefixes(hashed.groupBy("conv", "block").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b")))
    )
    # the first block follows the root, whose children are everything: always turn by turn
    later = blocks.filter("block > 0")
    siblings = cut(
        later.groupBy("block", "xa", "xb").agg(
            F.count("*").alias("n"), F.min("conv").alias("least"), F.min(F.struct("a", "b")).alias("low"), F.max(F.struct("a", "b")).alias("high")
        )
    )
    diverging = siblings.filter("low <> high").select("block", "xa", "xb")
    forked = blocks.filter("block = 0").unionByName(later.join(diverging, ["block", "xa", "xb"], "left_semi").select(*blocks.columns))
    run = Window.partitionBy("conv", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one block
    stepped = hashed.join(forked.select("conv", "block", "xa", "xb"), ["conv", "block"]).select(
        "conv", "pos", "words", "a", "b",
        *[F.col(x).bitwiseXOR(F.bit_xor(c).over(run)).alias(d) for x, c, d in (("xa", "a", "da"), ("xb", "b", "db"))],
    )
    fine = stepped.groupBy(F.col("pos").alias("depth"), "da", "db").agg(
        F.min("conv").alias("conv"), F.count("*").alias("n"), F.max("words").alias("words"),
        F.max(F.col("da").bitwiseXOR(F.col("a"))).alias("qa"), F.max(F.col("db").bitwiseXOR(F.col("b"))).alias("qb"),
    )
    alike = siblings.filter("low = high").select(
        F.col("least").alias("conv"), "block", "n", "xa", "xb",
        F.col("xa").bitwiseXOR(F.col("low.a")).alias("ya"), F.col("xb").bitwiseXOR(F.col("low.b")).alias("yb"),
    )
    last = Window.partitionBy("conv", "block")  # one block
    first_turn = (F.col("pos") - 1) % block_turns == 0
    last_turn = F.col("pos") == F.max("pos").over(last)
    coarse = hashed.join(alike, ["conv", "block"]).select(
        "conv", F.col("pos").alias("depth"), "n", "words",
        F.when(last_turn, F.col("ya")).alias("da"), F.when(last_turn, F.col("yb")).alias("db"),
        F.when(first_turn, F.col("xa")).alias("qa"), F.when(first_turn, F.col("xb")).alias("qb"),
    )
    ends = blocks.select("conv", "block", F.col("xa").bitwiseXOR(F.col("a")).alias("da"), F.col("xb").bitwiseXOR(F.col("b")).alias("db")).join(
        lengths.filter("length > 0").select("conv", F.col("length").alias("depth"), F.expr(f"(length - 1) div {block_turns}").alias("block")), ["conv", "block"]
    )
    return cut(fine.unionByName(coarse)), cut(ends.select("conv", "depth", "da", "db"))


def joined_ids_sha256(members: DataFrame, by: list[str]) -> DataFrame:
    """(by, sha): SHA-256 of the ascending ids ``conv`` of each group, joined by commas.

    The ids are sorted in slices and packed to pieces of bounded size, so that the one task which a sequential hash needs
    reads few rows even of a group with most conversations.
    """
    spread = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = ", ".join(f"{c} bigint" for c in by)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, first, ids, size = None, None, [], 0

        def piece() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(by, group)) | {"first": first, "piece": ",".join(ids)}], schema=packed)

        for batch in batches:
            for *row, conv in zip(*[batch.column(c).to_pylist() for c in (*by, "conv")]):
                if row != group or size > PIECE_CHARS:
                    if ids:
                        yield piece()
                    group, first, ids, size = row, conv, [], 0
                ids.append(str(conv))
                size += len(ids[-1]) + 1
        if ids:
            yield piece()

    packed = pa.schema([*[(c, pa.int64()) for c in by], ("first", pa.int64()), ("piece", pa.string())])
    pieces = members.select(*by, "conv").repartitionByRange(spread, *by, "conv").sortWithinPartitions(*by, "conv").mapInArrow(pack, f"{key}, first bigint, piece string")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, sha = None, None
        for batch in batches:
            out = []
            for *row, text in zip(*[batch.column(c).to_pylist() for c in (*by, "piece")]):
                if row != group:
                    if group is not None:
                        out.append(dict(zip(by, group)) | {"sha": sha.hexdigest()})
                    group, sha = row, hashlib.sha256(text.encode())
                else:
                    sha.update(b"," + text.encode())
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=hashed)
        if group is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(by, group)) | {"sha": sha.hexdigest()}], schema=hashed)

    hashed = pa.schema([*[(c, pa.int64()) for c in by], ("sha", pa.string())])
    return cut(pieces).repartition(*by).sortWithinPartitions(*by, "first").mapInArrow(digest, f"{key}, sha string")


def subtree_sums(nodes: DataFrame, root_conv: int) -> DataFrame:
    """(conv, depth, leaves, saved) summed over subtrees; ``nodes`` is (conv, depth, up, leaves, saved), up the parent's conv."""
    now = cut(nodes)
    deepest = now.agg(F.max("depth")).first()[0] or 0
    step = 1
    while step <= deepest:
        handed = now.filter(F.col("depth") >= step).groupBy(F.col("up").alias("conv"), (F.col("depth") - step).alias("depth")).agg(
            F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")
        )
        summed = now.join(handed, ["conv", "depth"], "left").select(
            "conv", "depth", "up", *[(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved")]
        )
        # who stands twice as far up: the root for many, which needs no join
        above = now.filter(F.col("depth") > step).select(F.col("conv").alias("up"), (F.col("depth") + step).alias("depth"), F.col("up").alias("further"))
        root = summed.filter(F.col("depth") <= 2 * step).withColumn("up", F.lit(root_conv).cast("bigint"))
        deep = summed.filter(F.col("depth") > 2 * step).join(above, ["up", "depth"]).select("conv", "depth", F.col("further").alias("up"), "leaves", "saved")
        now = cut(root.unionByName(deep))
        step *= 2
    return now.select("conv", "depth", "leaves", "saved")


def conversation_trie(
    turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, heads=shared_heads, longest_head: int = 3, block_turns: int = BLOCK_TURNS,
) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by ``turn_col``, null first; equal turns by role, then by the text's MD5; repeated rows are turns of
    their own. Null role or text counts as empty. Rows without a conversation id belong to no conversation. ``heads`` gives
    the conversation whose first turns replace a conversation's own (at most ``longest_head``); None leaves them as they
    are. An empty table has no node, not even a root. Only the four columns are read.
    """
    found = ordered_turns(turns, conv_col, turn_col, role_col, text_col)
    found = cut(found)
    if heads is None:
        rebuilt, lengths = found, found.groupBy("conv").agg(F.max("pos").alias("length"))
    else:
        rebuilt, lengths = rebuild(found, heads, longest_head)
    lengths = cut(lengths)
    nodes, ends = trie_nodes(rebuilt, lengths, block_turns)
    root_conv, n_convs = lengths.agg(F.min("conv"), F.count("*")).first()
    none = F.lit(0).cast("bigint")
    first = lengths.limit(1).select(
        F.lit(root_conv).cast("bigint").alias("conv"), none.alias("depth"), F.lit(n_convs).cast("bigint").alias("n"), none.alias("words"),
        none.alias("da"), none.alias("db"), F.lit(None).cast("bigint").alias("up"),
    )
    columns = ["conv", "depth", "n", "words", "da", "db", "up"]
    parents = nodes.filter("da IS NOT NULL").select((F.col("depth") + 1).alias("depth"), F.col("da").alias("qa"), F.col("db").alias("qb"), F.col("conv").alias("up"))
    linked = (
        nodes.filter("depth = 1").withColumn("up", F.lit(root_conv).cast("bigint")).select(columns)
        .unionByName(nodes.filter("depth > 1 AND qa IS NULL").withColumn("up", F.col("conv")).select(columns))
        .unionByName(nodes.filter("depth > 1 AND qa IS NOT NULL").join(parents, ["depth", "qa", "qb"]).select(columns))
        .unionByName(first)
    )
    linked = cut(linked)
    children = linked.filter("depth > 0").groupBy(F.col("up").alias("conv"), (F.col("depth") - 1).alias("depth")).agg(
        F.count("*").alias("n_children"), F.count_if(F.col("n") == 1).alias("chains")
    )
    counted = cut(
        linked.join(children, ["conv", "depth"], "left").select(*columns, *[F.coalesce(c, none).alias(c) for c in ("n_children", "chains")])
    )
    shared = counted.filter("n > 1 OR depth = 0").select(
        "conv", "depth", "up", (F.col("chains") + F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("leaves"), ((F.col("n") - 1) * F.col("words")).alias("saved")
    )
    sums = subtree_sums(shared, root_conv)
    # conversations that end in one node: most nodes have one at most
    by_end = ends.unionByName(lengths.filter("length = 0").select("conv", none.alias("depth"), none.alias("da"), none.alias("db")))
    by_end = cut(by_end)
    key = ["depth", "da", "db"]
    together = by_end.groupBy(*key).agg(F.count("*").alias("members"), F.min("conv").alias("only"))
    alone = together.filter("members = 1").select(*key, F.sha2(F.col("only").cast("string"), 256).alias("sha"))
    several = by_end.join(together.filter("members > 1").select(*key), key, "left_semi")
    shas = alone.unionByName(joined_ids_sha256(several, key))
    return (
        counted.join(sums, ["conv", "depth"], "left")
        .join(shas, key, "left")
        .select(
            F.col("conv").alias("conv_id"), "depth", F.col("up").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children",
            F.coalesce("leaves", F.lit(1).cast("bigint")).alias("n_leaves"), F.coalesce("saved", none).alias("saved_tokens"),
            F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
        )
    )
