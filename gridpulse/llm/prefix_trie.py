"""Prefix trie of conversations by SQL ROLLUP over positional turn-id columns.

A conversation lies in rows of ``BLOCK`` turn-id columns. One ROLLUP over these columns counts the conversations of
all prefixes of a block together; ``grouping_id`` tells their lengths. A block that does not begin a conversation is
keyed by the node it continues, so a conversation of any length needs no further round: the key is a digest of the
turns before the block. The nodes, in turn, go through a second ROLLUP over the same columns, which sums every
node's subtree inside its block; what hangs below a block's last column is added to that node first.

A digest is the exclusive or of two 64-bit hashes per (place, turn id): equal for equal prefixes, and running ones
come from totals. Turn ids hold 128 bits of SHA-256 and the length of the text, so texts are read once and stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridpulse.llm.texts import lookup
from gridpulse.session import cut_lineage

BLOCK = 8                # turn-id columns of a block
STRETCH = 4096           # consecutive rows of one conversation that one task orders
CHUNK = 512              # ids that are joined to one text
SLOTS = [f"t{i}" for i in range(BLOCK)]
KEY = ["depth", "d1", "d2"]


def turn_id(role: Column, text: Column) -> Column:
    """16 bytes of the SHA-256 of role and text, then the text's length in UTF-8 bytes as 5 bytes."""
    role, text = (F.coalesce(c.cast("string"), F.lit("")) for c in (role, text))
    both = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.unhex(F.concat(F.substring(F.sha2(both, 256), 1, 32), F.lpad(F.hex(F.octet_length(text).cast("long")), 10, "0")))


def text_bytes(tid: Column) -> Column:
    return F.conv(F.hex(F.substring(tid, 17, 5)), 16, 10).cast("long")


def mark(lane: int, place: Column, tid: Column) -> Column:
    """What a turn adds to a digest; nothing (0) where there is no turn."""
    return F.when(tid.isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(F.lit(lane), place.cast("long"), tid))


def ordered_turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                  text: str = "text") -> DataFrame:
    """conv_id, pos (from 1), tid: every turn with its place in its conversation.

    Turns are ordered by ``turn`` (null first), equal ones by their id. Rows without a conversation id are left out. Rows
    are sorted in ranges of (conv_id, turn), so a conversation that owns a large share of the rows lies in many.
    """
    ids = conversations.where(F.col(f"`{conv_id}`").isNotNull()).select(
        F.col(f"`{conv_id}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").alias("turn"),
        turn_id(F.col(f"`{role}`"), F.col(f"`{text}`")).alias("tid"), F.rand(42).alias("even"))
    ids = cut_lineage(ids, "trie-turns")
    # ``even`` only parts equal rows, whose order does not matter.
    runs = ids.repartitionByRange("conv_id", "turn", "tid", "even").withColumn("run", F.spark_partition_id())
    runs = cut_lineage(runs.drop("even"), "trie-runs")
    sizes = runs.groupBy("conv_id", "run").count()
    lane = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("conv_id", "run", F.coalesce(F.sum("count").over(lane), F.lit(0)).alias("before"))
    inside = Window.partitionBy("conv_id", "run").orderBy("turn", "tid")
    return runs.withColumn("at", F.row_number().over(inside)).join(before, ["conv_id", "run"]).select(
        "conv_id", (F.col("at") + F.col("before")).cast("long").alias("pos"), "tid")


def share_heads(turns: DataFrame, every: int = 5, most: int = 8) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt to begin alike: (conv_id, pos, tid) and the table of all conv_id.

    Conversation c takes the first h turns of conversation c - c % every, then its own turns after its first h, where
    h = crc32(c) % (most + 1).
    """
    c = F.col("conv_id")
    h = (F.crc32(c.cast("string").cast("binary")) % (most + 1)).cast("long")
    convs = turns.groupBy("conv_id").agg(F.max("pos").alias("n"))
    convs = convs.withColumns({"base": c - c % every, "h": h})
    sizes = convs.where(c % every == 0).select(c.alias("base"), F.col("n").alias("n_base"))
    convs = cut_lineage(convs.join(sizes, "base", "left").withColumn(
        "taken", F.least("h", F.coalesce("n_base", F.lit(0)))), "trie-conversations")
    heads = turns.where((F.col("pos") <= most) & (c % every == 0)).withColumnRenamed("conv_id", "base")
    taken = heads.join(convs.where("taken > 0").select("base", "conv_id", "taken"), "base").where("pos <= taken")
    # The own turns of a long conversation meet its numbers in stretches.
    shift = convs.select("conv_id", (F.col("taken") - F.col("h")).alias("shift"),
                         F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"n div {STRETCH}"))).alias("part"))
    own = turns.where(F.col("pos") > h).withColumn("part", F.expr(f"pos div {STRETCH}")).join(shift, ["conv_id", "part"])
    own = own.select("conv_id", (F.col("pos") + F.col("shift")).alias("pos"), "tid")
    return taken.select("conv_id", "pos", "tid").unionByName(own), convs.select("conv_id")


def running(rows: DataFrame, values: Sequence[str], fold, backwards: bool = False) -> DataFrame:
    """``values`` folded over the conversation's rows before (or after) each, by ``block``; null where there are none.

    Block numbers of a conversation have no gaps, so stretches of ``STRETCH`` numbers hold as many rows at most.
    """
    rows = rows.withColumn("part", F.expr(f"block div {STRETCH}"))
    order, later = (F.desc("block"), F.desc("part")) if backwards else (F.asc("block"), F.asc("part"))
    local = Window.partitionBy("conv_id", "part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    lane = Window.partitionBy("conv_id").orderBy(later).rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("conv_id", "part").agg(*[fold(v).alias(v) for v in values])
    parts = parts.select("conv_id", "part", *[fold(v).over(lane).alias(f"p_{v}") for v in values])
    near = rows.withColumns({f"n_{v}": fold(v).over(local) for v in values})
    return near.join(parts, ["conv_id", "part"]).drop("part")


def turn_blocks(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per conversation and block: conv_id, block, t0.. (null beyond the end), k1 and k2, the digest before it.

    Every conversation has a block 0, also one without turns.
    """
    none = convs.select("conv_id", F.lit(0).cast("long").alias("block"), F.lit(None).cast("struct<slot:bigint,tid:binary>").alias("t"))
    place = F.col("pos") - 1
    laid = turns.select("conv_id", F.expr(f"(pos - 1) div {BLOCK}").alias("block"),
                        F.struct((place % BLOCK).alias("slot"), "tid").alias("t"))
    wide = laid.unionByName(none).groupBy("conv_id", "block").agg(F.array_sort(F.collect_list("t")).alias("t"))
    wide = wide.select("conv_id", "block", *[F.get("t", F.lit(i))["tid"].alias(c) for i, c in enumerate(SLOTS)])
    rows = wide.withColumns({f"x{lane}": digest(lane, F.lit(0).cast("long"), SLOTS) for lane in (1, 2)})
    before = running(rows, ["x1", "x2"], F.bit_xor)
    return before.select("conv_id", "block", *SLOTS, *[
        F.coalesce(f"n_x{i}", F.lit(0)).bitwiseXOR(F.coalesce(f"p_x{i}", F.lit(0))).alias(f"k{i}") for i in (1, 2)])


def digest(lane: int, start: Column, slots: Sequence[str]) -> Column:
    for i, c in enumerate(slots):
        start = start.bitwiseXOR(mark(lane, F.col("block") * BLOCK + (i + 1), F.col(c)))
    return start


def rollup(rows: DataFrame, sums: str) -> DataFrame:
    """``sums`` (SQL) for every prefix of every block, with depth and digest; the block's own start only for the root."""
    slots = ", ".join(SLOTS)
    made = rows.sparkSession.sql(
        f"SELECT block, k1, k2, {slots}, {BLOCK} - bit_count(grouping_id()) AS level, {sums} FROM {{rows}} "
        f"GROUP BY block, k1, k2, ROLLUP ({slots})", rows=rows)
    last = F.get(F.array(*SLOTS), F.col("level") - 1)
    made = made.withColumn("last", F.when(F.col("level") > 0, last))
    # A conversation that ends before the level has no turn there.
    made = made.where(F.col("last").isNotNull() | ((F.col("level") == 0) & (F.col("block") == 0)))
    return made.withColumns({"depth": F.col("block") * BLOCK + F.col("level"),
                             **{f"d{i}": digest(i, F.col(f"k{i}"), SLOTS) for i in (1, 2)}})


def id_lists(ends: DataFrame) -> DataFrame:
    """depth, d1, d2 and ends_sha256: the SHA-256 of each node's ids in ascending order, comma-joined.

    Ids are sorted over all tasks and joined to texts of ``CHUNK`` ids; a node's texts are then hashed one after
    another, so a node that half of the conversations end at needs no more memory than any other.
    """
    wire = pa.schema([("depth", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
    out = pa.schema([("depth", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("ends_sha256", pa.string())])

    def join(batches):
        key, held = None, []
        for batch in batches:
            rows = []
            for *node, number in zip(*(c.to_pylist() for c in batch.columns)):
                if node != key or len(held) == CHUNK:
                    if held:
                        rows.append((*key, held[0], ",".join(map(str, held))))
                    key, held = node, []
                held.append(number)
            if rows:
                yield pa.record_batch(list(map(list, zip(*rows))), schema=wire)
        if held:
            yield pa.record_batch([[v] for v in (*key, held[0], ",".join(map(str, held)))], schema=wire)

    def hash_(batches):
        key, state = None, None
        for batch in batches:
            rows = []
            for *node, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if node == key:
                    state.update(b",")
                else:
                    if key:
                        rows.append((*key, state.hexdigest()))
                    key, state = node, hashlib.sha256()
                state.update(ids.encode())
            if rows:
                yield pa.record_batch(list(map(list, zip(*rows))), schema=out)
        if key:
            yield pa.record_batch([[v] for v in (*key, state.hexdigest())], schema=out)

    texts = ends.select(*KEY, "conv_id").repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id").mapInArrow(
        join, "depth long, d1 long, d2 long, first long, ids string")
    return texts.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(
        hash_, "depth long, d1 long, d2 long, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The trie's nodes: every different sequence of first d turns, from the root (d = 0, without a text).

    ``turns`` has conv_id, pos (1, 2, ... without gaps) and tid (``turn_id``); ``convs`` has every conv_id once,
    those without turns too. Members of a node are the conversations that begin with it. Per node: conv_id (smallest
    member), depth, parent_conv_id (the parent's conv_id, null for the root), n_convs (members), n_children,
    n_leaves (childless nodes in its subtree), saved_tokens (over its subtree, (n_convs - 1) times the UTF-8 bytes of the
    last text), ends_sha256 (ids of the members that end there). No conversations give no nodes.
    """
    turns = cut_lineage(turns.select("conv_id", "pos", "tid"), "trie-places")
    blocks = cut_lineage(turn_blocks(turns, convs), "trie-blocks")
    nodes = rollup(blocks, "min(conv_id) AS conv_id, count(*) AS n_convs")
    nodes = cut_lineage(nodes.select(
        "block", "k1", "k2", *SLOTS, *KEY, "conv_id", "n_convs",
        ((F.col("n_convs") - 1) * F.coalesce(text_bytes(F.col("last")), F.lit(0))).alias("saved"),
        *[F.col(f"d{i}").bitwiseXOR(mark(i, F.col("depth"), F.col("last"))).alias(f"u{i}") for i in (1, 2)]), "trie-nodes")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("u1").alias("d1"),
                                                F.col("u2").alias("d2")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = cut_lineage(nodes.withColumn("leaf", (F.col("n_children") == 0).cast("long")), "trie-counted")

    # Subtrees of later blocks: a block's nodes count once, at the smallest conversation that goes through it, and
    # reach all earlier ends of blocks of that conversation.
    held = nodes.where("block > 0").groupBy("block", "k1", "k2").agg(
        F.min("conv_id").alias("conv_id"), F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf"))
    later = blocks.where("block > 0").select("conv_id", "block", "k1", "k2").join(
        held.select("conv_id", "block", "saved", "leaf"), ["conv_id", "block"], "left")
    later = running(later, ["saved", "leaf"], F.sum, backwards=True)
    total = {v: sum((F.coalesce(c, F.lit(0)) for c in (v, f"n_{v}", f"p_{v}")), F.lit(0)) for v in ("saved", "leaf")}
    below = later.groupBy((F.col("block") * BLOCK).alias("depth"), F.col("k1").alias("d1"), F.col("k2").alias("d2")).agg(
        *[F.sum(t).alias(f"more_{v}") for v, t in total.items()])
    weighed = nodes.join(below, KEY, "left").withColumns(
        {v: F.col(v) + F.coalesce(f"more_{v}", F.lit(0)) for v in ("saved", "leaf")})
    sums = rollup(weighed.select("block", "k1", "k2", *SLOTS, "saved", "leaf"),
                  "sum(saved) AS saved_tokens, sum(leaf) AS n_leaves").select(*KEY, "saved_tokens", "n_leaves")

    ends = turns.select("conv_id", "pos", *[mark(i, F.col("pos"), F.col("tid")).alias(f"m{i}") for i in (1, 2)]).unionByName(
        convs.select("conv_id", *[F.lit(0).cast("long").alias(c) for c in ("pos", "m1", "m2")]))
    ends = ends.groupBy("conv_id").agg(F.max("pos").alias("depth"), F.bit_xor("m1").alias("d1"), F.bit_xor("m2").alias("d2"))

    parents = nodes.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("d1").alias("u1"), F.col("d2").alias("u2"),
                                                   F.col("conv_id").alias("parent_conv_id"), "n_children")
    found = lookup(nodes.drop("saved", "leaf", "block", "k1", "k2", *SLOTS), parents, ["depth", "u1", "u2"],
                   "parent_conv_id", "n_children")
    found = found.join(sums, KEY).join(id_lists(ends), KEY, "left")
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
