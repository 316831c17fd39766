"""SimHash near duplicates through vantage-point shards.

Fingerprints within ``RADIUS`` bits of each other are linked; components of links are groups of near copies.
Different fingerprints (one row each) are dealt to shards by their Hamming distance to vantage points: inside a
vantage point's median distance m, or outside. By the triangle bound two linked fingerprints differ by at most
``RADIUS`` in that distance, so a fingerprint at m+1 or m+2 goes to both sides, and every linked pair meets in a
shard. Each shard runs the same split on until few fingerprints are left, and compares these.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridpulse.llm.texts import map_texts
from gridpulse.session import cut_lineage, drop_path, scratch_path

RADIUS = 2
SHINGLE = 3
SEED = 42
SHARD = 2048             # fingerprints in a shard, on average, before boundaries are added
HEAVY = 32 * SHARD       # a shard with more is linked by bit flips instead
LEAF = 192               # fingerprints that are compared directly
BLOCK = 1 << 16          # shingles hashed at a time


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """64 bits; bit i is set if it is set in more than half the hashes of the shingles; 0 without words."""
    words = text.encode().lower().split()       # bytes: lowers A-Z only, splits at ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words]).tolist()
    stops = (ends - 1).tolist()
    count = max(1, len(words) - size + 1)
    stops = stops[size - 1:] if len(words) >= size else stops[-1:]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, count, BLOCK):
        hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts[at:at + BLOCK], stops[at:at + BLOCK])),
                             np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: doc_id, ``key`` (a hash of the text, null like empty) and ``fp``, signed 64-bit numbers."""
    def make():
        def work(texts):
            return [np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)]
        return work
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return map_texts(docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(body).alias("key"), body.alias("text")),
                     ["doc_id", "key"], "text", "fp long", make)


# ---- inside a shard ----------------------------------------------------------------------------------------------

def smallest_reachable(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..count-1 and links (a, b): the smallest node each can reach."""
    label = np.arange(count)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while not np.array_equal(hop := label[label], label):
            label = hop
        if np.array_equal(before, label):
            break
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def flip_links(fps: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all fingerprints of ``at`` within two bits: such a pair meets on a key that is one bit away
    from both (or on one of the two). At most 65 fingerprints share a key."""
    flips = np.concatenate([[0], np.uint64(1) << np.arange(64, dtype=np.uint64)]).astype(np.uint64)
    keys = (fps[at][:, None] ^ flips).ravel()
    who = np.repeat(at, 65)
    order = np.argsort(keys, kind="stable")
    keys, who = keys[order], who[order]
    same = keys[1:] == keys[:-1]
    return who[:-1][same], who[1:][same]


def shard_links(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (index pairs) that connect exactly what links of all pairs within ``RADIUS`` bits connect."""
    out_a, out_b, todo = [], [], [np.arange(len(fps))]
    while todo:
        at = todo.pop()
        if len(at) < 2:
            continue
        own = fps[at]
        if len(at) <= LEAF:
            near = np.bitwise_count(own[:, None] ^ own) <= RADIUS
            i, j = np.nonzero(np.triu(near, 1))
            out_a.append(at[i])
            out_b.append(at[j])
            continue
        distance = np.bitwise_count(own ^ own[len(own) // 2]).astype(np.int64)
        middle = int(np.partition(distance, len(at) // 2)[len(at) // 2])
        middle = min(middle, int(distance.max()) - 1)
        inside, outside = at[distance <= middle + RADIUS], at[distance > middle]
        if max(len(inside), len(outside)) > 0.9 * len(at):      # a dense ball: no radius cuts it in two
            a, b = flip_links(fps, at)
            out_a.append(a)
            out_b.append(b)
        else:
            todo += [inside, outside]
    if not out_a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(out_a), np.concatenate(out_b)


def _link_shard(table: pa.Table) -> pa.Table:
    fps = table.column("fp").to_numpy().view(np.uint64)
    ids = table.column("rep").to_numpy()
    order = np.argsort(ids, kind="stable")          # so the smallest index is the smallest id
    fps, ids = fps[order], ids[order]
    label = smallest_reachable(len(fps), *shard_links(fps))
    moved = label != np.arange(len(fps))
    return pa.table({"a": pa.array(ids[moved], pa.int64()), "b": pa.array(ids[label[moved]], pa.int64())})


# ---- across shards -----------------------------------------------------------------------------------------------

def shard_codes(fp: Column, vantage: list[tuple[int, int]]) -> Column:
    """Array of the shards a fingerprint belongs to, given (vantage point, median distance) per level."""
    levels = F.array(*[F.struct(F.lit(v).cast("long").alias("v"), F.lit(m).alias("m")) for v, m in vantage])

    def split(codes: Column, level: Column) -> Column:
        distance = F.bit_count(fp.bitwiseXOR(level["v"]))
        inside = F.transform(codes, lambda c: c * 2)
        outside = F.transform(codes, lambda c: c * 2 + 1)
        return F.when(distance <= level["m"], inside).when(distance > level["m"] + RADIUS, outside).otherwise(
            F.concat(inside, outside))

    start = F.array(F.lit(0).cast("long"))
    return F.aggregate(levels, start, split) if vantage else start


def vantage_points(fps: DataFrame, levels: int) -> list[tuple[int, int]]:
    """One vantage point and median distance per level. They steer balance only: any choice gives the same links."""
    if not levels:
        return []
    points = [r["fp"] for r in fps.orderBy(F.xxhash64("fp")).select("fp").limit(levels).collect()]
    medians = fps.agg(*[F.expr(f"percentile_approx(bit_count(fp ^ {p}L), 0.5)") if p >= 0 else F.percentile_approx(
        F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))), 0.5) for p in points]).first()
    return list(zip(points, map(int, medians)))


def link_fingerprints(fps: DataFrame, shard: int = SHARD, heavy: int = HEAVY) -> DataFrame:
    """Links (a, b), b < a, between the ids ``rep`` of different fingerprints ``fp``, enough to connect all near ones."""
    count = fps.count()
    vantage = vantage_points(fps, max(0, math.ceil(math.log2(max(count, 1) / shard))))
    dealt = fps.select("fp", "rep", F.explode(shard_codes(F.col("fp"), vantage)).alias("shard"))
    dealt = cut_lineage(dealt, "simhash-shards")
    sizes = dealt.groupBy("shard").count()
    light = dealt.join(sizes.where(F.col("count") <= heavy).select("shard"), "shard")
    links = light.groupBy("shard").applyInArrow(_link_shard, "a long, b long")
    # A shard too large for one task is a crowd of near copies around one point, which no vantage point divides.
    # There the key of every single flipped bit brings at most 65 fingerprints together.
    crowded = dealt.join(sizes.where(F.col("count") > heavy).select("shard"), "shard").select("fp", "rep").distinct()
    if not crowded.isEmpty():
        one = F.expr("transform(sequence(0, 63), i -> shiftleft(1L, i))")
        keys = F.concat(F.array(F.col("fp")), F.transform(one, lambda bit: F.col("fp").bitwiseXOR(bit)))
        met = crowded.select("rep", F.explode(keys).alias("key")).groupBy("key").agg(F.collect_set("rep").alias("reps")) \
            .where(F.size("reps") > 1).withColumn("b", F.array_min("reps"))
        star = met.select(F.explode("reps").alias("a"), "b").where("a <> b").distinct()
        links = links.unionByName(star)
    return links


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node it reaches) for every node of the links (a, b).

    Large-star and small-star rounds: each points nodes at the smallest neighbour, so chains halve. Every round is
    written to the shared folder; rounds end when links no longer change. Nothing but two numbers per round comes
    to the driver.
    """
    spark, path, state = links.sparkSession, None, None

    def store(frame: DataFrame) -> DataFrame:
        """Write the new links, then remove the ones they came from."""
        nonlocal path
        old, path = path, scratch_path(spark, "component-links")
        frame.write.parquet(path)
        if old:
            drop_path(spark, old)
        return spark.read.schema("a long, b long").parquet(path)

    edges = store(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now[0] == 0 or tuple(now) == state:
            break
        state = tuple(now)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b") \
            .unionByName(least.select("a", F.col("m").alias("b")))
        edges = store(small.distinct())
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))


def grouped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shard: int = SHARD, heavy: int = HEAVY) -> DataFrame:
    """One row per row: doc_id, key, fp, ``root`` (the smallest fingerprint of its group) and the group's smallest id.

    Fingerprints are what links join, so ids may repeat or be missing.
    """
    prints = cut_lineage(fingerprints(docs, doc_id, text), "simhash")
    each = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    roots = components(link_fingerprints(each.select("fp", F.col("fp").alias("rep")), shard, heavy))
    rooted = each.join(roots, each["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = cut_lineage(rooted, "simhash-rooted")
    names = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints.join(rooted.drop("first").join(names, "root"), "fp")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shard: int = SHARD,
                    heavy: int = HEAVY) -> DataFrame:
    """One row per row: doc_id, fp, component_id (smallest doc_id reachable over links, its own included).

    Exact copies fall together before anything is compared, so a group of any size costs one fingerprint. Texts
    without words (null, empty) share fingerprint 0. Ids are integers; a null id is never a component's id unless
    all ids of the component are null. Repeated rows give repeated rows; an empty table gives an empty one.
    """
    return grouped(docs, doc_id, text, shard, heavy).select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of every group of near copies, the one with the smallest id; all columns of ``docs``, whatever their names.

    Rows without an id come last. Of rows with one id, that of the smallest text hash stays, and of rows that repeat
    both, one of the smallest hash over all columns. Texts of any length are read whole.
    """
    rows = cut_lineage(grouped(docs, doc_id, text).select("doc_id", "key", "root"), "simhash-groups")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    first = rows.groupBy("root").agg(F.min(place).alias("first")).select("first.doc_id", "first.key")
    again = rows.groupBy("doc_id", "key").count().where("count > 1").select("doc_id", "key", F.lit(True).alias("again"))
    first = first.alias("f").join(again.alias("a"), F.expr("f.doc_id <=> a.doc_id AND f.key = a.key"), "left") \
        .select("f.doc_id", "f.key", F.coalesce("again", F.lit(False)).alias("again"))
    first = cut_lineage(first, "simhash-first")
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       F.col(f"`{doc_id}`").cast("long").alias("own_id"), F.xxhash64(body).alias("own_key"))
    kept = held.join(first, F.expr("own_id <=> doc_id AND own_key = key"))
    whole = kept.where("NOT again").select("row")
    if not first.where("again").isEmpty():
        order = F.xxhash64(F.to_json("row"))
        some = kept.where("again").groupBy("own_id", "own_key").agg(F.min_by("row", order).alias("row"))
        whole = whole.unionByName(some.select("row"))
    return whole.select("row.*")
