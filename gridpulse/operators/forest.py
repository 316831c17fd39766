"""Random forest of class probabilities, grown where the rows of its nodes lie.

Every tree sees all rows, each as often as a Poisson draw says (bootstrap). Rows are kept as blocks of binned features.
Up to ``HELD_BYTES`` of blocks a task reads them all and grows some of the trees. Beyond that a node of more than ``LOCAL_ROWS``
draws is split by a histogram summed over all blocks; the rows of a smaller one go to one task, which grows the rest of its
tree level by level. So a draw is sent once, however deep its tree is, and no task holds more than one such node. Both ways
run the same steps and give the same trees.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs, parquet
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridpulse.session import long_tasks, open_store, scratch_path

BINS = 32
HELD_BYTES = 1 << 26         # blocks that a task takes as a whole
LOCAL_ROWS = 1 << 21         # draws of a node that one task takes over
BEST_NODES = 1 << 10         # nodes whose splits are compared at a time
PASS_NODES = 1 << 14         # nodes whose histograms are summed in one pass
LEAST_GAIN = 1e-12

PARTS = "tree int, node int, feature array<int>, cut array<double>, left array<int>, zero array<double>, one array<double>"
BLOCKS = "block long, data binary"
NODES = "tree int, feature array<int>, cut array<double>, left array<int>, share array<double>"


@dataclass
class ForestSettings:
    trees: int = 200
    depth: int = 15
    min_leaf: int = 3
    seed: int = 42


# -- nodes of one tree --------------------------------------------------------------------------

class _Tree:
    """Nodes as arrays: feature (-1: none), bin (left up to it), left child (the right one follows), draws and weight per class."""

    def __init__(self, draws: np.ndarray, weight: np.ndarray):
        self.feature, self.bin, self.left = np.array([-1]), np.array([0]), np.array([-1])
        self.draws, self.weight, self.depth = draws.reshape(1, 2), weight.reshape(1, 2), np.array([0])

    def split(self, ids, feature, cut, draws, weight) -> np.ndarray:
        """Split the nodes ``ids``; stats are (node, side, class). Returns the children's ids, two per node."""
        kids = len(self.feature) + np.arange(2 * len(ids))
        self.feature[ids], self.bin[ids], self.left[ids] = feature, cut, kids[::2]
        none = np.full(len(kids), -1)
        self.feature, self.left = np.append(self.feature, none), np.append(self.left, none)
        self.bin = np.append(self.bin, np.zeros(len(kids), dtype=int))
        self.draws = np.concatenate([self.draws, draws.reshape(-1, 2)])
        self.weight = np.concatenate([self.weight, weight.reshape(-1, 2)])
        self.depth = np.append(self.depth, np.repeat(self.depth[ids] + 1, 2))
        return kids

    def open(self, ids: np.ndarray, s: ForestSettings) -> np.ndarray:
        """Which of the nodes may be split: both classes in them, above the depth limit."""
        return (self.draws[ids].min(axis=1) > 0) & (self.depth[ids] < s.depth)

    def place(self, bins: np.ndarray) -> np.ndarray:
        """The node each row ends in."""
        at = np.zeros(len(bins), dtype=int)
        while len(moving := np.flatnonzero(self.feature[at] >= 0)):
            node = at[moving]
            at[moving] = self.left[node] + (bins[moving, self.feature[node]] > self.bin[node])
        return at


def _subsets(rng: np.random.Generator, nodes: int, width: int) -> np.ndarray:
    """The features each node may use: the root of their number, rounded up."""
    return rng.random((nodes, width)).argsort(axis=1)[:, :int(np.ceil(np.sqrt(width)))]


class _Drawn:
    """Rows of a bootstrap as columns."""

    def __init__(self, rows: np.ndarray):
        self.width = rows["bins"].shape[1]
        self.bins, self.y = np.ascontiguousarray(rows["bins"]).ravel(), rows["y"].astype(np.int64)
        self.draws = rows["n"].astype(float)
        self.weight = self.draws * rows["w"]

    def bin(self, row: np.ndarray, feature: np.ndarray) -> np.ndarray:
        return self.bins.take(row * self.width + feature)

    def histograms(self, row: np.ndarray, at: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        """Draws and weights as (what, class, node, chosen feature, bin) of the rows ``row`` at the places ``at``."""
        nodes, wide = chosen.shape
        out = np.empty((2, 2, nodes, wide, BINS))
        start, first = (self.y.take(row) * nodes + at) * BINS, row * self.width
        values = self.draws.take(row), self.weight.take(row)
        for j, features in enumerate(chosen.T):
            cell = start + self.bins.take(first + features.take(at))
            for what, v in enumerate(values):
                out[what, :, :, j] = np.bincount(cell, v, 2 * nodes * BINS).reshape(2, nodes, BINS)
        return out


def _best(hist: np.ndarray, chosen: np.ndarray, min_leaf: int):
    """Best split per node by Gini gain, some nodes at a time: a level has thousands of them, and the rest of a task's memory holds rows."""
    parts = [_best_of(hist[:, :, i:i + BEST_NODES], chosen[i:i + BEST_NODES], min_leaf) for i in range(0, len(chosen), BEST_NODES)]
    return [np.concatenate(column) for column in zip(*parts)]


def _best_of(hist: np.ndarray, chosen: np.ndarray, min_leaf: int):
    """Best split per node by Gini gain: (found, feature, bin, draws, weight), the last two as (node, side, class)."""
    below = hist.cumsum(axis=-1)
    left, right = below[..., :-1], below[..., -1:] - below[..., :-1]
    # What is left of a class without draws is rounding.
    lw, rw = (np.where(side[0] > 0, side[1], 0.0) for side in (left, right))
    valid = (left[0, 0] + left[0, 1] >= min_leaf) & (right[0, 0] + right[0, 1] >= min_leaf)
    with np.errstate(divide="ignore", invalid="ignore"):
        score = sum((zero * zero + one * one) / (zero + one) for zero, one in (lw, rw))
        zero, one = below[1, :, :, 0, -1]
        flat = np.where(valid & ~np.isnan(score), score, -np.inf).reshape(len(chosen), -1)
        at = flat.argmax(axis=1)
        node = np.arange(len(chosen))
        gain = (flat[node, at] - (zero * zero + one * one) / (zero + one)) / (zero + one)
    slot, cut = at // (BINS - 1), at % (BINS - 1)
    draws = np.stack([left[0][:, node, slot, cut].T, right[0][:, node, slot, cut].T], axis=1)
    weight = np.stack([lw[:, node, slot, cut].T, rw[:, node, slot, cut].T], axis=1)
    return gain > LEAST_GAIN, chosen[node, slot], cut, draws, weight


def _grow(rows: np.ndarray, depth: int, s: ForestSettings, rng: np.random.Generator) -> _Tree:
    """The tree below a node at ``depth``, all nodes of a level at once."""
    own = _Drawn(rows)
    tree = _Tree(*(np.bincount(own.y, v, 2) for v in (own.draws, own.weight)))
    tree.depth[0] = depth
    ids = np.flatnonzero(tree.open(np.array([0]), s))
    row, at = np.arange(len(rows)), np.zeros(len(rows), dtype=int)
    while len(ids):
        chosen = _subsets(rng, len(ids), own.width)
        found, feature, cut, draws, weight = _best(own.histograms(row, at, chosen), chosen, s.min_leaf)
        kids = tree.split(ids[found], feature[found], cut[found], draws[found], weight[found])
        alive = tree.open(kids, s)
        going = found[at]
        row, at = row[going], at[going]
        kid = 2 * (np.cumsum(found) - 1)[at] + (own.bin(row, feature[at]) > cut[at])
        going = alive[kid]
        row, at = row[going], (np.cumsum(alive) - 1)[kid[going]]
        ids = kids[alive]
    return tree


# -- rows as blocks -----------------------------------------------------------------------------

def _cuts(rows: DataFrame, width: int) -> list[np.ndarray]:
    """Per feature up to ``BINS - 1`` cuts: between all values where they are few, else quantiles of all rows."""
    x = [F.get("x", F.lit(i)) for i in range(width)]
    shares = [i / BINS for i in range(1, BINS)]
    row = rows.agg(*[F.struct(F.approx_count_distinct(c).alias("n"), F.percentile_approx(c, shares).alias("q")).alias(f"f{i}")
                     for i, c in enumerate(x)]).first()
    few = [i for i in range(width) if row[i].n <= 2 * BINS]
    sets = rows.agg(F.lit(0), *[F.array_sort(F.collect_set(x[i])).alias(f"f{i}") for i in few]).first()
    cuts = [np.unique(np.array(r.q or [], dtype=float)) for r in row]
    for i in few:
        values = np.array(sets[f"f{i}"], dtype=float)
        if len(values) <= BINS:
            cuts[i] = (values[1:] + values[:-1]) / 2
    return cuts


def _dtype(width: int) -> np.dtype:
    return np.dtype([("bins", "u1", (width,)), ("y", "u1"), ("n", "u1"), ("w", "f8")])


def _blocks(rows: DataFrame, cuts: list[np.ndarray]) -> str:
    """Folder of binned rows, one stored row per Arrow batch with a number of its own."""
    kind = _dtype(len(cuts))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for i, batch in enumerate(batches):
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(cuts))
            out = np.zeros(len(x), dtype=kind)
            for j, c in enumerate(cuts):
                out["bins"][:, j] = np.searchsorted(c, x[:, j])
            out["y"], out["w"], out["n"] = batch.column("y").to_numpy(), batch.column("w").to_numpy(), 1
            yield pa.RecordBatch.from_pydict({"block": pa.array([first + i], pa.int64()), "data": pa.array([out.tobytes()], pa.binary())})

    folder = scratch_path(rows.sparkSession, "blocks")
    rows.mapInArrow(pack, BLOCKS).write.parquet(folder)
    return folder


def _drawn(rows: np.ndarray, seed: int, block: int, tree: int) -> np.ndarray:
    """The block's bootstrap rows for a tree, with how often each is drawn."""
    times = np.random.default_rng([seed, block, tree]).poisson(1.0, len(rows))
    out = rows[times > 0]
    out["n"] = times[times > 0]
    return out


# -- fitting ------------------------------------------------------------------------------------

def fit_forest(train: DataFrame, vector: str, label: str, weight: str, settings: ForestSettings | None = None) -> Forest:
    """``label`` holds 0 and 1; ``vector`` the features of a row, ``weight`` its weight."""
    s = settings or ForestSettings()
    rows = train.select(vector_to_array(vector).alias("x"), F.col(label).cast("int").alias("y"), F.col(weight).cast("double").alias("w"))
    first = rows.select(F.size("x").alias("n")).first()
    if first is None:
        raise ValueError("no training rows")
    cuts = _cuts(rows, first.n)
    spark, stored, kind = train.sparkSession, _blocks(rows, cuts), _dtype(len(cuts))
    known = _known(rows.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w")).collect())
    whole, folder = _arrow(spark, NODES), scratch_path(spark, "forest")
    if known[0].sum() * kind.itemsize <= HELD_BYTES:
        def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = None
            for batch in batches:
                for number in batch.column("id").to_pylist():
                    held = _held(stored, kind) if held is None else held
                    yield from pa.Table.from_pylist([_joined(_whole_tree(held, known, number, cuts, s))], schema=whole).to_batches()

        with long_tasks(spark) as tasks:
            spark.range(0, s.trees, 1, min(s.trees, tasks)).mapInArrow(grow, NODES).write.parquet(folder)
        return Forest(folder, s)
    blocks = spark.read.schema(BLOCKS).parquet(stored)
    tops = _grow_tops(blocks, kind, known, s)

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(*(batch.column(c).to_pylist() for c in ("block", "data"))):
                held, out = np.frombuffer(data, dtype=kind), []
                for number, top in enumerate(tops):
                    own = _drawn(held, s.seed, block, number)
                    at = top.place(own["bins"])
                    out += [(number, int(node), block, part.tobytes()) for node in _open_leaves(top, s) if len(part := own[at == node])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, (pa.int32(), pa.int32(), pa.int64(), pa.binary()))],
                    names=["tree", "node", "block", "data"])

    def below(table: pa.Table) -> pa.Table:
        number, node = table.column("tree")[0].as_py(), table.column("node")[0].as_py()
        data = b"".join(d for _, d in sorted(zip(*(table.column(c).to_pylist() for c in ("block", "data")))))
        tree = _grow(np.frombuffer(data, dtype=kind), int(tops[number].depth[node]), s, np.random.default_rng([s.seed, number, node, 1]))
        return pa.Table.from_pylist([_part(number, node, tree, cuts)], schema=wire)

    def join(table: pa.Table) -> pa.Table:
        return pa.Table.from_pylist([_joined(sorted(table.to_pylist(), key=lambda p: p["node"]))], schema=whole)

    wire = _arrow(spark, PARTS)
    parts = blocks.mapInArrow(scatter, "tree int, node int, block long, data binary").groupBy("tree", "node").applyInArrow(below, PARTS)
    upper = spark.createDataFrame([_part(i, -1, top, cuts) for i, top in enumerate(tops)], PARTS)
    parts.unionByName(upper).groupBy("tree").applyInArrow(join, NODES).write.parquet(folder)
    return Forest(folder, s)


def _arrow(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(spark.createDataFrame([], schema).schema)


def _known(classes: Sequence) -> np.ndarray:
    """Rows and weight per class: what a root is expected to draw. Its own draws are summed only where it is split."""
    counts = {r.y: (r.n, r.w) for r in classes}
    if set(counts) - {0, 1}:
        raise ValueError("labels must be 0 or 1")
    return np.array([counts.get(y, (0, 0.0)) for y in (0, 1)], dtype=float).T


def _open_leaves(top: _Tree, s: ForestSettings) -> np.ndarray:
    """Leaves of the upper part of a tree that may be split."""
    return np.flatnonzero((top.left < 0) & top.open(np.arange(len(top.left)), s))


def _large(top: _Tree, s: ForestSettings) -> list[int]:
    """Those of more than ``LOCAL_ROWS`` draws; one that was found to have no split is at the depth limit."""
    leaves = _open_leaves(top, s)
    return leaves[top.draws[leaves].sum(axis=1) > LOCAL_ROWS].tolist()


def _split_large(tops: Sequence[_Tree], found: list[tuple[int, int]], sums: np.ndarray, chosen: np.ndarray, s: ForestSettings) -> None:
    """Split the nodes ``found`` (place of the tree, node) by their sums."""
    best = _best(sums, chosen, s.min_leaf)
    for i, (t, n) in enumerate(found):
        if best[0][i]:
            tops[t].split(np.array([n]), *(b[i:i + 1] for b in best[1:]))
        else:
            tops[t].depth[n] = s.depth           # stays a leaf


def _chosen(found: list[tuple[int, int]], width: int, s: ForestSettings) -> np.ndarray:
    return np.concatenate([_subsets(np.random.default_rng([s.seed, t, n, 0]), 1, width) for t, n in found])


def _held(folder: str, kind: np.dtype) -> list[tuple[int, np.ndarray]]:
    """All blocks of a folder by their number, in the memory of one task."""
    store, root = open_store(folder)
    files = [f.path for f in store.get_file_info(fs.FileSelector(root)) if f.path.endswith(".parquet")]
    rows = [r for f in files for r in parquet.read_table(f, filesystem=store).to_pylist()]
    return [(r["block"], np.frombuffer(r["data"], dtype=kind)) for r in sorted(rows, key=lambda r: r["block"])]


def _whole_tree(held: list[tuple[int, np.ndarray]], known: np.ndarray, number: int, cuts: list[np.ndarray], s: ForestSettings) -> list[dict]:
    """A tree's upper part and what grows below it."""
    own = np.concatenate([_drawn(rows, s.seed, block, number) for block, rows in held])
    top, drawn = _Tree(known[0].copy(), known[1].copy()), None
    while nodes := _large(top, s):
        drawn = drawn or _Drawn(own)
        found, here = [(number, n) for n in nodes], np.full(len(top.left), -1)
        here[nodes] = np.arange(len(nodes))
        at = here[top.place(own["bins"])]
        row = np.flatnonzero(at >= 0)
        chosen = _chosen(found, drawn.width, s)
        _split_large([top], [(0, n) for n in nodes], drawn.histograms(row, at[row], chosen), chosen, s)
    at, parts = top.place(own["bins"]), [_part(number, -1, top, cuts)]
    for node in _open_leaves(top, s).tolist():
        if len(rows := own[at == node]):
            tree = _grow(rows, int(top.depth[node]), s, np.random.default_rng([s.seed, number, node, 1]))
            parts.append(_part(number, node, tree, cuts))
    return parts


def _grow_tops(blocks: DataFrame, kind: np.dtype, known: np.ndarray, s: ForestSettings) -> list[_Tree]:
    """The upper nodes of all trees, down to nodes of at most ``LOCAL_ROWS`` draws."""
    tops = [_Tree(known[0].copy(), known[1].copy()) for _ in range(s.trees)]
    while found := [(t, n) for t, top in enumerate(tops) for n in _large(top, s)][:PASS_NODES]:
        chosen = _chosen(found, kind["bins"].shape[0], s)
        _split_large(tops, found, _summed(blocks, kind, tops, found, chosen, s), chosen, s)
    return tops


def _summed(blocks: DataFrame, kind: np.dtype, tops: list[_Tree], found: list[tuple[int, int]], chosen: np.ndarray,
            s: ForestSettings) -> np.ndarray:
    """Histograms of the nodes ``found`` over all blocks."""
    wanted: dict[int, dict[int, int]] = {}
    for i, (t, n) in enumerate(found):
        wanted.setdefault(t, {})[n] = i
    shape = (2, 2, len(found), chosen.shape[1], BINS)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            for block, data in zip(batch["block"], batch["data"]):
                held = np.frombuffer(data, dtype=kind)
                total = np.zeros(shape) if total is None else total
                for t, nodes in wanted.items():
                    own = _drawn(held, s.seed, block, t)
                    here = np.full(len(tops[t].left), -1)
                    here[list(nodes)] = np.arange(len(nodes))
                    at = here[tops[t].place(own["bins"])]
                    row, slots = np.flatnonzero(at >= 0), list(nodes.values())
                    total[:, :, slots] += _Drawn(own).histograms(row, at[row], chosen[slots])
        for i in range(len(found) if total is not None else 0):
            if total[0, :, i].any():
                yield pd.DataFrame({"i": [i], "h": [total[:, :, i].ravel()]})

    sums = blocks.mapInPandas(partial, "i int, h array<double>").select("i", array_to_vector("h").alias("v")).groupBy("i").agg(
        Summarizer.sum(F.col("v")).alias("v")).select("i", vector_to_array("v").alias("v"))
    out = np.zeros(shape)
    for r in sums.toLocalIterator():
        out[:, :, r.i] = np.array(r.v).reshape(2, 2, *shape[3:])
    return out


def _part(number: int, node: int, tree: _Tree, cuts: list[np.ndarray]) -> dict:
    cut = [float(cuts[f][b]) if f >= 0 else 0.0 for f, b in zip(tree.feature, tree.bin)]
    return {"tree": number, "node": node, "feature": tree.feature.tolist(), "cut": cut, "left": tree.left.tolist(),
            "zero": tree.weight[:, 0].tolist(), "one": tree.weight[:, 1].tolist()}


def _joined(parts: list[dict]) -> dict:
    """One tree of its upper part (first) and what grew below; leaves of one parent that predict the same class are merged."""
    top, names = parts[0], ("feature", "cut", "left", "zero", "one")
    whole = {n: [np.array(top[n])] for n in names}
    feature, cut, left, zero, one = (whole[n][0] for n in names)
    size = len(feature)
    for p in parts[1:]:
        # The part's root takes the place of the upper node; its other nodes follow at the end.
        moved = {n: np.array(p[n]) for n in names}
        moved["left"] = np.where(moved["left"] >= 0, moved["left"] + size - 1, -1)
        for n in names:
            whole[n][0][p["node"]] = moved[n][0]
            whole[n].append(moved[n][1:])
        size += len(moved["left"]) - 1
    feature, cut, left, zero, one = (np.concatenate(whole[n]) for n in names)
    says = one > zero
    while True:
        inner = np.flatnonzero(left >= 0)
        a = left[inner]
        same = (left[a] < 0) & (left[a + 1] < 0) & (says[a] == says[a + 1])
        if not same.any():
            break
        # As in MLlib, a merged node predicts as its own rows do.
        feature[inner[same]], left[inner[same]] = -1, -1
    share = one / np.maximum(zero + one, 1e-300)
    return {"tree": top["tree"], "feature": feature.tolist(), "cut": cut.tolist(), "left": left.tolist(), "share": share.tolist()}


# -- the model ----------------------------------------------------------------------------------

@dataclass
class Forest:
    """Trees as a table in shared storage, one row each; tasks read it from there."""

    folder: str
    settings: ForestSettings

    def probability(self, df: DataFrame, vector: str, name: str) -> DataFrame:
        """Adds the mean share of class 1 in the leaves a row ends in."""
        folder = self.folder

        @F.pandas_udf(T.DoubleType())
        def score(batch: pd.Series) -> pd.Series:
            x = np.array(batch.tolist(), dtype=float).reshape(len(batch), -1)
            trees = _trees(folder)
            return pd.Series(leaf_sums(trees, x) / len(trees))

        return df.withColumn(name, score(vector_to_array(vector)))

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        spark.read.schema(NODES).parquet(self.folder).write.mode("overwrite").parquet(f"{path}/nodes")
        spark.createDataFrame([(json.dumps(asdict(self.settings)),)], "settings string").coalesce(1).write.mode("overwrite").text(f"{path}/settings")

    @classmethod
    def load(cls, path: str) -> Forest:
        settings = json.loads(SparkSession.active().read.text(f"{path}/settings").first().value)
        return cls(f"{path}/nodes", ForestSettings(**settings))


def leaf_sums(trees: list[tuple[np.ndarray, ...]], x: np.ndarray) -> np.ndarray:
    """Per row the sum of what the leaves it ends in hold."""
    total = np.zeros(len(x))
    for feature, cut, left, share in trees:
        at, moving = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
        while len(moving := moving[left[at[moving]] >= 0]):
            node = at[moving]
            at[moving] = left[node] + (x[moving, feature[node]] > cut[node])
        total += share[at]
    return total


def read_trees(folder: str) -> list[tuple[np.ndarray, ...]]:
    store, root = open_store(folder)
    files = sorted(f.path for f in store.get_file_info(fs.FileSelector(root)) if f.path.endswith(".parquet"))
    rows = pa.concat_tables([parquet.read_table(f, filesystem=store) for f in files]).sort_by("tree")
    kinds = {"feature": np.int16, "cut": np.float64, "left": np.int32, "share": np.float64}
    return [tuple(rows.column(c)[i].values.to_numpy(zero_copy_only=False).astype(k) for c, k in kinds.items()) for i in range(len(rows))]


@lru_cache(maxsize=2)
def _trees(folder: str) -> list[tuple[np.ndarray, ...]]:
    return read_trees(folder)
