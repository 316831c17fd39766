"""Gradient boosting: several ensembles over the same rows, grown side by side.

Boosting is a long chain of short passes over the rows, kept as blocks of binned features. Up to ``LOCAL_ROWS`` rows one
task grows an ensemble on its own. Beyond that the rows stay spread, with one margin per ensemble, and all ensembles share
the passes: one a level sums the histograms of every ensemble that still learns, the driver picks the splits, and what a
task returns depends on nodes, features and bins, not on rows. Both ways run the same steps and give the same trees. Of two
children only the smaller is summed, the other is what its parent has left. Several features are summed as one: their bins
together are a code, and the sums of the codes hold those of each feature. Loss, weights of trees, early stopping and the
rules of a split are those of MLlib's ``GBTClassifier`` and ``GBTRegressor``; ``fit_as_mllib`` makes models of MLlib.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, replace
from functools import lru_cache, partial, reduce
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs, parquet
from pyspark import RDD, StorageLevel, TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridpulse.operators.forest import BINS, LEAST_GAIN, NODES, _cuts, leaf_sums, read_trees
from gridpulse.session import drop_path, long_tasks, open_store, scratch_path

if TYPE_CHECKING:
    from gridpulse.operators.models import BoostSettings

LOCAL_ROWS = 3 << 20     # rows of an ensemble that one task takes over
PACKED = 1 << 10         # codes of features that are summed together
JOINED_ROWS = 1 << 17    # rows of blocks that are worked on as one
TIE = 1e-9               # scores that differ by no more are equal
STORE_EVERY = 10         # rounds between two stored states
COLLECTED = 32           # partitions whose sums the driver adds itself; more are added by tasks first
KEPT = StorageLevel.MEMORY_AND_DISK
BLOCKS = "block long, data binary"


@dataclass
class BoostFit:
    """One ensemble: its settings, the number of its weight column, the fold it does not see and its loss (log, squared, absolute)."""

    settings: BoostSettings
    weight: int
    without: int = -1
    loss: str = "log"


# -- rows as blocks -----------------------------------------------------------------------------

@dataclass
class _Block:
    """Rows of a task: ``bins`` is (feature, row), ``weights`` (column, row), ``margins`` (ensemble, row).

    ``pieces`` are number and rows of the stored blocks it is made of, ``codes`` (pack, row) the bins of a pack's features.
    """

    pieces: list[tuple[int, int]]
    bins: np.ndarray
    codes: np.ndarray
    label: np.ndarray         # class as -1 or 1, or the target
    fold: np.ndarray
    held_out: np.ndarray      # rows that only decide when to stop
    weights: np.ndarray
    margins: np.ndarray

    def drawn(self, fit: BoostFit, tree: int, draws: dict) -> np.ndarray:
        """Places of the rows a tree of the ensemble is grown on."""
        s = fit.settings
        used = ~self.held_out & (self.fold != fit.without)
        if s.subsample < 1.0:
            key = (s.seed, s.subsample)
            if key not in draws:
                draws[key] = np.concatenate([np.random.default_rng([s.seed, number, tree]).random(n) < s.subsample for number, n in self.pieces])
            used = used & draws[key]
        return np.flatnonzero(used)

    def residuals(self, fit: BoostFit, k: int, rows: np.ndarray, tree: int) -> np.ndarray:
        """What the next tree learns: the labels first, then the negative gradient of the loss."""
        label = self.label[rows]
        if tree == 0:
            return label.astype(np.float64)
        margin = self.margins[k, rows]
        if fit.loss == "squared":
            return 2.0 * (label - margin)
        if fit.loss == "absolute":
            return np.where(label - margin < 0, -1.0, 1.0)
        with np.errstate(over="ignore"):
            return 4.0 * label / (1.0 + np.exp(2.0 * label * margin))

    def losses(self, fit: BoostFit, k: int, rows: np.ndarray) -> np.ndarray:
        label, margin = self.label[rows], self.margins[k, rows].astype(np.float64)
        if fit.loss == "squared":
            return (label - margin) ** 2
        if fit.loss == "absolute":
            return np.abs(label - margin)
        return 2.0 * np.logaddexp(0.0, -2.0 * label * margin)


@dataclass
class _Packs:
    """Features that are summed together: as (feature, bins, codes below) each. Features with one bin are in none."""

    groups: list[list[tuple[int, int, int]]]
    width: int
    margins: str = "f4"       # type of the blocks' margins

    @classmethod
    def of(cls, cuts: list[np.ndarray], margins: str = "f4") -> _Packs:
        groups: list[list[tuple[int, int, int]]] = []
        for feature in sorted((j for j, c in enumerate(cuts) if len(c)), key=lambda j: -len(cuts[j])):
            bins = len(cuts[feature]) + 1
            for group in groups:
                below = group[-1][1] * group[-1][2]
                if below * bins <= PACKED:
                    group.append((feature, bins, below))
                    break
            else:
                groups.append([(feature, bins, 1)])
        return cls(groups, len(cuts), margins)

    def codes(self, bins: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.groups), bins.shape[1]), dtype=np.uint16)
        for code, group in zip(out, self.groups):
            for feature, _, below in group:
                code += bins[feature].astype(np.uint16) * np.uint16(below)
        return out

    def sums(self, b: _Block, rows: np.ndarray, at: np.ndarray, nodes: int, weight: np.ndarray, moved: np.ndarray) -> np.ndarray:
        """Of the rows, which are at the places ``at``: how many they are, weights and weighted residuals as (node, what, feature, bin)."""
        out = np.zeros((nodes, 3, self.width, BINS))
        # Where weights have two values (those of the classes), counting the rows of both is enough.
        low, high = (weight.min(), weight.max()) if len(weight) else (1.0, 1.0)
        heavy = weight == high
        two = bool((heavy | (weight == low)).all())
        whole = np.stack([np.bincount(at, v, nodes) for v in (None, weight, moved)], axis=1)
        out[:, :, :, 0] = whole[:, :, None]
        for codes, group in zip(b.codes, self.groups):
            size = group[-1][1] * group[-1][2]
            cell = at * size + codes.take(rows)
            found = np.empty((3, nodes * size))
            found[2] = np.bincount(cell, moved, nodes * size)
            if not two:
                found[0], found[1] = np.bincount(cell, None, nodes * size), np.bincount(cell, weight, nodes * size)
            elif low == high:
                found[0] = np.bincount(cell, None, nodes * size)
                found[1] = found[0] * low
            else:
                light, many = np.bincount(2 * cell + heavy, None, 2 * nodes * size).reshape(-1, 2).T
                found[0], found[1] = light + many, light * low + many * high
            for feature, bins, below in group:
                out[:, :, feature, :bins] = found.reshape(3, nodes, -1, bins, below).sum(axis=(2, 4)).transpose(1, 0, 2)
        return out


def _dtype(width: int, columns: int, label: str = "i1") -> np.dtype:
    """``label`` is the type of a class, or of a target."""
    return np.dtype([("bins", "u1", (width,)), ("y", label), ("fold", "i4"), ("val", "?"), ("w", "f8", (columns,))])


def _store_blocks(rows: DataFrame, cuts: list[np.ndarray], kind: np.dtype) -> str:
    """Folder of binned rows, one stored row per Arrow batch with a number of its own."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for i, batch in enumerate(batches):
            matrix = lambda name: batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            x, out = matrix("x"), np.zeros(len(batch), dtype=kind)
            for j, c in enumerate(cuts):
                out["bins"][:, j] = np.searchsorted(c, x[:, j])
            out["w"] = matrix("w")
            for name in ("y", "fold", "val"):
                out[name] = batch.column(name).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_pydict({"block": pa.array([first + i], pa.int64()), "data": pa.array([out.tobytes()], pa.binary())})

    folder = scratch_path(rows.sparkSession, "boosting")
    rows.mapInArrow(pack, BLOCKS).write.parquet(folder)
    return folder


def _blocks(rows: Iterable[tuple[int, bytes]], kind: np.dtype, ensembles: int, packs: _Packs) -> Iterator[_Block]:
    """Stored blocks, joined to larger ones."""
    held: list[tuple[int, np.ndarray]] = []
    for number, data in rows:
        held.append((number, np.frombuffer(data, dtype=kind)))
        if sum(len(part) for _, part in held) >= JOINED_ROWS:
            yield _block(held, ensembles, packs)
            held = []
    if held:
        yield _block(held, ensembles, packs)


def _block(parts: list[tuple[int, np.ndarray]], ensembles: int, packs: _Packs) -> _Block:
    held = np.concatenate([part for _, part in parts])
    bins = np.ascontiguousarray(held["bins"].T)
    label = held["y"].copy() if held["y"].dtype.kind == "f" else (2 * held["y"] - 1).astype(np.int8)
    return _Block([(number, len(part)) for number, part in parts], bins, packs.codes(bins), label, held["fold"].copy(),
                  held["val"].copy(), np.ascontiguousarray(held["w"].T), np.zeros((ensembles, len(held)), dtype=packs.margins))


class _Held:
    """Blocks in the memory of one task."""

    def __init__(self, folder: str, kind: np.dtype, packs: _Packs):
        store, root = open_store(folder)
        files = [f.path for f in store.get_file_info(fs.FileSelector(root)) if f.path.endswith(".parquet")]
        rows = [(r["block"], r["data"]) for f in files for r in parquet.read_table(f, filesystem=store).to_pylist()]
        self.blocks = list(_blocks(sorted(rows), kind, 1, packs))

    def total(self, sums: Callable) -> dict:
        return next(sums(iter(self.blocks)))

    def change(self, step: Callable) -> None:
        self.blocks = [step(b) for b in self.blocks]


class _Spread:
    """Blocks of all tasks; a change takes place in the pass that follows it."""

    def __init__(self, spark: SparkSession, folder: str, kind: np.dtype, ensembles: int, packs: _Packs):
        self.spark, self.changes, self.old, self.stored = spark, 0, [], []
        stored = spark.read.schema(BLOCKS).parquet(folder).rdd
        self.state = stored.mapPartitions(lambda rows: _blocks(((r.block, r.data) for r in rows), kind, ensembles, packs)).persist(KEPT)

    def total(self, sums: Callable) -> dict:
        parts = self.state.mapPartitions(sums)
        found = reduce(_added, parts.collect()) if parts.getNumPartitions() <= COLLECTED else parts.treeReduce(_added)
        self._forget(self.old, self.stored[:-1])         # the pass has filled the new state
        self.old, self.stored = [], self.stored[-1:]
        return found

    def change(self, step: Callable) -> None:
        after, self.changes = self.state.map(step), self.changes + 1
        if self.changes % STORE_EVERY == 0:              # else the chain of states would grow with the rounds
            self.stored.append(scratch_path(self.spark, "boosting-state"))
            after.saveAsPickleFile(self.stored[-1], 1)
            after = self.spark.sparkContext.pickleFile(self.stored[-1])
        self.old.append(self.state)
        self.state = after.persist(KEPT)

    def close(self) -> None:
        self._forget([*self.old, self.state], self.stored)

    def _forget(self, states: list[RDD], paths: list[str]) -> None:
        for state in states:
            state.unpersist()
        for path in paths:
            drop_path(self.spark, path)


# -- trees --------------------------------------------------------------------------------------

class _Tree:
    """Nodes as lists: feature (-1: none), bin (left up to it), left child (the right one follows), mean residual.

    ``stats`` are rows, weight and weighted residuals, ``gain`` is what the split takes off the variance.
    """

    def __init__(self, root: np.ndarray):
        self.feature, self.bin, self.left, self.value = [-1], [0], [-1], [root[2] / root[1]]
        self.stats, self.gain = [tuple(map(float, root))], [-1.0]

    def split(self, node: int, feature: int, cut: int, sides: np.ndarray, gain: float) -> int:
        kid = len(self.feature)
        self.gain[node] = float(gain)
        self.gain += [-1.0, -1.0]
        self.stats += [tuple(map(float, side)) for side in sides]
        self.feature[node], self.bin[node], self.left[node] = int(feature), int(cut), kid
        self.feature += [-1, -1]
        self.bin += [0, 0]
        self.left += [-1, -1]
        self.value += [float(side[2] / side[1]) for side in sides]
        return kid

    def arrays(self) -> tuple[np.ndarray, ...]:
        return tuple(np.array(a) for a in (self.feature, self.bin, self.left, self.value))


def _place(tree: tuple[np.ndarray, ...], bins: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The node each of the rows ends in."""
    feature, cut, left, _ = tree
    if feature[0] < 0:
        return np.zeros(len(rows), dtype=np.int64)
    at = left[0] + (bins[feature[0]].take(rows) > cut[0])
    flat, first = bins.ravel(), feature * bins.shape[1]
    moving = np.flatnonzero(feature[at] >= 0)
    while len(moving):
        node = at[moving]
        at[moving] = node = left[node] + (flat.take(first[node] + rows[moving]) > cut[node])
        moving = moving[feature[node] >= 0]
    return at


def _best(sums: np.ndarray, allowed: np.ndarray, least: np.ndarray):
    """Best split per node by variance; ``sums`` is (node, what, feature, bin) of rows, weights and weighted residuals.

    Returns (found, feature, bin, sums of the sides as (node, side, what), gain).
    """
    below = sums.cumsum(axis=3)
    left, right = below[..., :-1], below[..., -1:] - below[..., :-1]
    valid = (left[:, 0] >= least[:, None, None]) & (right[:, 0] >= least[:, None, None]) & allowed[:, :, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        score = np.where(valid, left[:, 2] ** 2 / left[:, 1] + right[:, 2] ** 2 / right[:, 1], -np.inf).reshape(len(sums), -1)
        # The first of equal splits, whatever the order their sums were added in.
        top = score.max(axis=1, keepdims=True)
        at, node = (score >= top - TIE * np.abs(top)).argmax(axis=1), np.arange(len(sums))
        whole = below[:, :, 0, -1]
        gain = (score[node, at] - whole[:, 2] ** 2 / whole[:, 1]) / whole[:, 1]
    feature, cut = at // (BINS - 1), at % (BINS - 1)
    return gain > LEAST_GAIN, feature, cut, np.stack([left[node, :, feature, cut], right[node, :, feature, cut]], axis=1), gain


def _allowed(fit: BoostFit, tree: int, node: int, width: int) -> np.ndarray:
    """The features a node may use."""
    if fit.settings.columns == "all":
        return np.ones(width, dtype=bool)
    order = np.random.default_rng([fit.settings.seed, tree, node]).random(width).argsort()
    return order.argsort() < int(np.ceil(float(fit.settings.columns) * width))


# -- passes -------------------------------------------------------------------------------------

def _histograms(blocks: Iterator[_Block], fits: list[BoostFit], packs: _Packs, tree: int, wanted: dict[int, tuple]) -> Iterator[dict]:
    """Per ensemble the sums (node, what, feature, bin) of the wanted nodes: (tree so far, their ids)."""
    out: dict[int, np.ndarray] = {}
    for b in blocks:
        draws: dict = {}
        for k, (grown, nodes) in wanted.items():
            rows = b.drawn(fits[k], tree, draws)
            slot = np.full(len(grown[0]), -1)
            slot[nodes] = np.arange(len(nodes))
            at = slot[_place(grown, b.bins, rows)]
            if len(grown[0]) > 1:
                here = np.flatnonzero(at >= 0)
                rows, at = rows[here], at[here]
            weight = b.weights[fits[k].weight].take(rows)
            found = packs.sums(b, rows, at, len(nodes), weight, weight * b.residuals(fits[k], k, rows, tree))
            out[k] = out[k] + found if k in out else found
    yield out


def _errors(blocks: Iterator[_Block], fits: list[BoostFit], live: list[int]) -> dict[int, np.ndarray]:
    """Per ensemble the weighted loss of its held out rows, and their weight."""
    out = {k: np.zeros(2) for k in live}
    for b in blocks:
        for k in live:
            rows = np.flatnonzero(b.held_out & (b.fold != fits[k].without))
            weight = b.weights[fits[k].weight, rows]
            out[k] += (weight * b.losses(fits[k], k, rows)).sum(), weight.sum()
    return out


def _first_pass(blocks: Iterator[_Block], fits: list[BoostFit], packs: _Packs, tree: int, live: list[int]) -> Iterator[dict]:
    """Errors of the margins as they are, and the roots of the next trees."""
    held = list(blocks)
    stump = tuple(np.array([v]) for v in (-1, 0, -1, 0.0))
    roots = next(_histograms(iter(held), fits, packs, tree, {k: (stump, [0]) for k in live}))
    yield {("error", k): v for k, v in _errors(iter(held), fits, live).items()} | roots


def _moved(b: _Block, fits: list[BoostFit], grown: dict[int, tuple]) -> _Block:
    """The block with the trees added to its margins."""
    margins = b.margins.copy()
    for k, tree in grown.items():
        rows = np.flatnonzero(b.fold != fits[k].without)
        margins[k, rows] += tree[3][_place(tree, b.bins, rows)].astype(margins.dtype)
    return replace(b, margins=margins)


def _added(a: dict, b: dict) -> dict:
    return {k: a[k] + b[k] if k in a and k in b else a.get(k, b.get(k)) for k in a.keys() | b.keys()}


def _grow(rows: _Held | _Spread, fits: list[BoostFit], packs: _Packs, number: int, roots: dict[int, np.ndarray]) -> dict[int, _Tree]:
    """The next tree of each ensemble in ``roots``, level by level."""
    trees = {k: _Tree(sums[0, :, 0].sum(axis=-1)) for k, sums in roots.items()}
    nodes, sums = [(k, 0) for k in roots], np.concatenate(list(roots.values()))
    depth = 0
    while nodes:
        allowed = np.array([_allowed(fits[k], number, node, sums.shape[2]) for k, node in nodes])
        found, feature, cut, sides, gain = _best(sums, allowed, np.array([fits[k].settings.min_child for k, _ in nodes]))
        depth += 1
        wanted: dict[int, list[int]] = {}
        pairs = []
        for i in np.flatnonzero(found):
            k, node = nodes[i]
            kid = trees[k].split(node, feature[i], cut[i], sides[i], gain[i])
            small = int(sides[i, 1, 0] < sides[i, 0, 0])
            going = [side for side in (0, 1) if sides[i, side, 0] >= 2 * fits[k].settings.min_child]
            if going and depth < fits[k].settings.depth:
                pairs.append((k, kid, small, going, i, len(wanted.setdefault(k, []))))
                wanted[k].append(kid + small)
        if not pairs:
            break
        asked = {k: (trees[k].arrays(), ids) for k, ids in wanted.items()}
        got = rows.total(partial(_histograms, fits=fits, packs=packs, tree=number, wanted=asked))
        below, parents = [], sums
        nodes = [(k, kid + side) for k, kid, _, going, _, _ in pairs for side in going]
        for k, _, small, going, i, slot in pairs:
            own = got[k][slot]
            rest = parents[i] - own
            rest[:, rest[0] == 0] = 0.0          # what is left of no row is rounding
            below += [own if side == small else rest for side in going]
        sums = np.stack(below)
    return trees


# -- fitting ------------------------------------------------------------------------------------

def fit_boosted(train: DataFrame, vector: str, label: str, fits: Sequence[BoostFit], weights: Sequence[str], fold: str,
                held_out: str) -> list[Boosted]:
    """One ensemble per fit. ``label`` holds 0 and 1; an ensemble sees the rows of all folds but its own left out one.

    It stops where the error on its rows marked ``held_out`` no longer falls; without such rows all rounds run.
    """
    spark, fits = train.sparkSession, list(fits)
    rows = train.select(
        vector_to_array(vector).alias("x"), F.col(label).cast("int").alias("y"), F.col(fold).cast("int").alias("fold"),
        F.col(held_out).alias("val"), F.array(*[F.col(w).cast("double") for w in weights]).alias("w"))
    first = rows.select(F.size("x").alias("n")).first()
    if first is None:
        raise ValueError("no training rows")
    if not rows.where("y IS NULL OR y NOT IN (0, 1)").isEmpty():
        raise ValueError("labels must be 0 or 1")
    cuts = _cuts(rows, first.n)
    with long_tasks(spark) as tasks:
        return _written(spark, _ensembles(rows, cuts, _dtype(first.n, len(weights)), fits, _Packs.of(cuts), tasks), cuts)


def _ensembles(rows: DataFrame, cuts: list[np.ndarray], kind: np.dtype, fits: list[BoostFit], packs: _Packs, tasks: int) -> list[list[_Tree]]:
    """The trees of each fit, grown by up to ``tasks`` tasks that hold all rows, or by all together."""
    spark, folder = rows.sparkSession, _store_blocks(rows, cuts, kind)
    if rows.count() <= LOCAL_ROWS:
        # The deepest ensembles are dealt first: they take longest.
        order = sorted(range(len(fits)), key=lambda k: -fits[k].settings.rounds * fits[k].settings.depth)
        hands = [order[i::tasks] for i in range(min(tasks, len(order)))]
        grown = dict(spark.sparkContext.parallelize(hands, len(hands)).flatMap(
            lambda hand: [(k, _boost(_Held(folder, kind, packs), [fits[k]], packs)[0]) for k in hand]).collect())
        trees = [grown[k] for k in range(len(fits))]
    else:
        spread = _Spread(spark, folder, kind, len(fits), packs)
        trees = _boost(spread, fits, packs)
        spread.close()
    drop_path(spark, folder)
    return trees


def _boost(rows: _Held | _Spread, fits: list[BoostFit], packs: _Packs) -> list[list[_Tree]]:
    """The trees of each ensemble, up to the best round."""
    trees: list[list[_Tree]] = [[] for _ in fits]
    best: list[tuple[float, int] | None] = [None] * len(fits)        # error and trees up to there
    live, number = list(range(len(fits))), 0
    while True:
        sums = rows.total(partial(_first_pass, fits=fits, packs=packs, tree=number, live=live))
        still = []
        for k in live:
            error, weight = sums["error", k]
            if (number == 0 or weight == 0 or _improves(best, k, error / weight, number, fits[k].settings.tolerance)) \
                    and number < fits[k].settings.rounds:
                still.append(k)
        live = still
        if not live:
            return [own[:best[k][1]] if best[k] else own for k, own in enumerate(trees)]
        # A round whose sample holds no row of an ensemble adds nothing to it.
        roots = {k: sums[k] for k in live if k in sums and sums[k][0, 0].any()}
        if number == 0 and len(roots) < len(live):
            raise ValueError("no training rows")
        grown = _grow(rows, fits, packs, number, roots)
        for k, tree in grown.items():
            tree.value = [v * (fits[k].settings.step if number else 1.0) for v in tree.value]
            trees[k].append(tree)
        rows.change(partial(_moved, fits=fits, grown={k: t.arrays() for k, t in grown.items()}))
        number += 1


def _improves(best: list, k: int, error: float, number: int, tolerance: float) -> bool:
    """Whether to go on after ``number`` trees, as MLlib decides it; notes the best number."""
    if best[k] is None:
        best[k] = (error, number)
        return True
    if best[k][0] - error < tolerance * max(error, 0.01):
        return False
    if error < best[k][0]:
        best[k] = (error, number)
    return True


def _written(spark: SparkSession, ensembles: list[list[_Tree]], cuts: list[np.ndarray]) -> list[Boosted]:
    found = [(k, i, t.feature, [float(cuts[f][b]) if f >= 0 else 0.0 for f, b in zip(t.feature, t.bin)], t.left, [float(v) for v in t.value])
             for k, trees in enumerate(ensembles) for i, t in enumerate(trees)]
    folder = scratch_path(spark, "boosted")
    spark.createDataFrame(found, f"ensemble int, {NODES}").coalesce(1).write.partitionBy("ensemble").parquet(folder)
    return [Boosted(f"{folder}/ensemble={k}") for k in range(len(ensembles))]


# -- the model ----------------------------------------------------------------------------------

@dataclass
class Boosted:
    """Trees as a table in shared storage, one row each; leaves hold what they add to the margin."""

    folder: str

    def probability(self, df: DataFrame, vector: str, name: str) -> DataFrame:
        """Adds the probability of class 1."""
        folder = self.folder

        @F.pandas_udf(T.DoubleType())
        def score(batch: pd.Series) -> pd.Series:
            x = np.array(batch.tolist(), dtype=float).reshape(len(batch), -1)
            with np.errstate(over="ignore"):
                return pd.Series(1.0 / (1.0 + np.exp(-2.0 * leaf_sums(_ensemble(folder), x))))

        return df.withColumn(name, score(vector_to_array(vector)))

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        spark.read.schema(NODES).parquet(self.folder).write.mode("overwrite").parquet(f"{path}/nodes")

    @classmethod
    def load(cls, path: str) -> Boosted:
        return cls(f"{path}/nodes")


@lru_cache(maxsize=4)
def _ensemble(folder: str) -> list[tuple[np.ndarray, ...]]:
    return read_trees(folder)


# -- models of MLlib ----------------------------------------------------------------------------

EXACT_ROWS = 10_000      # rows whose values the driver counts
GRID = 1 << 10           # values between which weights of more rows are summed

MODEL_NODES = ("treeID int, nodeData struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, rawCount: bigint, "
               "gain: double, leftChild: int, rightChild: int, "
               "split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>>")


def fit_as_mllib(learner, kind, train: DataFrame, settings: BoostSettings, loss: str, vector: str, label: str, held_out: str,
                 weight: str | None = None):
    """The model (of class ``kind``) that ``learner`` would fit: same cut points, trees and early stopping.

    Cut points of more than ``EXACT_ROWS`` rows come from all of them, where MLlib draws some. The variance of residuals
    inside a node is not summed: nothing but the model's text shows it.
    """
    spark = train.sparkSession
    y = F.col(label).cast("int" if loss == "log" else "double")
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    rows = train.select(vector_to_array(vector).alias("x"), y.alias("y"), F.lit(0).alias("fold"), F.col(held_out).alias("val"), F.array(w).alias("w"))
    shown = rows.where("NOT val")
    first = shown.select(F.size("x").alias("n")).first()
    if first is None:
        raise ValueError("no training rows")
    cuts = _weighted_cuts(shown, first.n)
    fit = BoostFit(settings, 0, loss=loss)
    trees = _ensembles(rows, cuts, _dtype(first.n, 1, "i1" if loss == "log" else "f8"), [fit], _Packs.of(cuts, "f8"), 1)[0]
    return _as_mllib(spark, learner, kind, trees, cuts)


def _weighted_cuts(rows: DataFrame, width: int) -> list[np.ndarray]:
    """Per feature the cut points MLlib finds: between all values where they are few, else at equal steps of weight."""
    count = rows.count()
    most = min(BINS, count) - 1
    if count <= EXACT_ROWS:
        held = rows.select("x", F.col("w")[0].alias("w")).collect()
        x, w = np.array([r.x for r in held], dtype=float).reshape(count, width), np.array([r.w for r in held])
        found = [np.unique(c, return_inverse=True) for c in x.T]
        return [_steps(values, np.bincount(at, w, len(values)), most, True) for values, at in found]
    parts: list[list] = [[] for _ in range(width)]
    for r in rows.select("x").mapInArrow(partial(_spaced, width=width), "feature int, n long, few binary, spaced binary").toLocalIterator():
        parts[r.feature].append((r.n, None if r.few is None else np.frombuffer(r.few), np.frombuffer(r.spaced)))
    found = [_grid(part) for part in parts]
    grid, few = [values for values, _ in found], [single for _, single in found]
    ends = np.cumsum([0, *map(len, grid)])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ends[-1])
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            w = batch.column("w").to_numpy(zero_copy_only=False)
            for j, values in enumerate(grid):
                total[ends[j]:ends[j + 1]] += np.bincount(np.searchsorted(values, x[:, j]), w, len(values))
        yield pa.RecordBatch.from_pydict({"w": pa.array([total.tobytes()], pa.binary())})

    weights = np.sum([np.frombuffer(r.w) for r in rows.select("x", F.col("w")[0].alias("w")).mapInArrow(weigh, "w binary").toLocalIterator()], axis=0)
    return [_steps(values, weights[ends[j]:ends[j + 1]], most, few[j]) for j, values in enumerate(grid)]


def _spaced(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Per feature of a task's rows: all values, where they are few, and values at equal steps of rows."""
    few: list[np.ndarray | None] = [np.empty(0)] * width
    spaced: list[list[np.ndarray]] = [[] for _ in range(width)]
    count = 0
    for batch in batches:
        x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
        count += len(x)
        for j in range(width if len(x) else 0):
            values = np.sort(x[:, j])
            if few[j] is not None:
                known = np.unique(np.append(few[j], values))
                few[j] = known if len(known) <= GRID else None
            spaced[j].append(_each(values))
    for j in range(width if count else 0):
        yield pa.RecordBatch.from_pydict({
            "feature": pa.array([j], pa.int32()), "n": pa.array([count], pa.int64()),
            "few": pa.array([None if few[j] is None else few[j].tobytes()], pa.binary()),
            "spaced": pa.array([_each(np.sort(np.concatenate(spaced[j]))).tobytes()], pa.binary())})


def _each(values: np.ndarray) -> np.ndarray:
    """``GRID`` of the ascending values, evenly."""
    return values[((np.arange(GRID) + 0.5) / GRID * len(values)).astype(int)]


def _grid(parts: list[tuple[int, np.ndarray | None, np.ndarray]]) -> tuple[np.ndarray, bool]:
    """A feature's values, and True, where they are few; else values up to which rows are counted."""
    if all(few is not None for _, few, _ in parts):
        values = np.unique(np.concatenate([few for _, few, _ in parts]))
        if len(values) <= GRID:
            return values, True
    values, n = np.concatenate([p[2] for p in parts]), np.repeat([float(p[0]) for p in parts], GRID)
    order = values.argsort()
    at = np.searchsorted(n[order].cumsum(), np.arange(1, GRID) / GRID * n.sum())
    return np.append(np.unique(values[order][at]), np.inf), False


def _steps(values: np.ndarray, weights: np.ndarray, most: int, single: bool) -> np.ndarray:
    """Cuts after at most ``most`` of the ascending values, at equal steps of weight; ``single`` values are cut in the middle to the next."""
    if len(values) - 1 <= most:
        after = list(range(len(values) - 1))
    else:
        step, sums = weights.sum() / (most + 1), weights.cumsum().tolist()
        after, target = [], step
        for i in range(1, len(sums)):
            if abs(sums[i - 1] - target) < abs(sums[i] - target):
                after.append(i - 1)
                target += step
    at = np.array(after, dtype=int)[:BINS - 1]
    return (values[at] + values[at + 1]) / 2.0 if single else values[at]


def _as_mllib(spark: SparkSession, learner, kind, trees: list[_Tree], cuts: list[np.ndarray]):
    """The trees in the form MLlib stores its models in, read by MLlib."""
    def node(t: _Tree, i: int) -> tuple:
        f, (rows, weight, moved) = t.feature[i], t.stats[i]
        split = (f, [float(cuts[f][t.bin[i]])], -1) if f >= 0 else (-1, [], -1)
        right = t.left[i] + 1 if f >= 0 else -1
        return i, moved / weight, float("nan"), [weight, moved, float("nan")], int(rows), t.gain[i], t.left[i], right, split

    def about(name: str, uid: str, params: dict, defaults: dict, **more) -> str:
        return json.dumps({"class": name, "timestamp": int(time.time() * 1000), "sparkVersion": spark.version, "uid": uid,
                           "paramMap": params, "defaultParamMap": defaults, **more})

    path, package = scratch_path(spark, "boosted"), kind.__module__.replace("pyspark.ml", "org.apache.spark.ml")
    params, defaults = ({p.name: v for p, v in found.items()} for found in (learner._paramMap, learner._defaultParamMap))
    one = {n: params[n] for n in ("featuresCol", "maxDepth", "minInstancesPerNode", "seed") if n in params}
    meta = about(f"{package}.{kind.__name__}", learner.uid, params, defaults, numFeatures=len(cuts), numTrees=len(trees))
    spark.createDataFrame([(meta,)], "value string").coalesce(1).write.text(f"{path}/metadata")
    step = float(learner.getStepSize())
    each = [(n, about("org.apache.spark.ml.regression.DecisionTreeRegressionModel", f"{learner.uid}_{n}", one, {}), step if n else 1.0)
            for n in range(len(trees))]
    spark.createDataFrame(each, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    nodes = [(n, node(t, i)) for n, t in enumerate(trees) for i in range(len(t.feature))]
    spark.createDataFrame(nodes, MODEL_NODES).coalesce(1).write.parquet(f"{path}/data")
    return kind.load(path)
