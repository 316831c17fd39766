"""Additive per-row feature contributions of tree ensembles and logistic models.

Trees are read from the saved model's node table. Every leaf of a tree is a small game: a row's
feature either lies in the leaf's interval for that feature or not. Contributions of a leaf depend
only on which of its few path features match, so they are tabulated per pattern once, and rows of an
Arrow batch look their patterns up (path-dependent tree explanation, Lundberg et al. 2018).
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs, parquet
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gridpulse.operators.features import quoted
from gridpulse.session import open_store, scratch_path


FILE_LEAVES = 2000          # leaves of a file
HELD_FILES = 4              # files that a worker keeps in memory, at most

TABLE_LEAVES = 256          # leaves whose tables are made at once

# Up to this many path features a leaf's contributions are tabulated for all match patterns.
TABLE_FEATURES = 8


@dataclass
class LeafGame:
    features: np.ndarray      # path features, each once
    low: np.ndarray           # row matches when low < x <= high
    high: np.ndarray
    value: float
    shares: np.ndarray        # cover share a row keeps when the feature is unknown
    table: np.ndarray | None  # contributions per match pattern, on short paths

    def add(self, cols: Sequence[np.ndarray], out: Sequence[np.ndarray]) -> None:
        """Add the leaf's contributions to ``out``; ``cols`` has the path features' values, one array each, as ``out``."""
        kind = np.uint8 if len(cols) <= 8 else np.int64
        pattern = np.zeros(len(cols[0]), dtype=kind)
        for i, (x, low, high) in enumerate(zip(cols, self.low.tolist(), self.high.tolist())):
            match = x <= high if low == -np.inf else x > low if high == np.inf else (x > low) & (x <= high)
            pattern |= match.astype(kind) << kind(i)
        if self.table is not None:
            pattern = pattern.astype(np.intp)
            for i, o in enumerate(out):
                o += self.table[:, i].take(pattern, mode="clip")      # no pattern lies outside; this spares the check
            return
        found, back = np.unique(pattern, return_inverse=True)
        values = _leaf_values(self.value, self.shares, ((found[:, None] >> np.arange(len(cols))) & 1).astype(float))
        for i, o in enumerate(out):
            o += values[back, i]

    def contributions(self, cols: np.ndarray) -> np.ndarray:
        out = np.zeros((cols.shape[1], len(cols)))
        self.add(np.ascontiguousarray(cols.T), out)
        return out.T


@dataclass
class Explainer:
    """``base`` + sum of a row's contributions = the model's raw output for the row.

    The leaves lie in files of at most ``FILE_LEAVES`` under ``folder`` in shared storage. Tasks read them file by
    file, so that neither driver nor tasks hold an ensemble's leaves at once; a small ensemble stays in the worker.
    """

    features: list[str]
    base: float
    folder: str

    def contributions(self, x: np.ndarray) -> np.ndarray:
        # One array per feature, so that a leaf touches only its own features, each from end to end.
        cols = list(np.ascontiguousarray(x.T))
        out = [np.zeros(len(x)) for _ in cols]
        for games in _leaf_files(self.folder):
            for game in games:
                game.add([cols[f] for f in game.features], [out[f] for f in game.features])
        return np.stack(out, axis=1)


def _leaf_files(folder: str) -> Iterable[list[LeafGame]]:
    store, root = open_store(folder)
    files = sorted(f.path for f in store.get_file_info(fs.FileSelector(root)) if f.path.endswith(".parquet"))
    return _held_games(folder) if len(files) <= HELD_FILES else (_games(store, f) for f in files)


@lru_cache(maxsize=2)
def _held_games(folder: str) -> list[list[LeafGame]]:
    store, root = open_store(folder)
    files = sorted(f.path for f in store.get_file_info(fs.FileSelector(root)) if f.path.endswith(".parquet"))
    return [_games(store, f) for f in files]


def _games(store: fs.FileSystem, file: str) -> list[LeafGame]:
    """The games of a file's leaves; the tables of all leaves with equally many features are made at once, as one array."""
    columns = parquet.read_table(file, filesystem=store)
    value, features, low, high, shares = (columns.column(c).combine_chunks() for c in ("value", "features", "low", "high", "shares"))
    first = features.offsets.to_numpy()
    starts, wide = first[:-1], np.diff(first)
    value = value.to_numpy()
    features, low, high, shares = (c.values.to_numpy() for c in (features, low, high, shares))
    games: list[LeafGame | None] = [None] * len(wide)
    for k in np.unique(wide[wide > 0]):
        for rows in np.array_split(mine := np.flatnonzero(wide == k), len(mine) // TABLE_LEAVES + 1):
            at = starts[rows][:, None] + np.arange(k)
            tables = _tables(value[rows], shares[at]) if k <= TABLE_FEATURES else [None] * len(rows)
            for row, place, table in zip(rows, at, tables):
                games[row] = LeafGame(features[place], low[place], high[place], float(value[row]), shares[place], table)
    return [g for g in games if g is not None]


def _values(value: np.ndarray, shares: np.ndarray, patterns: np.ndarray) -> np.ndarray:
    """Shapley values (leaf, match pattern, feature) of leaves with equally many features.

    A feature in the coalition contributes 1 or 0 (match or not), one outside it its cover share.
    """
    k = shares.shape[1]
    weights = np.array([math.factorial(s) * math.factorial(k - s - 1) / math.factorial(k) for s in range(k)])
    out = np.zeros((len(value), len(patterns), k))
    for i in range(k):
        # Coefficient s of the product over the others: coalitions of size s.
        poly = np.zeros((len(value), len(patterns), k))
        poly[:, :, 0] = 1.0
        for j in range(k):
            if j != i:
                grown = poly * shares[:, j, None, None]
                grown[:, :, 1:] += poly[:, :, :-1] * patterns[:, [j]]
                poly = grown
        out[:, :, i] = value[:, None] * (patterns[:, i] - shares[:, i, None]) * (poly @ weights)
    return out


def _leaf_values(value: float, shares: np.ndarray, patterns: np.ndarray) -> np.ndarray:
    """Shapley values of one leaf, one row per match pattern."""
    return _values(np.array([value]), shares[None], patterns)[0]


def _tables(value: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """``_values`` for all match patterns, stored feature by feature: a lookup reads one feature's values only."""
    k = shares.shape[1]
    found = _values(value, shares, ((np.arange(1 << k)[:, None] >> np.arange(k)) & 1).astype(float))
    return np.ascontiguousarray(found.transpose(0, 2, 1)).transpose(0, 2, 1)


def _game(value: float, path: dict[int, tuple]) -> LeafGame:
    low, high, shares = (np.array([p[i] for p in path.values()]) for i in range(3))
    table = _tables(np.array([value]), shares[None])[0] if len(path) <= TABLE_FEATURES else None
    return LeafGame(np.array(list(path)), low, high, value, shares, table)


def _tree_leaves(nodes: dict[int, tuple]) -> Iterator[tuple[float, dict[int, tuple]]]:
    """(value, path) of each leaf of a tree. Node: (feature, cut, left, right, value, cover)."""
    todo = [(0, {})]
    while todo:
        at, path = todo.pop()
        feature, cut, left, right, value, cover = nodes[at]
        if left < 0:
            yield value, path
            continue
        for child, is_left in ((left, True), (right, False)):
            low, high, share = path.get(feature, (-np.inf, np.inf, 1.0))
            share *= nodes[child][5] / cover
            low, high = (low, min(high, cut)) if is_left else (max(low, cut), high)
            todo.append((child, {**path, feature: (low, high, share)}))


LEAVES = "value double, expected double, features array<int>, low array<double>, high array<double>, shares array<double>"


def tree_explainer(spark, model, features: Sequence[str]) -> Explainer:
    """Explains the raw output: log-scale prediction, boosting margin, or forest probability of class 1.

    The saved model's nodes are a table; one task per tree turns it into leaves, which are stored as a table too.
    """
    is_forest = type(model).__name__.startswith("RandomForest")
    weights = list(model.treeWeights)
    scale = [1.0 / len(weights)] * len(weights) if is_forest else weights
    path, folder = scratch_path(spark, "explain"), scratch_path(spark, "leaves")
    model.write().overwrite().save(path)
    node, stats = F.col("nodeData"), F.col("nodeData.impurityStats")
    value = node["prediction"]
    if is_forest and "Classification" in type(model).__name__:
        total = F.aggregate(stats, F.lit(0.0), lambda a, b: a + b)
        value = F.get(stats, F.lit(1)) / F.greatest(total, F.lit(1e-12))
    nodes = spark.read.parquet(f"{path}/data").select(
        "treeID", node["id"].alias("id"), node["split"]["featureIndex"].alias("feature"),
        F.coalesce(F.get(node["split"]["leftCategoriesOrThreshold"], F.lit(0)), F.lit(0.0)).alias("cut"),
        node["leftChild"].alias("left"), node["rightChild"].alias("right"), value.cast("double").alias("value"),
        node["rawCount"].cast("double").alias("cover"))
    wire = to_arrow_schema(spark.createDataFrame([], LEAVES).schema)

    def leaves(table: pa.Table) -> pa.Table:
        columns = [table.column(c).to_pylist() for c in ("id", "feature", "cut", "left", "right", "value", "cover")]
        tree = {row[0]: row[1:] for row in zip(*columns)}
        by, rows = scale[table.column("treeID")[0].as_py()], []
        for worth, path_ in _tree_leaves(tree):
            low, high, shares = ([float(p[i]) for p in path_.values()] for i in range(3))
            rows.append({"value": worth * by, "expected": worth * by * math.prod(shares), "features": list(path_),
                         "low": low, "high": high, "shares": shares})
        return pa.Table.from_pylist(rows, schema=wire)

    found = nodes.groupBy("treeID").applyInArrow(leaves, LEAVES)
    found.write.option("maxRecordsPerFile", FILE_LEAVES).parquet(folder)
    base = spark.read.schema(LEAVES).parquet(folder).agg(F.sum("expected")).first()[0]
    return Explainer(list(features), float(base or 0.0), folder)


def _explained(df: DataFrame, explainer: Explainer, keys: Sequence[str]) -> DataFrame:
    """Keys, ``base_value`` and one array of (name, value, shap) per row."""
    width = len(explainer.features)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def shap(batch: pd.Series) -> pd.Series:
        x = np.array(batch.tolist(), dtype=float).reshape(len(batch), width)
        return pd.Series(list(explainer.contributions(x)))

    inputs = F.array(*[F.coalesce(quoted(c).cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0)
                       for c in explainer.features])
    rows = df.select(*[quoted(k) for k in keys], inputs.alias("_x")).withColumn("_s", shap("_x"))
    names = F.array(*[F.lit(c) for c in explainer.features])
    items = F.arrays_zip(names.alias("name"), F.col("_x").alias("value"), F.col("_s").alias("shap"))
    return rows.select(*keys, F.lit(float(explainer.base)).alias("base_value"), items.alias("_items"))


def explain(df: DataFrame, explainer: Explainer, keys: Sequence[str]) -> DataFrame:
    """Long form: keys, ``base_value``, ``name``, ``value``, ``shap``."""
    return _explained(df, explainer, keys).select(*keys, "base_value", F.explode("_items").alias("e")).select(
        *keys, "base_value", F.col("e.name").alias("name"), F.col("e.value").alias("value"), F.col("e.shap").alias("shap"))


def explain_top(df: DataFrame, explainer: Explainer, keys: Sequence[str], n: int = 10) -> DataFrame:
    """One record per row: rounded base value and its ``n`` largest (name, value, shap), sorted where the row lies."""
    ranked = F.array_sort(F.transform("_items", lambda i: F.struct(
        (-F.abs(i["shap"])).alias("order"), i["name"].alias("name"), i["value"].alias("value"), i["shap"].alias("shap"))))
    return _explained(df, explainer, keys).select(*keys, F.round("base_value", 4).alias("base_value"), F.transform(
        F.slice(ranked, 1, n), lambda i: F.struct(i["name"].alias("name"), F.round(i["value"], 3).alias("value"),
                                                  F.round(i["shap"], 4).alias("shap"))).alias("features"))


def linear_contributions(df: DataFrame, model, features: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Logistic model: coefficient times distance from the mean, in margin units."""
    coefficients = [float(c) for c in model.coefficients.toArray()]
    filled = df.select(*[quoted(k) for k in keys], *[
        F.coalesce(quoted(c).cast("double"), F.lit(0.0)).alias(f"_x{i}") for i, c in enumerate(features)])
    means = filled.agg(F.array(*[F.avg(f"_x{i}") for i in range(len(features))])).scalar()
    rows = filled.withColumn("_m", means)
    base = F.lit(float(model.intercept))
    for i, c in enumerate(coefficients):
        base = base + F.lit(c) * F.col("_m")[i]
    each = F.explode(F.array(*[
        F.struct(F.lit(name).alias("name"), F.col(f"_x{i}").alias("value"),
                 (F.lit(coefficients[i]) * (F.col(f"_x{i}") - F.col("_m")[i])).alias("shap"))
        for i, name in enumerate(features)]))
    return rows.select(*keys, base.alias("base_value"), each.alias("e")).select(*keys, "base_value", "e.*")


def background_sample(df: DataFrame, keys: Sequence[str], n: int = 1000, seed: int = 42) -> DataFrame:
    """At most ``n`` rows for an explanation plot, chosen by key hash."""
    from gridpulse.operators.features import export_sample
    return export_sample(df, keys, n, seed)
