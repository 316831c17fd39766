"""Boosted-tree models on MLlib: single regressors, two-stage routing, stacking.

Rounds, depths and weights default to the values of full training; pass smaller ones for trials.
Training frames are written to the shared folder first, because boosting reads them many times.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field
from functools import partial, reduce
from multiprocessing.pool import ThreadPool

from pyspark.ml.classification import (GBTClassificationModel, GBTClassifier, LogisticRegression,
                                       LogisticRegressionModel)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from gridpulse.functions.columns import exp_prediction
from gridpulse.functions.skew import group_quantiles
from gridpulse.operators.boosting import Boosted, BoostFit, fit_as_mllib, fit_boosted
from gridpulse.operators.forest import Forest, ForestSettings, fit_forest
from gridpulse.operators.features import quoted, random_split, split_share, valid_targets
from gridpulse.operators.metrics import (DURATION_GRID, SCOPE_GRID, route_hard, route_soft,
                                         tune_threshold_balanced, tune_threshold_f2)
from gridpulse.session import cut_lineage

VECTOR = "features_vec"


def assemble(df: DataFrame, features: Sequence[str], name: str = VECTOR) -> DataFrame:
    """One vector column from the named features; missing columns and nulls count 0."""
    # The assembler reads names with dots or spaces as paths, so it gets plain ones.
    plain = {f"_x{i}": F.coalesce(quoted(c).try_cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0)
             for i, c in enumerate(features)}
    return VectorAssembler(inputCols=list(plain), outputCol=name).transform(df.withColumns(plain)).drop(*plain)


def training_frame(df: DataFrame, features: Sequence[str], extra: Sequence[str]) -> DataFrame:
    """Only vector, label and ``extra``, stored in the shared folder."""
    slim = cut_lineage(assemble(df, features).select(VECTOR, *extra), "training")
    # Learners pass over the rows once per round: all cores take part, also where the table is one small file.
    cores = slim.sparkSession.sparkContext.defaultParallelism
    return slim.repartition(cores) if slim.rdd.getNumPartitions() < cores else slim


def at_once(spark: SparkSession, calls: Sequence[Callable], parallel: int = 4) -> list:
    """What the calls return; up to ``parallel`` of them run at a time."""
    # Wrapped one by one: each needs a copy of the session's local properties of its own.
    todo = [inheritable_thread_target(spark)(call) for call in calls]
    with ThreadPool(min(parallel, len(todo))) as pool:
        return pool.map(lambda call: call(), todo, chunksize=1)


# -- single regressors --------------------------------------------------------------------------

@dataclass
class BoostSettings:
    rounds: int = 500
    depth: int = 5
    step: float = 0.1
    min_child: int = 1
    loss: str = "squared"
    subsample: float = 1.0
    columns: str = "all"
    seed: int = 42
    tolerance: float = 0.001    # early stopping: the share by which a round has to lower the validation error

    def regressor(self) -> GBTRegressor:
        return GBTRegressor(
            featuresCol=VECTOR, labelCol="_y", predictionCol="_log_pred", maxIter=self.rounds, maxDepth=self.depth,
            stepSize=self.step, minInstancesPerNode=self.min_child, lossType=self.loss,
            subsamplingRate=self.subsample, featureSubsetStrategy=self.columns, seed=self.seed, validationTol=self.tolerance)

    def classifier(self) -> GBTClassifier:
        return GBTClassifier(
            featuresCol=VECTOR, labelCol="_y", predictionCol="_class", maxIter=self.rounds, maxDepth=self.depth,
            stepSize=self.step, minInstancesPerNode=self.min_child, subsamplingRate=self.subsample,
            featureSubsetStrategy=self.columns, seed=self.seed, validationTol=self.tolerance,
        ).setProbabilityCol("_probability").setRawPredictionCol("_raw")


DURATION_SINGLE = BoostSettings(rounds=500, depth=6, step=0.1)
SCOPE_SINGLE = BoostSettings(rounds=1000, depth=5, step=0.05)


@dataclass
class LogRegressor:
    """Boosted regressor on ``log1p`` of the target."""

    model: GBTRegressionModel
    features: list[str]

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        scored = self.model.transform(assemble(df, self.features))
        return scored.withColumn(name, exp_prediction("_log_pred")).drop(VECTOR, "_log_pred")

    def save(self, path: str) -> None:
        _save(self.model, path, "model")
        _save_meta(self.model, path, {"features": self.features})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LogRegressor:
        return cls(GBTRegressionModel.load(f"{path}/model"), _load_meta(spark, path)["features"])


def fit_regressor(train: DataFrame, features: Sequence[str], settings: BoostSettings = DURATION_SINGLE,
                  target: str = "label", heavy_from: float | None = None, heavy_weight: float = 1.0,
                  validation: Column | None = None) -> LogRegressor:
    """Targets from ``heavy_from`` up weigh ``heavy_weight``; ``validation`` marks rows for early stopping."""
    rows = valid_targets(train, target)
    weight = F.lit(1.0) if heavy_from is None else F.when(F.col(target) >= heavy_from, heavy_weight).otherwise(1.0)
    rows = rows.withColumns({"_y": F.log1p(target), "_w": weight.cast("double")})
    extra = ["_y", "_w"]
    if validation is not None:
        rows, extra = rows.withColumn("_val", validation), [*extra, "_val"]
    learner = settings.regressor().setWeightCol("_w")
    if validation is not None:
        learner = learner.setValidationIndicatorCol("_val")
    return LogRegressor(learner.fit(training_frame(rows, features, extra)), list(features))


# -- two stages ---------------------------------------------------------------------------------

@dataclass
class TwoStageSettings:
    threshold: float = 240.0
    positive_weight: float = 2.5
    classifier: BoostSettings = field(default_factory=lambda: BoostSettings(500, 5))
    short: BoostSettings = field(default_factory=lambda: BoostSettings(500, 5, min_child=10))
    long: BoostSettings = field(default_factory=lambda: BoostSettings(500, 6, min_child=5))
    grid: Sequence[float] = DURATION_GRID
    seed: int = 42

    def with_rounds(self, rounds: int, depth: int | None = None) -> TwoStageSettings:
        def smaller(s: BoostSettings) -> BoostSettings:
            return BoostSettings(**{**asdict(s), "rounds": rounds, "depth": depth or s.depth})
        return TwoStageSettings(self.threshold, self.positive_weight, smaller(self.classifier),
                                smaller(self.short), smaller(self.long), self.grid, self.seed)


def duration_settings(threshold: float = 240.0) -> TwoStageSettings:
    return TwoStageSettings(threshold)


def scope_settings(threshold: float = 500.0) -> TwoStageSettings:
    return TwoStageSettings(
        threshold, 20.0, BoostSettings(500, 5), BoostSettings(500, 5, min_child=10, loss="absolute"),
        BoostSettings(500, 6, min_child=5, loss="absolute"), SCOPE_GRID)


@dataclass
class TwoStageModel:
    classifier: GBTClassificationModel
    short: GBTRegressionModel
    long: GBTRegressionModel
    features: list[str]
    threshold: float          # cut between the classes, in target units
    probability_cut: float    # tuned on validation rows

    def scores(self, df: DataFrame) -> DataFrame:
        """Adds ``p_long``, ``short_pred`` and ``long_pred``; nothing is routed yet."""
        out = self.classifier.transform(assemble(df, self.features))
        out = out.withColumn("p_long", vector_to_array("_probability")[1]).drop("_probability", "_raw", "_class")
        for name, model in (("short_pred", self.short), ("long_pred", self.long)):
            out = model.transform(out).withColumn(name, exp_prediction("_log_pred")).drop("_log_pred")
        return out.drop(VECTOR)

    def predict(self, df: DataFrame, soft: bool = False) -> DataFrame:
        """Adds the scores, ``prediction`` and ``routed`` (0 short, 1 long)."""
        chosen = route_soft() if soft else route_hard(self.probability_cut)
        return self.scores(df).withColumns({
            "prediction": chosen, "routed": (F.col("p_long") >= self.probability_cut).cast("int")})

    def importances(self, spark: SparkSession) -> DataFrame:
        """Importance per feature and sub-model."""
        rows = [(part, name, float(value)) for part, model in (
            ("classifier", self.classifier), ("short", self.short), ("long", self.long))
            for name, value in zip(self.features, model.featureImportances.toArray())]
        return spark.createDataFrame(rows, "part string, name string, importance double")

    def save(self, path: str) -> None:
        for part in ("classifier", "short", "long"):
            _save(getattr(self, part), path, part)
        _save_meta(self.classifier, path, {
            "features": self.features, "threshold": self.threshold, "probability_cut": self.probability_cut})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TwoStageModel:
        meta = _load_meta(spark, path)
        return cls(GBTClassificationModel.load(f"{path}/classifier"), GBTRegressionModel.load(f"{path}/short"),
                   GBTRegressionModel.load(f"{path}/long"), meta["features"], meta["threshold"],
                   meta["probability_cut"])


def _save(model, path: str, part: str) -> None:
    model.write().overwrite().save(f"{path}/{part}")


def _save_meta(model, path: str, meta: dict) -> None:
    spark = SparkSession.active()
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def _load_meta(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/meta").first().value)


def fit_two_stage(train: DataFrame, features: Sequence[str], keys: Sequence[str], target: str = "label",
                  settings: TwoStageSettings | None = None, test_share: float = 0.2) -> TwoStageModel:
    """One shared split; classifier on the class, one regressor per true class, cut tuned on validation.

    Boosting stops where the error on the shared validation part no longer falls.
    """
    settings = settings or duration_settings()
    rows = valid_targets(train, target).withColumns({
        "_val": split_share(keys, settings.seed) > 1.0 - test_share,
        "_long": (F.col(target) >= settings.threshold).cast("double"),
        "_y": F.log1p(F.col(target).cast("double"))})
    stored = training_frame(rows, features, ["_val", "_long", "_y"])
    val_rows = stored.where("_val")
    weighted = stored.select(VECTOR, F.col("_long").alias("_y"), "_val", F.when(
        F.col("_long") == 1, settings.positive_weight).otherwise(1.0).alias("_w"))
    # Each is grown by a task of its own, and no fit needs another one.
    parts = [(GBTClassificationModel, settings.classifier.classifier().setWeightCol("_w"), weighted, settings.classifier, "log")]
    parts += [(GBTRegressionModel, s.regressor(), stored.where(F.col("_long") == side), s, s.loss)
              for side, s in ((0, settings.short), (1, settings.long))]
    classifier, short, long = at_once(train.sparkSession, [
        partial(fit_as_mllib, learner, kind, part, s, loss, VECTOR, "_y", "_val", "_w" if loss == "log" else None)
        for kind, learner, part, s, loss in parts])
    probs = classifier.transform(val_rows.select(VECTOR, "_long")).select(
        F.col("_long").alias("label"), vector_to_array("_probability")[1].alias("score"))
    cut = tune_threshold_balanced(probs, grid=settings.grid).first().threshold
    return TwoStageModel(classifier, short, long, list(features), float(settings.threshold), float(cut))


# -- stacking -----------------------------------------------------------------------------------

@dataclass
class StackSettings:
    boost: BoostSettings = field(default_factory=lambda: BoostSettings(
        300, 6, 0.05, subsample=0.8, columns="0.8"))
    boost_weight: float = 10.0
    forest_trees: int = 200
    forest_depth: int = 15
    forest_min_leaf: int = 3          # a node of fewer than five rows is not split further
    plain: BoostSettings = field(default_factory=lambda: BoostSettings(150, 3, 0.05))
    logistic_rounds: int = 1000
    meta_rounds: int = 3000
    folds: int = 5
    early_share: float = 0.1          # of the rows a booster is fitted on, to stop it early
    parallel: int = 4                 # base models fitted at a time
    seed: int = 42


BASES = ("boost", "forest", "plain", "logistic")


def _probability(model, df: DataFrame, name: str) -> DataFrame:
    if isinstance(model, (Boosted, Forest)):
        return model.probability(df, VECTOR, name)
    return model.transform(df).withColumn(name, vector_to_array("_probability")[1]).drop(
        "_probability", "_raw", "_class")


def _fit_bases(stored: DataFrame, s: StackSettings) -> list[dict]:
    """The four base models of all folds but one, for each, and of all rows; boosting stops early on the rows marked ``_val``.

    All boosters grow side by side in the same passes. No other fit needs another one: ``s.parallel`` of them run at a time.
    The many short jobs of the logistic fits go beside the long tasks of the trees.
    """
    parts = [*range(s.folds), -1]
    boosters = [BoostFit(settings, column, fold) for fold in parts for column, settings in enumerate((s.boost, s.plain))]
    forest = ForestSettings(s.forest_trees, s.forest_depth, s.forest_min_leaf, s.seed)
    logistic = LogisticRegression(maxIter=s.logistic_rounds, weightCol="_w_balanced", featuresCol=VECTOR, labelCol="_y", predictionCol="_class",
                                  probabilityCol="_probability", rawPredictionCol="_raw")
    rows = [stored.where(F.col("_fold") != fold) for fold in parts]
    boost = partial(fit_boosted, stored.withColumn("_w_plain", F.lit(1.0)), VECTOR, "_y", boosters, ["_w_boost", "_w_plain"], "_fold", "_val")
    fits = [boost]
    for part in rows:
        fits += [partial(logistic.copy().fit, part), partial(fit_forest, part, VECTOR, "_y", "_w_balanced", forest)]
    boosted, *rest = at_once(stored.sparkSession, fits, s.parallel)
    return [{"boost": boosted[2 * i], "forest": rest[2 * i + 1], "plain": boosted[2 * i + 1], "logistic": rest[2 * i]}
            for i in range(len(parts))]


@dataclass
class StackedModel:
    bases: dict
    meta: LogisticRegressionModel
    features: list[str]
    threshold: float = 0.09

    def base_probabilities(self, df: DataFrame) -> DataFrame:
        out = assemble(df, self.features)
        for name in BASES:
            out = _probability(self.bases[name], out, f"p_{name}")
        return out.drop(VECTOR)

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds ``occ_prob`` and ``occ_pred`` (probability at or above the threshold)."""
        stacked = VectorAssembler(inputCols=[f"p_{b}" for b in BASES], outputCol=VECTOR).transform(
            self.base_probabilities(df))
        out = _probability(self.meta, stacked, "occ_prob").drop(VECTOR, *[f"p_{b}" for b in BASES])
        return out.withColumn("occ_pred", (F.col("occ_prob") >= self.threshold).cast("int"))

    def save(self, path: str) -> None:
        for name, model in self.bases.items():
            if isinstance(model, (Boosted, Forest)):
                model.save(f"{path}/{name}")
            else:
                _save(model, path, name)
        _save(self.meta, path, "final")
        _save_meta(self.meta, path, {"features": self.features, "threshold": self.threshold})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> StackedModel:
        meta = _load_meta(spark, path)
        kinds = {"boost": Boosted, "forest": Forest, "plain": Boosted, "logistic": LogisticRegressionModel}
        return cls({n: k.load(f"{path}/{n}") for n, k in kinds.items()},
                   LogisticRegressionModel.load(f"{path}/final"), meta["features"], meta["threshold"])


def _class_weights(rows: DataFrame) -> Column:
    """Balanced weights: rows / (2 * rows of the class)."""
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("p")).first()
    positive, total = float(counts.p or 0), float(counts.n)
    return F.when(F.col("_y") == 1, total / (2 * max(positive, 1.0))).otherwise(
        total / (2 * max(total - positive, 1.0)))


def stratified_folds(rows: DataFrame, label: str, share: str, folds: int) -> DataFrame:
    """Adds ``_fold``: every class (few) is cut into ``folds`` parts of equal size along ``share``."""
    cuts = group_quantiles(rows, [label], share, {f"_c{i}": i / folds for i in range(1, folds)}).collect()
    fold = F.lit(0)
    for row in cuts:
        below = sum(((F.col(share) > row[f"_c{i}"]).cast("int") for i in range(1, folds)), F.lit(0))
        fold = F.when(F.col(label) == row[label], below).otherwise(fold)
    return rows.withColumn("_fold", fold)


def fit_stacking(train: DataFrame, features: Sequence[str], keys: Sequence[str], target: str = "label",
                 settings: StackSettings | None = None, test_share: float = 0.2) -> StackedModel:
    """Four base classifiers, a logistic model on their out-of-fold probabilities, F2-tuned cut.

    The cut is tuned on a stratified validation part that no model sees while fitting.
    """
    s = settings or StackSettings()
    rows = train.withColumn("_y", F.col(target).cast("double"))
    fit_part, val_part = random_split(rows, keys, test_share, s.seed, label="_y")
    marked = stratified_folds(fit_part.withColumn("_u", split_share(keys, s.seed + 1)), "_y", "_u", s.folds)
    marked = marked.withColumns({
        "_w_boost": F.when(F.col("_y") == 1, s.boost_weight).otherwise(1.0),
        "_w_balanced": _class_weights(marked)})
    marked = marked.withColumn("_val", split_share(keys, s.seed + 2) < s.early_share)
    stored = training_frame(marked, features, ["_y", "_fold", "_val", "_w_boost", "_w_balanced"])
    *inner, bases = _fit_bases(stored, s)
    out_of_fold = []
    for fold in range(s.folds):
        outside = stored.where(F.col("_fold") == fold)
        for name, model in inner[fold].items():
            outside = _probability(model, outside, f"p_{name}")
        out_of_fold.append(outside.select("_y", "_w_balanced", *[f"p_{b}" for b in BASES]))
    level = VectorAssembler(inputCols=[f"p_{b}" for b in BASES], outputCol=VECTOR).transform(
        reduce(DataFrame.unionByName, out_of_fold))
    level = cut_lineage(level.select(VECTOR, "_y", "_w_balanced"), "stack")
    final = LogisticRegression(
        featuresCol=VECTOR, labelCol="_y", weightCol="_w_balanced", maxIter=s.meta_rounds, predictionCol="_class",
        probabilityCol="_probability", rawPredictionCol="_raw").fit(level)
    model = StackedModel(bases, final, list(features))
    scored = model.predict(val_part).select(F.col("_y").alias("label"), F.col("occ_prob").alias("score"))
    model.threshold = float(tune_threshold_f2(scored).first().threshold)
    return model


def top_importances(importances: DataFrame, n: int = 15, part: str | None = None) -> DataFrame:
    rows = importances if part is None else importances.where(F.col("part") == part)
    return rows.orderBy(F.desc("importance"), "name").limit(n)
