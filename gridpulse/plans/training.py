"""Training and evaluation jobs for duration, size, occurrence and anomaly models."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridpulse.operators import metrics as M
from gridpulse.operators.anomaly import (Autoencoder, IsolationForest, fit_autoencoder,
                                         fit_isolation_forest)
from gridpulse.operators.features import drop_features, quoted, split_share
from gridpulse.operators.models import (DURATION_SINGLE, SCOPE_SINGLE, BoostSettings, LogRegressor, StackedModel,
                                        StackSettings, TwoStageModel, TwoStageSettings, duration_settings,
                                        fit_regressor, fit_stacking, fit_two_stage, scope_settings)
from gridpulse.session import cut_lineage

TEST_YEAR = 2022


def feature_names(matrix: DataFrame, keys: Sequence[str], label: str = "label") -> list[str]:
    return [c for c in matrix.columns if c not in (*keys, label)]


def split(matrix: DataFrame, is_test: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Train before the test year, test in it; or by any condition (rows where it is null are in neither)."""
    if is_test is None:
        return matrix.where(F.col("year") < TEST_YEAR), matrix.where(F.col("year") == TEST_YEAR)
    return matrix.where(~is_test), matrix.where(is_test)


def _tagged(stage: str, *rows: DataFrame) -> DataFrame:
    """Metric rows of one evaluation in long form: stage, metric, value."""
    parts = [M.long_metrics(r) for r in rows]
    return reduce(DataFrame.unionByName, parts).withColumn("stage", F.lit(stage)).select("stage", "metric", "value")


def evaluate(scored: DataFrame, stage: str, kind: str, cut: float, pred: str = "prediction") -> DataFrame:
    """Regression and tolerance metrics; ``kind`` is "duration" or "scope"."""
    tolerance = (M.tolerance_accuracy_abs(scored, pred=pred, short=cut) if kind == "duration"
                 else M.tolerance_accuracy_rel(scored, pred=pred))
    return _tagged(stage, M.regression_metrics(scored, pred=pred), tolerance)


def train_two_stage(matrix: DataFrame, kind: str, keys: Sequence[str], settings: TwoStageSettings | None = None,
                    single: BoostSettings | None = None, is_test: Column | None = None,
                    generalise: bool = False, path: str | None = None,
                    ) -> tuple[TwoStageModel, LogRegressor, DataFrame]:
    """Fit, evaluate against the single regressor and against true-class routing, persist.

    The matrix is stored once, so fits and evaluations do not sessionise again.
    """
    settings = settings or (duration_settings() if kind == "duration" else scope_settings(300.0))
    stored = cut_lineage(matrix, f"{kind}-matrix")
    train, test = split(stored, is_test)
    names = feature_names(drop_features(stored, generalise), keys)
    model = fit_two_stage(train, names, keys, settings=settings)
    baseline = fit_regressor(train, names, single or (DURATION_SINGLE if kind == "duration" else SCOPE_SINGLE),
                             validation=split_share(keys, settings.seed) > 0.8)
    scored = cut_lineage(baseline.predict(model.predict(test).drop("_log_pred"), "single").select(
        *[quoted(k) for k in keys], "label", "p_long", "short_pred", "long_pred", "prediction", "routed", "single"),
        f"{kind}-scored")
    cut = settings.threshold
    report = evaluate(scored, "two_stage", kind, cut).unionByName(
        _tagged("routing", M.routing_metrics(scored, threshold=cut))).unionByName(
        evaluate(scored, "single", kind, cut, "single")).unionByName(
        evaluate(M.true_routing(scored, cut), "true_routing", kind, cut))
    if path:
        model.save(f"{path}/two_stage")
        baseline.save(f"{path}/single")
    return model, baseline, report


def train_occurrence(matrix: DataFrame, keys: Sequence[str], settings: StackSettings | None = None,
                     is_test: Column | None = None, path: str | None = None) -> tuple[StackedModel, DataFrame]:
    """Stacked classifier; metrics at the tuned cut and at 0.5."""
    stored = cut_lineage(matrix, "occurrence-matrix")
    train, test = split(stored, is_test)
    model = fit_stacking(train, feature_names(stored, keys), keys, settings=settings)
    scored = cut_lineage(model.predict(test).select("label", "occ_prob", "occ_pred"), "occurrence-scored")
    half = scored.withColumn("half", (F.col("occ_prob") >= 0.5).cast("int"))
    report = _tagged("tuned", M.classification_metrics(scored, pred="occ_pred")).unionByName(
        _tagged("half", M.classification_metrics(half, pred="half"))).unionByName(
        _tagged("ranking", M.roc_auc(scored, score="occ_prob"), M.average_precision(scored, score="occ_prob")))
    if path:
        model.save(path)
    return model, report


def train_anomaly(matrix: DataFrame, keys: Sequence[str], is_test: Column | None = None, epochs: int = 50,
                  trees: int = 100, path: str | None = None) -> tuple[Autoencoder, IsolationForest]:
    """Autoencoder and isolation forest on the occurrence matrix before the test period.

    With ``path`` both are stored, and what is returned is what later runs read from there.
    """
    stored = cut_lineage(matrix, "anomaly-matrix")
    train, _ = split(stored, is_test)
    names = feature_names(stored, keys)
    autoencoder = fit_autoencoder(train, names, epochs)
    forest = fit_isolation_forest(train, [n for n in names if n != "year"], keys, trees)
    if path is None:
        return autoencoder, forest
    spark = stored.sparkSession
    autoencoder.save(spark, f"{path}/autoencoder")
    forest.save(spark, f"{path}/forest")
    return Autoencoder.load(spark, f"{path}/autoencoder"), IsolationForest.load(spark, f"{path}/forest")


def cascade_batch(occurrence_matrix: DataFrame, scope_matrix: DataFrame, duration_matrix: DataFrame,
                  occurrence: StackedModel, scope: TwoStageModel, duration: TwoStageModel,
                  day_keys: Sequence[str] = ("fips_code", "year", "month", "day"),
                  is_test: Column | None = None) -> DataFrame:
    """True-class routing and the full cascade for both targets, as metric rows.

    All three matrices carry ``day_keys``; events whose day was not predicted count as 0.
    """
    _, occ_test = split(occurrence_matrix, is_test)
    predicted = cut_lineage(occurrence.predict(occ_test).select(*day_keys, "occ_pred"), "occurrence")
    reports = []
    for kind, matrix, model in (("scope", scope_matrix, scope), ("duration", duration_matrix, duration)):
        _, test = split(matrix, is_test)
        scored = cut_lineage(model.predict(test).select(
            *[quoted(k) for k in day_keys], "label", "short_pred", "long_pred", "prediction"), kind)
        reports.append(evaluate(M.true_routing(scored, model.threshold), f"{kind}_true_routing", kind, model.threshold))
        joined = M.cascade_join(scored, predicted, day_keys)
        reports.append(evaluate(joined, f"{kind}_cascade", kind, model.threshold, "cascade_prediction"))
        reports.append(_tagged(f"{kind}_cascade", M.cascade_summary(joined)))
    return reduce(DataFrame.unionByName, reports)
