"""Evaluation: regression, tolerance, routing, ranking metrics, threshold tuning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridpulse.functions.columns import safe_ratio
from gridpulse.functions.skew import running_totals, spread_join


def _n(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def regression_metrics(df: DataFrame, true: str = "label", pred: str = "prediction") -> DataFrame:
    error = F.col(true) - F.col(pred)
    share = F.when(F.col(true) != 0, F.abs(error / F.col(true)))
    return df.agg(F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"),
                  (F.avg(share) * 100).alias("mape"))


def _tolerance(df: DataFrame, true: str, pred: str, cut: float, short_tolerance: Column,
               long_tolerance: Column) -> DataFrame:
    error = F.abs(F.col(true) - F.col(pred))
    short, long = F.col(true) < cut, F.col(true) >= cut
    hit_short, hit_long = short & (error <= short_tolerance), long & (error <= long_tolerance)
    total = F.count(F.lit(1))
    hits = _n(hit_short) + _n(hit_long)
    return df.agg(
        (safe_ratio(_n(hit_short), _n(short)) * 100).alias("short_outage_accuracy"),
        (safe_ratio(_n(hit_long), _n(long)) * 100).alias("long_outage_accuracy"),
        (safe_ratio(hits, total) * 100).alias("overall_accuracy"),
        _n(short).alias("short_outage_count"), _n(long).alias("long_outage_count"))


def tolerance_accuracy_abs(df: DataFrame, true: str = "label", pred: str = "prediction",
                           short: float = 240, short_tolerance: float = 60,
                           long_tolerance: float = 180) -> DataFrame:
    return _tolerance(df, true, pred, short, F.lit(short_tolerance), F.lit(long_tolerance))


def tolerance_accuracy_rel(df: DataFrame, true: str = "label", pred: str = "prediction",
                           short: float = 100, short_tolerance: float = 20,
                           share: float = 0.20) -> DataFrame:
    return _tolerance(df, true, pred, short, F.lit(short_tolerance), F.col(true) * share)


def routing_metrics(df: DataFrame, true: str = "label", routed: str = "routed",
                    threshold: float = 240) -> DataFrame:
    """How well predicted routes (0 short, 1 long) match the true class."""
    is_long, to_long = F.col(true) >= threshold, F.col(routed) == 1
    tp, fp, fn, tn = (_n(is_long & to_long), _n(~is_long & to_long), _n(is_long & ~to_long),
                      _n(~is_long & ~to_long))
    accuracy = safe_ratio(tp + tn, tp + fp + fn + tn) * 100
    return df.agg(
        accuracy.alias("classifier_accuracy"),
        (safe_ratio(tp, tp + fp) * 100).alias("classifier_precision_long"),
        (safe_ratio(tp, tp + fn) * 100).alias("classifier_recall_long"),
        safe_ratio(2 * tp, 2 * tp + fp + fn).alias("classifier_f1_long"),
        accuracy.alias("routing_accuracy"),
        (safe_ratio(tp, tp + fn) * 100).alias("long_correctly_routed_pct"),
        (safe_ratio(tn, tn + fp) * 100).alias("short_correctly_routed_pct"),
        (tn + fp).alias("true_short_count"), (tp + fn).alias("true_long_count"),
        (tn + fn).alias("routed_short_count"), (tp + fp).alias("routed_long_count"))


def classification_metrics(df: DataFrame, true: str = "label", pred: str = "prediction") -> DataFrame:
    yes, said = F.col(true) == 1, F.col(pred) == 1
    tp, fp, fn, tn = _n(yes & said), _n(~yes & said), _n(yes & ~said), _n(~yes & ~said)
    total = tp + fp + fn + tn
    return df.agg(
        safe_ratio(tp + tn, total).alias("accuracy"), safe_ratio(tp, tp + fp).alias("precision"),
        safe_ratio(tp, tp + fn).alias("recall"), safe_ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        tn.alias("tn"), fp.alias("fp"), fn.alias("fn"), tp.alias("tp"),
        safe_ratio(tp + fp, total).alias("predicted_positive_rate"),
        safe_ratio(tp + fn, total).alias("positive_rate"))


def _by_score(df: DataFrame, true: str, score: str) -> DataFrame:
    return df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("_score")).agg(
        F.count_if(F.col(true) == 1).alias("pos"), F.count_if(F.col(true) == 0).alias("neg"))


def roc_auc(df: DataFrame, true: str = "label", score: str = "score") -> DataFrame:
    """Chance that a positive outranks a negative, ties counted half."""
    line = running_totals(_by_score(df, true, score), "_score", ["pos", "neg"])
    below = F.col("cum_neg") - F.col("neg")
    wins = F.sum(F.col("pos") * (below + F.col("neg") / 2.0))
    return line.agg((wins / (F.max("all_pos") * F.max("all_neg"))).alias("roc_auc"))


def average_precision(df: DataFrame, true: str = "label", score: str = "score") -> DataFrame:
    """Sum of recall steps times precision over distinct scores, best first."""
    line = running_totals(_by_score(df, true, score), "_score", ["pos", "neg"], descending=True)
    precision = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    return line.agg(F.sum(F.col("pos") / F.col("all_pos") * precision).alias("average_precision"))


# Fixed values: (metric, direction, pass limit, marginal limit).
BANDS = (
    ("mape", "below", 15.0, 25.0),
    ("overall_accuracy", "at_least", 90.0, 70.0),
    ("recall", "at_least", 0.70, 0.50),
    ("average_precision", "at_least", 0.30, 0.15),
)


def status_bands(metrics: DataFrame, metric: str = "metric", value: str = "value") -> DataFrame:
    """PASS / MARGINAL / FAIL for long-form metrics; unknown metrics get null."""
    status = F.lit(None).cast("string")
    v = F.col(value)
    for name, direction, good, fair in BANDS:
        ok, near = (v < good, v < fair) if direction == "below" else (v >= good, v >= fair)
        status = F.when(F.col(metric) == name, F.when(ok, "PASS").when(near, "MARGINAL").otherwise("FAIL")
                        ).otherwise(status)
    return metrics.withColumn("status", status)


def long_metrics(row: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """One metrics row to (metric, value) rows."""
    names = names or row.columns
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names]))
    return row.select(pairs.alias("p")).select("p.*")


def baseline_delta(metrics: DataFrame, baseline: DataFrame) -> DataFrame:
    """Difference to the baseline per metric, both in long form."""
    base = baseline.select("metric", F.col("value").alias("baseline"))
    return metrics.join(base, "metric").withColumn("delta", F.col("value") - F.col("baseline"))


# -- threshold tuning ---------------------------------------------------------------------------

def _threshold_counts(df: DataFrame, true: str, score: str, grid: Sequence[float]) -> DataFrame:
    """tp, fp, fn, tn at every grid value from one aggregate over the rows."""
    steps = F.array(*[F.lit(float(t)) for t in grid])
    passed = F.aggregate(steps, F.lit(0), lambda n, t: n + F.when(F.col(score) >= t, 1).otherwise(0))
    counts = df.select(passed.alias("_passed"), F.col(true).alias("_y")).groupBy("_passed").agg(
        F.count_if(F.col("_y") == 1).alias("_pos"), F.count_if(F.col("_y") == 0).alias("_neg"))
    # ``_passed`` has len(grid) + 1 values, so each group below is that small.
    per_step = counts.agg(F.collect_list(F.struct("_passed", "_pos", "_neg")).alias("_c")).select(
        "_c", F.posexplode(steps).alias("_i", "threshold"))

    def total(part: str, above: bool) -> Column:
        def add(acc: Column, c: Column) -> Column:
            take = (c["_passed"] > F.col("_i")) if above else (c["_passed"] <= F.col("_i"))
            return acc + F.when(take, c[part]).otherwise(0)
        return F.aggregate(F.col("_c"), F.lit(0).cast("long"), add)

    return per_step.select(
        "threshold", total("_pos", True).alias("tp"), total("_neg", True).alias("fp"),
        total("_pos", False).alias("fn"), total("_neg", False).alias("tn"))


F2_GRID = (*(0.05 + i * (0.45 / 19) for i in range(19)), 0.5)
DURATION_GRID = tuple(0.20 + 0.02 * i for i in range(31))
SCOPE_GRID = tuple(0.05 + 0.02 * i for i in range(45))


def threshold_table_f2(df: DataFrame, true: str = "label", score: str = "score",
                       grid: Sequence[float] = F2_GRID) -> DataFrame:
    eps = 1e-9
    precision = F.col("tp") / (F.col("tp") + F.col("fp") + eps)
    recall = F.col("tp") / (F.col("tp") + F.col("fn") + eps)
    return _threshold_counts(df, true, score, grid).withColumn(
        "f2", 5 * (precision * recall) / (4 * precision + recall + eps))


def tune_threshold_f2(df: DataFrame, true: str = "label", score: str = "score",
                      grid: Sequence[float] = F2_GRID) -> DataFrame:
    """The first grid value with the best F2; 0.5 when no value scores above 0."""
    best = threshold_table_f2(df, true, score, grid).where("f2 > 0").agg(
        F.max_by(F.struct("threshold", "f2"), F.struct("f2", -F.col("threshold"))).alias("b"))
    return best.select(F.coalesce("b.threshold", F.lit(0.5)).alias("threshold"),
                       F.coalesce("b.f2", F.lit(0.0)).alias("f2"))


def tune_threshold_balanced(df: DataFrame, true: str = "label", score: str = "score",
                            grid: Sequence[float] = DURATION_GRID) -> DataFrame:
    """The first grid value with the best mean class recall; all-0 and all-1 outcomes do not count."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    table = _threshold_counts(df, true, score, grid).where((tp + fp > 0) & (fn + tn > 0))
    table = table.withColumn("balanced", (safe_ratio(tp, tp + fn) + safe_ratio(tn, tn + fp)) / 2.0)
    best = table.agg(F.max_by(F.struct("threshold", "balanced"),
                              F.struct("balanced", -F.col("threshold"))).alias("b"))
    return best.select(F.coalesce("b.threshold", F.lit(0.5)).alias("threshold"),
                       F.coalesce("b.balanced", F.lit(-1.0)).alias("balanced"))


# -- routing and cascade ------------------------------------------------------------------------

def route_soft(p: str = "p_long", short: str = "short_pred", long: str = "long_pred") -> Column:
    return (1 - F.col(p)) * F.col(short) + F.col(p) * F.col(long)


def route_hard(threshold: float, p: str = "p_long", short: str = "short_pred",
               long: str = "long_pred") -> Column:
    return F.when(F.col(p) >= threshold, F.col(long)).otherwise(F.col(short))


def with_routing(df: DataFrame, threshold: float, soft: bool = False) -> DataFrame:
    return df.withColumns({
        "prediction": route_soft() if soft else route_hard(threshold),
        "routed": (F.col("p_long") >= threshold).cast("int")})


def true_routing(df: DataFrame, threshold: float, true: str = "label", short: str = "short_pred",
                 long: str = "long_pred") -> DataFrame:
    """Prediction taken from the sub-model of the row's true class."""
    return df.withColumn("prediction", F.when(F.col(true) >= threshold, F.col(long)).otherwise(F.col(short)))


def cascade_join(events: DataFrame, occurrence: DataFrame,
                 keys: Sequence[str] = ("fips_code", "year", "month", "day")) -> DataFrame:
    """Events keep their prediction only when their entity-day was predicted; else 0."""
    flags = occurrence.groupBy(*keys).agg(F.max("occ_pred").alias("occ_pred"))
    joined = spread_join(events, flags, keys)
    hit = F.coalesce(F.col("occ_pred") == 1, F.lit(False))
    return joined.withColumns({
        "occ_pred": F.coalesce("occ_pred", F.lit(0)),
        "cascade_prediction": F.when(hit, F.col("prediction")).otherwise(0.0)})


def cascade_summary(joined: DataFrame) -> DataFrame:
    return joined.agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("occ_pred") == 0).alias("missed"))
