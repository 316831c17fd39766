"""Evaluation metrics on fixed formulas standing in for model outputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridpulse.operators import metrics as M
from gridpulse.operators import sessions as S
from gridpulse.plans.bindings import GOOD, LONG_MINUTES, SESS, rounded, sessions
from gridpulse.plans.catalog import query, table


def priced(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") - 2000).alias("label"),
                     ((F.col("l_extendedprice") - 2000) * (1 + F.col("l_discount") - F.col("l_tax"))).alias("prediction"))


PRICED = """priced AS (SELECT l_extendedprice - 2000 AS t, (l_extendedprice - 2000) * (1 + l_discount - l_tax) AS p FROM lineitem)"""


@query("ev1_regression_metrics", f"WITH {PRICED} SELECT round(avg(abs(t - p)), 4) AS mae, round(sqrt(avg((t - p) * (t - p))), 4) AS rmse, "
       "round(avg(CASE WHEN t <> 0 THEN abs((t - p) / t) END) * 100, 4) AS mape FROM priced")
def _(spark, sf):
    return rounded(M.regression_metrics(priced(spark, sf)), 4)


def _tol_sql(cut, short, long):
    s, l = f"t < {cut}", f"t >= {cut}"
    return (f"WITH {PRICED} SELECT round(count(*) FILTER ({s} AND abs(t - p) <= {short}) / count(*) FILTER ({s}) * 100, 6) AS short_outage_accuracy, "
            f"round(count(*) FILTER ({l} AND abs(t - p) <= {long}) / count(*) FILTER ({l}) * 100, 6) AS long_outage_accuracy, "
            f"round(count(*) FILTER (({s} AND abs(t - p) <= {short}) OR ({l} AND abs(t - p) <= {long})) / count(*) * 100, 6) AS overall_accuracy, "
            f"count(*) FILTER ({s}) AS short_outage_count, count(*) FILTER ({l}) AS long_outage_count FROM priced")


@query("ev2_tolerance_accuracy_abs", _tol_sql(20000, 400, 1500))
def _(spark, sf):
    return rounded(M.tolerance_accuracy_abs(priced(spark, sf), short=20000, short_tolerance=400, long_tolerance=1500), 6)


@query("ev3_tolerance_accuracy_rel", _tol_sql(20000, 300, "t * 0.03::DOUBLE"))
def _(spark, sf):
    return rounded(M.tolerance_accuracy_rel(priced(spark, sf), short=20000, short_tolerance=300, share=0.03), 6)


CONF = """conf AS (SELECT count(*) FILTER (y AND s) * 1.0::DOUBLE AS tp, count(*) FILTER (NOT y AND s) * 1.0::DOUBLE AS fp,
  count(*) FILTER (y AND NOT s) * 1.0::DOUBLE AS fn, count(*) FILTER (NOT y AND NOT s) * 1.0::DOUBLE AS tn FROM flags)"""


@query("ev4_routing_metrics", f"WITH {PRICED}, flags AS (SELECT t >= 30000 AS y, p >= 29500 AS s FROM priced), {CONF} SELECT "
       "round((tp + tn) / (tp + fp + fn + tn) * 100, 6) AS classifier_accuracy, round(tp / (tp + fp) * 100, 6) AS classifier_precision_long, "
       "round(tp / (tp + fn) * 100, 6) AS classifier_recall_long, round(2 * tp / (2 * tp + fp + fn), 6) AS classifier_f1_long, "
       "round((tp + tn) / (tp + fp + fn + tn) * 100, 6) AS routing_accuracy, round(tp / (tp + fn) * 100, 6) AS long_correctly_routed_pct, "
       "round(tn / (tn + fp) * 100, 6) AS short_correctly_routed_pct, CAST(tn + fp AS BIGINT) AS true_short_count, CAST(tp + fn AS BIGINT) AS true_long_count, "
       "CAST(tn + fn AS BIGINT) AS routed_short_count, CAST(tp + fp AS BIGINT) AS routed_long_count FROM conf")
def _(spark, sf):
    df = priced(spark, sf).withColumn("routed", (F.col("prediction") >= 29500).cast("int"))
    return rounded(M.routing_metrics(df, threshold=30000), 6)


def quality(spark, sf):
    """Quality labels with a coarse score of the text length, so that many scores tie."""
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    return table(spark, sf, "labels").join(docs, "doc_id").select(
        "doc_id", F.col("quality").alias("label"), F.least(F.floor(F.col("n_chars") / 50) / 100.0, F.lit(1.0)).alias("score"))


QUAL = """qual AS (SELECT doc_id, quality AS y, least(floor(n_chars / 50) / 100.0, 1.0)::DOUBLE AS s FROM labels JOIN documents USING (doc_id))"""


@query("ev5_classification_metrics", f"WITH {QUAL}, flags AS (SELECT y = 1 AS y, s >= 0.1 AS s FROM qual), {CONF} SELECT "
       "round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, "
       "round(2 * tp / (2 * tp + fp + fn), 6) AS f1, CAST(tn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tp AS BIGINT) AS tp, "
       "round((tp + fp) / (tp + fp + fn + tn), 6) AS predicted_positive_rate, round((tp + fn) / (tp + fp + fn + tn), 6) AS positive_rate FROM conf")
def _(spark, sf):
    df = quality(spark, sf).withColumn("prediction", (F.col("score") >= 0.1).cast("int"))
    return rounded(M.classification_metrics(df), 6)


@query("ev6_roc_auc", f"WITH {QUAL}, r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rk FROM qual), "
       "n AS (SELECT sum(y) AS p, count(*) - sum(y) AS q, sum(rk) FILTER (y = 1) AS rs FROM r) SELECT round((rs - p * (p + 1) / 2.0) / (p * q), 8) AS roc_auc FROM n")
def _(spark, sf):
    return rounded(M.roc_auc(quality(spark, sf)), 8)


@query("ev6_roc_auc_many_scores", "WITH x AS (SELECT CAST(event_type = 'error' AS INT) AS y, value AS s FROM events), "
       "r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rk FROM x), "
       "n AS (SELECT sum(y) AS p, count(*) - sum(y) AS q, sum(rk) FILTER (y = 1) AS rs FROM r) SELECT round((rs - p * (p + 1) / 2.0) / (p * q), 8) AS roc_auc FROM n")
def _(spark, sf):
    df = table(spark, sf, "events").select((F.col("event_type") == "error").cast("int").alias("label"), F.col("value").alias("score"))
    return rounded(M.roc_auc(df), 8)


@query("ev7_average_precision", f"WITH {QUAL}, g AS (SELECT s, sum(y) AS pos, count(*) AS n FROM qual GROUP BY s), c AS (SELECT pos, sum(pos) OVER w AS cp, "
       "sum(n) OVER w AS cn, sum(pos) OVER () AS ap FROM g WINDOW w AS (ORDER BY s DESC)) SELECT round(sum(pos / ap * (cp / cn)), 8) AS average_precision FROM c")
def _(spark, sf):
    return rounded(M.average_precision(quality(spark, sf)), 8)


def metric_rows(spark, sf):
    reg = M.long_metrics(M.regression_metrics(priced(spark, sf)))
    tol = M.long_metrics(M.tolerance_accuracy_abs(priced(spark, sf), short=20000, short_tolerance=400, long_tolerance=1500), ["overall_accuracy"])
    ap = M.long_metrics(M.average_precision(quality(spark, sf)))
    return reg.unionByName(tol).unionByName(ap)


_OVERALL = "round(count(*) FILTER ((t < 20000 AND abs(t - p) <= 400) OR (t >= 20000 AND abs(t - p) <= 1500)) / count(*) * 100, 4)"
METRICS = f"""{PRICED}, {QUAL}, g AS (SELECT s, sum(y) AS pos, count(*) AS n FROM qual GROUP BY s), c AS (SELECT pos, sum(pos) OVER w AS cp,
  sum(n) OVER w AS cn, sum(pos) OVER () AS ap FROM g WINDOW w AS (ORDER BY s DESC)),
m AS (SELECT 'mae' AS metric, round(avg(abs(t - p)), 4) AS value FROM priced UNION ALL
  SELECT 'rmse', round(sqrt(avg((t - p) * (t - p))), 4) FROM priced UNION ALL
  SELECT 'mape', round(avg(CASE WHEN t <> 0 THEN abs((t - p) / t) END) * 100, 4) FROM priced UNION ALL
  SELECT 'overall_accuracy', {_OVERALL} FROM priced UNION ALL
  SELECT 'average_precision', round(sum(pos / ap * (cp / cn)), 4) FROM c)"""


@query("ev8_status_bands", f"WITH {METRICS} SELECT metric, value, CASE metric WHEN 'mape' THEN CASE WHEN value < 15 THEN 'PASS' WHEN value < 25 THEN 'MARGINAL' ELSE 'FAIL' END "
       "WHEN 'overall_accuracy' THEN CASE WHEN value >= 90 THEN 'PASS' WHEN value >= 70 THEN 'MARGINAL' ELSE 'FAIL' END "
       "WHEN 'average_precision' THEN CASE WHEN value >= 0.30 THEN 'PASS' WHEN value >= 0.15 THEN 'MARGINAL' ELSE 'FAIL' END END AS status FROM m")
def _(spark, sf):
    return rounded(M.status_bands(metric_rows(spark, sf)), 4)


@query("ev9_baseline_delta", f"WITH {METRICS}, b AS (SELECT 'mae' AS metric, round(avg(abs(t - p * 1.01::DOUBLE)), 4) AS baseline FROM priced UNION ALL "
       "SELECT 'rmse', round(sqrt(avg((t - p * 1.01::DOUBLE) * (t - p * 1.01::DOUBLE))), 4) FROM priced) "
       "SELECT metric, value, baseline, round(value - baseline, 3) AS delta FROM m JOIN b USING (metric)")
def _(spark, sf):
    df = priced(spark, sf)
    worse = df.withColumn("prediction", F.col("prediction") * 1.01)
    now = M.long_metrics(M.regression_metrics(df), ["mae", "rmse"]).withColumn("value", F.round("value", 4))
    then = M.long_metrics(M.regression_metrics(worse), ["mae", "rmse"]).withColumn("value", F.round("value", 4))
    return M.baseline_delta(now, then).withColumn("delta", F.round("delta", 3))


# -- thresholds ---------------------------------------------------------------------------------

_GRID = "grid AS (SELECT unnest([{values}])::DOUBLE AS t)"
_COUNTS = """cnt AS (SELECT t, count(*) FILTER (y = 1 AND s >= t) * 1.0::DOUBLE AS tp, count(*) FILTER (y = 0 AND s >= t) * 1.0::DOUBLE AS fp,
  count(*) FILTER (y = 1 AND s < t) * 1.0::DOUBLE AS fn, count(*) FILTER (y = 0 AND s < t) * 1.0::DOUBLE AS tn FROM grid, {src} GROUP BY t)"""
EVS = "evs AS (SELECT CAST(event_type = 'error' OR value > 200 AS INT) AS y, (value / 490.0)::DOUBLE AS s FROM events)"


def event_scores(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").select(((F.col("event_type") == "error") | (v > 200)).cast("int").alias("label"), (v / 490.0).alias("score"))


def _grid(values):
    return _GRID.format(values=", ".join(repr(float(v)) for v in values))


@query("ml8_tune_threshold_f2", f"WITH {EVS}, {_grid(M.F2_GRID)}, {_COUNTS.format(src='evs')}, f AS (SELECT t, 5 * (p * r) / (4 * p + r + 1e-9) AS f2 "
       "FROM (SELECT t, tp / (tp + fp + 1e-9) AS p, tp / (tp + fn + 1e-9) AS r FROM cnt)) SELECT t AS threshold, round(f2, 8) AS f2 FROM f ORDER BY f2 DESC, t LIMIT 1")
def _(spark, sf):
    return M.tune_threshold_f2(event_scores(spark, sf)).withColumn("f2", F.round("f2", 8))


def _balanced_sql(grid):
    return (f"WITH {EVS}, {_grid(grid)}, {_COUNTS.format(src='evs')}, f AS (SELECT t, (tp / (tp + fn) + tn / (tn + fp)) / 2 AS b FROM cnt "
            "WHERE tp + fp > 0 AND fn + tn > 0) SELECT t AS threshold, round(b, 8) AS balanced FROM f ORDER BY b DESC, t LIMIT 1")


@query("ml9_tune_threshold_balanced", _balanced_sql(M.DURATION_GRID))
def _(spark, sf):
    return M.tune_threshold_balanced(event_scores(spark, sf)).withColumn("balanced", F.round("balanced", 8))


@query("ml9_tune_threshold_balanced_scope", _balanced_sql(M.SCOPE_GRID))
def _(spark, sf):
    return M.tune_threshold_balanced(event_scores(spark, sf), grid=M.SCOPE_GRID).withColumn("balanced", F.round("balanced", 8))


# -- routing and cascade on given scores --------------------------------------------------------

def routed(spark, sf):
    good = S.valid_durations(sessions(spark, sf))
    d = F.col("duration_minutes")
    return good.select("fips_code", "start_time", d.alias("label"), (d * 0.9).alias("short_pred"), (d * 0.8).alias("long_pred"),
                       (F.least(d, F.lit(3000.0)) / 3000.0).alias("p_long"))


ROUTED = f"""{SESS}, {GOOD}, routed AS (SELECT fips_code, start_time, duration_minutes AS t, duration_minutes * 0.9::DOUBLE AS sp,
  duration_minutes * 0.8::DOUBLE AS lp, least(duration_minutes, 3000.0::DOUBLE) / 3000.0::DOUBLE AS pl FROM good)"""


@query("ml4_predict_soft", f"WITH {ROUTED} SELECT fips_code, start_time, round((1 - pl) * sp + pl * lp, 9) AS prediction FROM routed")
def _(spark, sf):
    return rounded(routed(spark, sf).select("fips_code", "start_time", M.route_soft().alias("prediction")))


@query("ml5_predict_with_routing", f"WITH {ROUTED} SELECT fips_code, start_time, round(CASE WHEN pl >= 0.24 THEN lp ELSE sp END, 9) AS prediction, CAST(pl >= 0.24 AS INT) AS routed FROM routed")
def _(spark, sf):
    return rounded(M.with_routing(routed(spark, sf), 0.24).select("fips_code", "start_time", "prediction", "routed"))


@query("ml3_predict_hard", f"WITH {ROUTED} SELECT fips_code, start_time, round(CASE WHEN pl >= 0.3 THEN lp ELSE sp END, 9) AS prediction FROM routed")
def _(spark, sf):
    return rounded(routed(spark, sf).select("fips_code", "start_time", M.route_hard(0.3).alias("prediction")))


@query("ev10_true_routing_evaluation", f"WITH {ROUTED}, z AS (SELECT t, CASE WHEN t >= {LONG_MINUTES} THEN lp ELSE sp END AS p FROM routed) "
       "SELECT round(avg(abs(t - p)), 6) AS mae, round(sqrt(avg((t - p) * (t - p))), 6) AS rmse, round(avg(abs((t - p) / t)) * 100, 6) AS mape FROM z")
def _(spark, sf):
    return rounded(M.regression_metrics(M.true_routing(routed(spark, sf), LONG_MINUTES)), 6)


CASC = f"""{ROUTED}, occ AS (SELECT fips_code, CAST(ts AS DATE) + 1 AS date, max(CAST(e.value > 120 AS INT)) AS op FROM
  (SELECT *, lpad(CAST(user_id AS VARCHAR), 5, '0') AS fips_code FROM events) e GROUP BY 1, 2),
casc AS (SELECT routed.fips_code, start_time, t, CASE WHEN op = 1 THEN sp ELSE 0 END AS p, coalesce(op, 0) AS op FROM routed LEFT JOIN occ
  ON occ.fips_code = routed.fips_code AND occ.date = CAST(start_time AS DATE))"""


def cascade(spark, sf):
    from gridpulse.functions.columns import zfill
    from gridpulse.operators.features import temporal_features
    # What the day before predicted: a day after one without events has no prediction.
    e = temporal_features(table(spark, sf, "events").withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 DAY")), "ts")
    occ = e.select(zfill("user_id", 5).alias("fips_code"), "year", "month", "day", (F.col("value") > 120).cast("int").alias("occ_pred"))
    ev = temporal_features(routed(spark, sf).withColumn("prediction", F.col("short_pred")), "start_time")
    return M.cascade_join(ev, occ)


@query("jn10_cascade_join", f"WITH {CASC} SELECT fips_code, start_time, round(p, 9) AS cascade_prediction, op AS occ_pred FROM casc")
def _(spark, sf):
    return rounded(cascade(spark, sf).select("fips_code", "start_time", "cascade_prediction", "occ_pred"))


@query("jn10_missed_events", f"WITH {CASC} SELECT count(*) AS events, count(*) FILTER (op = 0) AS missed FROM casc")
def _(spark, sf):
    return M.cascade_summary(cascade(spark, sf))


@query("ev11_cascade_evaluation", f"WITH {CASC} SELECT round(avg(abs(t - p)), 6) AS mae, round(sqrt(avg((t - p) * (t - p))), 6) AS rmse, round(avg(abs((t - p) / t)) * 100, 6) AS mape FROM casc")
def _(spark, sf):
    return rounded(M.regression_metrics(cascade(spark, sf), pred="cascade_prediction"), 6)
