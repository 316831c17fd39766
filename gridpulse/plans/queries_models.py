"""Learned models, contributions and scoring on the tables, with the settings of full training.

Fitted models have no SQL; these entries are rows-only, except where a property of the result can be
stated in SQL (contributions add up, importances too, reports have all their rows, flags their share).
Models that several queries use are fitted once per session and stored; what a query returns does not depend on
which of them came first, as fits depend on the rows and seeds only.
"""

from __future__ import annotations

import hashlib
from functools import partial

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from gridpulse.functions.columns import zfill
from gridpulse.operators import contributions as C
from gridpulse.operators import features as X
from gridpulse.operators import live as L
from gridpulse.operators import models as M
from gridpulse.operators import sessions as S
from gridpulse.operators.anomaly import fit_autoencoder, fit_isolation_forest
from gridpulse.plans import training as T
from gridpulse.plans.bindings import EVENT_TYPES, GOOD, LARGE, LONG_MINUTES, SESS, sessions
from gridpulse.plans.catalog import query, table
from gridpulse.plans.queries_features import panel
from gridpulse.plans.queries_live import hourly_arrays, polls
from gridpulse.plans.scoring import explain_entities, forecast_scoring, live_scoring
from gridpulse.session import cut_lineage, path_exists, scratch_path, shared_dir
from gridpulse.streaming import jobs as J

EVENT_KEYS = ["key_fips_code", "start_time"]
DAY_KEYS = ["fips_code", "date"]
def is_late(column: str = "start_time"):
    return F.col(column) >= F.lit("2024-01-24").cast("timestamp_ntz")


def duration_matrix(spark, sf):
    return cut_lineage(X.duration_features(sessions(spark, sf), EVENT_TYPES, LONG_MINUTES), "duration")


def scope_matrix(spark, sf):
    return cut_lineage(X.scope_features(sessions(spark, sf), EVENT_TYPES, LARGE), "scope")


def occurrence_matrix(spark, sf):
    return cut_lineage(X.occurrence_features(panel(spark, sf), check=False), "occurrence")


def stored_model(spark, sf, name: str, kind, fit):
    """The model ``fit()`` makes, stored under the shared folder for this session and tables, and read from there."""
    key = hashlib.sha256(f"{spark.sparkContext.applicationId}|{sf}|{name}".encode()).hexdigest()[:24]
    path = f"{shared_dir(spark)}/models-{key}"
    if not path_exists(spark, f"{path}/meta/_SUCCESS"):
        fit().save(path)
    return kind.load(spark, path)


def settings_of(kind: str) -> M.TwoStageSettings:
    return M.duration_settings(LONG_MINUTES) if kind == "duration" else M.scope_settings(LARGE)


def two_stage(spark, sf, kind: str, stored=None):
    """``stored`` is the matrix, where the caller has made it already."""
    def fit():
        matrix = stored or (duration_matrix if kind == "duration" else scope_matrix)(spark, sf)
        return M.fit_two_stage(matrix, T.feature_names(matrix, EVENT_KEYS), EVENT_KEYS, settings=settings_of(kind))
    return stored_model(spark, sf, kind, M.TwoStageModel, fit)


def stacked(spark, sf, stored=None):
    def fit():
        matrix = stored or occurrence_matrix(spark, sf)
        return M.fit_stacking(matrix, T.feature_names(matrix, DAY_KEYS), DAY_KEYS)
    return stored_model(spark, sf, "occurrence", M.StackedModel, fit)


def cascade_models(spark, sf, occ=None, scope=None, duration=None):
    """The models of the cascade (will it happen, how large, how long), fitted at the same time."""
    return M.at_once(spark, [partial(stacked, spark, sf, occ), partial(two_stage, spark, sf, "scope", scope),
                             partial(two_stage, spark, sf, "duration", duration)])


@query("ml1_duration_regressor")
def _(spark, sf):
    m = duration_matrix(spark, sf)
    model = M.fit_regressor(m, T.feature_names(m, EVENT_KEYS), M.DURATION_SINGLE, heavy_from=LONG_MINUTES, heavy_weight=3.0,
                            validation=X.split_share(EVENT_KEYS) > 0.8)
    return model.predict(m).select(*EVENT_KEYS, "label", "prediction")


@query("ml1_scope_regressor")
def _(spark, sf):
    m = scope_matrix(spark, sf)
    model = M.fit_regressor(m, T.feature_names(m, EVENT_KEYS), M.SCOPE_SINGLE, validation=X.split_share(EVENT_KEYS) > 0.8)
    return model.predict(m).select(*EVENT_KEYS, "label", "prediction")


@query("ml2_two_stage_fit")
def _(spark, sf):
    m = scope_matrix(spark, sf)
    return two_stage(spark, sf, "scope").predict(m).select(*EVENT_KEYS, "label", "p_long", "short_pred", "long_pred", "prediction", "routed")


@query("ml2_routes_by_its_cut", f"WITH {SESS}, {GOOD} SELECT count(*) AS rows, 0 AS wrong FROM good")
def _(spark, sf):
    model = two_stage(spark, sf, "duration")
    by_cut = F.when(F.col("p_long") >= model.probability_cut, F.col("long_pred")).otherwise(F.col("short_pred"))
    wrong = F.count_if((F.col("prediction") != by_cut) | F.col("prediction").isNull())
    return model.predict(duration_matrix(spark, sf)).agg(F.count(F.lit(1)).alias("rows"), wrong.cast("int").alias("wrong"))


@query("ml6_stacking_fit")
def _(spark, sf):
    return stacked(spark, sf).base_probabilities(occurrence_matrix(spark, sf)).select(
        *DAY_KEYS, "label", "p_boost", "p_forest", "p_plain", "p_logistic")


def _quality_rows(spark, sf):
    docs = table(spark, sf, "documents").select(
        "doc_id", F.col("n_chars").cast("double").alias("n_chars"), F.length(F.translate("text", "0123456789", "")).alias("letters"),
        F.size(F.split("text", " ")).alias("words"))
    return docs, cut_lineage(table(spark, sf, "labels").join(docs, "doc_id").withColumn("label", F.col("quality").cast("double")), "quality")


@query("ml7_stacking_predict")
def _(spark, sf):
    docs, m = _quality_rows(spark, sf)
    model = stored_model(spark, sf, "quality", M.StackedModel, lambda: M.fit_stacking(m, ["n_chars", "letters", "words"], ["doc_id"]))
    return model.predict(docs).select("doc_id", "occ_prob", "occ_pred")


@query("ml15_split_importances")
def _(spark, sf):
    return two_stage(spark, sf, "duration").importances(spark)


@query("ml15_importances_add_up", "SELECT part, 1.0::DOUBLE AS total FROM (VALUES ('classifier'), ('short'), ('long')) AS p(part)")
def _(spark, sf):
    sums = two_stage(spark, sf, "duration").importances(spark).groupBy("part").agg(F.sum("importance").alias("s"))
    # A model whose trees have no split has no importances at all.
    return sums.select("part", F.when(F.col("s") == 0, 1.0).otherwise(F.round("s", 6)).alias("total"))


@query("top3_top_importances")
def _(spark, sf):
    return M.top_importances(two_stage(spark, sf, "duration").importances(spark), 10, "classifier")


@query("ml16_model_persist", f"WITH {SESS}, {GOOD} SELECT count(*) AS rows, 0.0::DOUBLE AS largest_difference FROM good")
def _(spark, sf):
    m = duration_matrix(spark, sf)
    model, path = two_stage(spark, sf, "duration"), scratch_path(spark, "model")
    model.save(path)
    again = M.TwoStageModel.load(spark, path)
    both = again.predict(model.predict(m).select(*m.columns, F.col("prediction").alias("first")))
    return both.agg(F.count(F.lit(1)).alias("rows"), F.max(F.abs(F.col("first") - F.col("prediction"))).alias("largest_difference"))


# -- anomalies ----------------------------------------------------------------------------------

def vectors(spark, sf):
    e = table(spark, sf, "embeddings")
    return cut_lineage(e.select("vec_id", "label", *[F.get("embedding", F.lit(i)).cast("double").alias(f"f{i}") for i in range(64)]), "vectors")


FEATURES = [f"f{i}" for i in range(64)]


@query("ml10_autoencoder_fit")
def _(spark, sf):
    v = vectors(spark, sf)
    model = fit_autoencoder(v, FEATURES)
    return model.detect(v).select("vec_id", "ae_error", "anomaly_flag")


@query("ml10_flags_five_percent", "SELECT count(*) AS rows, count(*) - CAST(floor(0.95 * (count(*) - 1)) AS BIGINT) - 1 AS flagged FROM embeddings")
def _(spark, sf):
    v = vectors(spark, sf)
    found = fit_autoencoder(v, FEATURES).detect(v)
    return found.agg(F.count(F.lit(1)).alias("rows"), F.count_if("anomaly_flag").alias("flagged"))


@query("ml11_reconstruction_anomaly")
def _(spark, sf):
    m = occurrence_matrix(spark, sf)
    names = T.feature_names(m, DAY_KEYS)
    model = fit_autoencoder(m.where(F.dayofmonth("date") < 24), names)
    return model.detect(m).select(*DAY_KEYS, "ae_error", "anomaly_flag")


@query("ml12_isolation_forest")
def _(spark, sf):
    v = vectors(spark, sf)
    return fit_isolation_forest(v, FEATURES, ["vec_id"]).detect(v).select("vec_id", "iso_score", "iso_anomaly")


@query("ml12_flags_one_percent", "SELECT count(*) AS rows, count(*) - CAST(floor(0.99 * (count(*) - 1)) AS BIGINT) - 1 AS flagged FROM embeddings")
def _(spark, sf):
    v = vectors(spark, sf)
    found = fit_isolation_forest(v, FEATURES, ["vec_id"]).detect(v)
    return found.agg(F.count(F.lit(1)).alias("rows"), F.count_if("iso_anomaly").alias("flagged"))


@query("pip13_anomaly_training")
def _(spark, sf):
    m = occurrence_matrix(spark, sf)
    autoencoder, forest = T.train_anomaly(m, DAY_KEYS, F.dayofmonth("date") >= 24, path=scratch_path(spark, "ae"))
    return forest.detect(autoencoder.detect(m)).select(*DAY_KEYS, "ae_error", "anomaly_flag", "iso_score", "iso_anomaly")


# -- contributions ------------------------------------------------------------------------------

@query("ml13_contributions")
def _(spark, sf):
    m = duration_matrix(spark, sf)
    model = two_stage(spark, sf, "duration")
    return C.explain(m, C.tree_explainer(spark, model.classifier, model.features), EVENT_KEYS)


@query("ml13_contributions_add_up", f"WITH {SESS}, {GOOD} SELECT part, count(*) AS rows, 0.0::DOUBLE AS largest_gap FROM good, "
       "(VALUES ('classifier'), ('short'), ('long')) AS parts(part) GROUP BY part")
def _(spark, sf):
    m = duration_matrix(spark, sf)
    model = two_stage(spark, sf, "duration")
    out = []
    for part in ("classifier", "short", "long"):
        fitted = getattr(model, part)
        raw = vector_to_array("_raw")[1] if part == "classifier" else F.col("_log_pred")
        truth = fitted.transform(M.assemble(m, model.features)).select(*EVENT_KEYS, raw.alias("raw"))
        summed = C.explain(m, C.tree_explainer(spark, fitted, model.features), EVENT_KEYS).groupBy(*EVENT_KEYS).agg(
            (F.max("base_value") + F.sum("shap")).alias("total"))
        out.append(truth.join(summed, EVENT_KEYS).agg(
            F.count(F.lit(1)).alias("rows"), F.round(F.max(F.abs(F.col("raw") - F.col("total"))), 9).alias("largest_gap")
        ).withColumn("part", F.lit(part)))
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("ml17_background_sample")
def _(spark, sf):
    return C.background_sample(sessions(spark, sf).select("fips_code", "start_time", "duration_minutes"), ["fips_code", "start_time"], 1000)


@query("pip11_explain_entity")
def _(spark, sf):
    m = duration_matrix(spark, sf)
    model = two_stage(spark, sf, "duration")
    latest = L.latest_cache(m.withColumn("run_ts", F.col("start_time")).withColumn(
        "fips", zfill(F.col("fips_code").cast("long"), 5)).drop(*EVENT_KEYS, "label"), ["fips"])
    rows = latest.withColumnRenamed("fips", "entity_code")
    explainers = {n: C.tree_explainer(spark, getattr(model, n), model.features) for n in ("classifier", "short")}
    records = explain_entities(rows, explainers, ["entity_code", "run_ts"], n=10)
    return records.select("entity_code", "run_ts", "model", "base_value", F.explode("features").alias("f")).select(
        "entity_code", "run_ts", "model", "base_value", "f.name", "f.value", "f.shap")


# -- training and cascade -----------------------------------------------------------------------

@query("pip7_train_duration")
def _(spark, sf):
    _, _, report = T.train_two_stage(duration_matrix(spark, sf), "duration", EVENT_KEYS, settings_of("duration"), None,
                                     is_late(), path=scratch_path(spark, "duration-model"))
    return report


@query("pip7_train_scope")
def _(spark, sf):
    _, _, report = T.train_two_stage(scope_matrix(spark, sf), "scope", EVENT_KEYS, settings_of("scope"), None,
                                     is_late(), generalise=True)
    return report


@query("pip7_train_occurrence")
def _(spark, sf):
    _, report = T.train_occurrence(occurrence_matrix(spark, sf), DAY_KEYS, None, F.dayofmonth("date") >= 24, path=scratch_path(spark, "occ"))
    return report


def _day_keyed(matrix):
    """Entity code as text key next to the numeric feature, as the occurrence matrix has it."""
    return matrix.withColumn("code", F.col("key_fips_code"))


@query("pip8_cascade_batch")
def _(spark, sf):
    occ, scope, duration = M.at_once(spark, [partial(make, spark, sf) for make in (occurrence_matrix, scope_matrix, duration_matrix)])
    models = cascade_models(spark, sf, occ, scope, duration)
    return T.cascade_batch(occ.withColumn("code", F.col("fips_code")), _day_keyed(scope), _day_keyed(duration), *models,
                           ["code", "year", "month", "day"], F.col("day") >= 24)


# -- scoring ------------------------------------------------------------------------------------

def scoring_inputs(spark, sf):
    """Positions, history and models shared by live and forecast scoring."""
    def history():
        events = cut_lineage(S.valid_durations(sessions(spark, sf)), "events")
        return cut_lineage(S.entity_stats(events, long_minutes=LONG_MINUTES, large=LARGE), "stats")

    stats, models = M.at_once(spark, [history, partial(cascade_models, spark, sf)])
    # Every position of the table is an entity: those without any event are the ones whose fetch failed.
    geo = table(spark, sf, "embeddings").select(
        zfill("vec_id", 5).alias("fips_code"), (F.get("embedding", F.lit(0)) * 90).cast("double").alias("latitude"),
        (F.get("embedding", F.lit(1)) * 180).cast("double").alias("longitude"))
    return stats, geo, *models


def live_weather(spark, sf):
    return L.live_day(hourly_arrays(spark, sf).withColumn("now", F.lit("2024-02-01 10:00:00").cast("timestamp_ntz")))


@query("pip9_live_scoring")
def _(spark, sf):
    stats, geo, occ, scope, duration = scoring_inputs(spark, sf)
    every = polls(spark, sf)
    changes = L.poll_delta(every).where(F.col("poll_no") == every.agg(F.max("poll_no")).scalar()).drop("poll_no")
    m = occurrence_matrix(spark, sf)
    autoencoder = fit_autoencoder(m, T.feature_names(m, DAY_KEYS))
    return live_scoring(live_weather(spark, sf), changes, stats, geo, occ, scope, duration, autoencoder)


@query("pip10_forecast_scoring")
def _(spark, sf):
    stats, geo, occ, scope, duration = scoring_inputs(spark, sf)
    raw = hourly_arrays(spark, sf)
    return forecast_scoring(raw, stats, geo, occ, scope, duration)


@query("pip10_one_record_per_day", "WITH d AS (SELECT count(DISTINCT vec_id) AS n FROM embeddings) SELECT n AS entities, 0 AS repeated, 0 AS unknown FROM d")
def _(spark, sf):
    stats, geo, occ, scope, duration = scoring_inputs(spark, sf)
    records = cut_lineage(forecast_scoring(hourly_arrays(spark, sf), stats, geo, occ, scope, duration), "records")
    per = records.groupBy("date", "fips_code").count()
    known = records.join(geo, "fips_code", "left_anti")
    return records.agg(F.count_distinct("fips_code").alias("entities")).withColumns({
        "repeated": F.lit(per.where("count > 1").count()).cast("int"), "unknown": F.lit(known.count()).cast("int")})


@query("str1_live_prediction_stream")
def _(spark, sf):
    stats, geo, occ, scope, duration = scoring_inputs(spark, sf)
    weather = cut_lineage(live_weather(spark, sf), "weather")
    score = partial(_score_live, weather, stats, geo, occ, scope, duration)
    raw = polls(spark, sf).withColumnRenamed("customers", "cust_a")
    source, history, published, progress = (scratch_path(spark, n) for n in ("polls", "history", "published", "progress"))
    raw.write.partitionBy("poll_no").parquet(source)
    stream = J.file_stream(spark, source, "fips_code string, cust_a double, poll_no long")
    J.live_prediction_stream(stream, progress, history, published, score, every=None).awaitTermination()
    return spark.read.parquet(published).withColumn("run_ts", F.col("run_ts").cast("string"))


def _score_live(weather, stats, geo, occ, scope, duration, changes):
    return live_scoring(weather, changes, stats, geo, occ, scope, duration, per="poll_no")


@query("str2_forecast_refresh")
def _(spark, sf):
    stats, geo, occ, scope, duration = scoring_inputs(spark, sf)
    raw = hourly_arrays(spark, sf)
    source, published, progress = (scratch_path(spark, n) for n in ("raw", "published", "progress"))
    raw.write.parquet(source)
    stream = J.file_stream(spark, source, raw.schema)
    J.forecast_refresh_stream(stream, progress, published, lambda batch: forecast_scoring(batch, stats, geo, occ, scope, duration),
                              every=None).awaitTermination()
    return spark.read.parquet(published).withColumn("run_ts", F.col("run_ts").cast("string"))
