"""Learned parts: additivity, persistence, convergence, deep paths."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from gridpulse.operators import anomaly as A
from gridpulse.operators import contributions as C
from gridpulse.operators import models as M


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 3))
    y = np.exp(1.0 + x[:, 0] + 0.5 * (x[:, 1] > 0)) * 100
    data = [(i, float(a), float(b), float(c), float(t)) for i, ((a, b, c), t) in enumerate(zip(x, y))]
    return spark.createDataFrame(data, "id long, `f one` double, b double, c double, label double").cache()


NAMES = ["f one", "b", "c"]


def brute_leaf(value, shares, match):
    """Average over all orders of joining, the textbook definition."""
    from itertools import permutations
    k, out = len(shares), np.zeros(len(shares))
    orders = list(permutations(range(k)))
    for order in orders:
        known = set()
        def worth():
            return value * np.prod([match[j] if j in known else shares[j] for j in range(k)])
        for i in order:
            before = worth()
            known.add(i)
            out[i] += worth() - before
    return out / len(orders)


def test_leaf_values_match_all_orders():
    rng = np.random.default_rng(2)
    shares = rng.uniform(0.1, 0.9, 4)
    patterns = ((np.arange(16)[:, None] >> np.arange(4)) & 1).astype(float)
    got = C._leaf_values(2.5, shares, patterns)
    for p, g in zip(patterns, got):
        assert g == pytest.approx(brute_leaf(2.5, shares, p))


def test_long_paths_equal_tabulated_ones():
    rng = np.random.default_rng(3)
    path = {i: (-1.0, 1.0, float(s)) for i, s in enumerate(rng.uniform(0.2, 0.9, 6))}
    tabled = C._game(1.5, path)
    plain = C.LeafGame(tabled.features, tabled.low, tabled.high, tabled.value, tabled.shares, None)
    x = rng.normal(size=(50, 6)) * 2
    assert tabled.contributions(x) == pytest.approx(plain.contributions(x))


def test_two_stage_routes_and_adds_up(spark, rows, tmp_path):
    settings = M.duration_settings(300.0).with_rounds(4, 3)
    model = M.fit_two_stage(rows, NAMES, ["id"], settings=settings)
    scored = model.predict(rows).collect()
    for r in scored:
        assert r.prediction == (r.long_pred if r.p_long >= model.probability_cut else r.short_pred)
    model.save(str(tmp_path / "m"))
    again = M.TwoStageModel.load(spark, str(tmp_path / "m"))
    assert (again.features, again.threshold, again.probability_cut) == (NAMES, 300.0, model.probability_cut)
    total = C.explain(rows, C.tree_explainer(spark, model.short, NAMES), ["id"]).groupBy("id").agg(
        (F.max("base_value") + F.sum("shap")).alias("s"))
    raw = model.short.transform(M.assemble(rows, NAMES)).select("id", "_log_pred")
    assert total.join(raw, "id").agg(F.max(F.abs(F.col("s") - F.col("_log_pred")))).first()[0] < 1e-9


def test_single_regressor_beats_the_mean(rows):
    model = M.fit_regressor(rows, NAMES, M.BoostSettings(15, 3, 0.3))
    r = model.predict(rows).agg(F.avg(F.abs(F.col("label") - F.col("prediction"))).alias("model"),
                                F.avg(F.abs(F.col("label") - 350)).alias("flat")).first()
    assert r.model < 0.5 * r.flat


def test_linear_contributions_add_up(spark, rows):
    data = M.assemble(rows.withColumn("y", (F.col("label") > 300).cast("double")), NAMES)
    model = LogisticRegression(featuresCol=M.VECTOR, labelCol="y", rawPredictionCol="_raw").fit(data)
    total = C.linear_contributions(rows, model, NAMES, ["id"]).groupBy("id").agg((F.max("base_value") + F.sum("shap")).alias("s"))
    raw = model.transform(data).select("id", vector_to_array("_raw")[1].alias("r"))
    assert total.join(raw, "id").agg(F.max(F.abs(F.col("s") - F.col("r")))).first()[0] < 1e-9


def test_autoencoder_gradient_matches_differences():
    rng = np.random.default_rng(4)
    weights, x = A._initial_weights(3, 1), rng.normal(size=(5, 3))
    grads, _ = A._gradient(x, weights)
    for part in (0, 4, 11):
        at = tuple(0 for _ in weights[part].shape)
        step = [w.copy() for w in weights]
        step[part][at] += 1e-6
        assert (A._gradient(x, step)[1] - A._gradient(x, weights)[1]) / 1e-6 == pytest.approx(grads[part][at], rel=1e-3, abs=1e-5)


def test_autoencoder_learns_and_flags_five_percent(spark, rows, tmp_path):
    short, longer = (A.fit_autoencoder(rows, NAMES, epochs=e, rate=1e-2) for e in (1, 25))
    mean = lambda m: m.errors(rows).agg(F.avg("ae_error")).first()[0]
    assert mean(longer) < mean(short)
    flagged = longer.detect(rows).agg(F.avg(F.col("anomaly_flag").cast("int"))).first()[0]
    assert flagged == pytest.approx(0.05, abs=0.01)
    longer.save(spark, str(tmp_path / "ae"))
    assert mean(A.Autoencoder.load(spark, str(tmp_path / "ae"))) == pytest.approx(mean(longer))


def test_isolation_forest_finds_the_outlier(spark, rows):
    odd = spark.createDataFrame([(10_000, 30.0, -30.0, 30.0, 1.0)], rows.schema)
    forest = A.fit_isolation_forest(rows.unionAll(odd), NAMES, ["id"], trees=25)
    top = forest.scores(rows.unionAll(odd)).orderBy(F.desc("iso_score")).first()
    assert top.id == 10_000 and top.iso_score > 0.6


def test_anomaly_models_know_only_the_training_period_and_are_the_stored_ones(spark, rows, tmp_path):
    from gridpulse.plans import training as T
    late = F.col("id") >= 400
    odd = rows.withColumns({c: F.when(late, F.col(f"`{c}`") * 50).otherwise(F.col(f"`{c}`")) for c in ("b", "c")})
    found = [T.train_anomaly(df, ["id"], late, epochs=2, trees=5, path=str(tmp_path / str(i))) for i, df in enumerate((rows, odd))]
    (ae, forest), (ae_odd, forest_odd) = found
    assert forest.trees == forest_odd.trees and forest.threshold == forest_odd.threshold and ae.threshold == ae_odd.threshold
    again = A.IsolationForest.load(spark, str(tmp_path / "0" / "forest"))
    assert again == forest and len(forest.trees) == 5 and forest.features == NAMES
    assert A.Autoencoder.load(spark, str(tmp_path / "0" / "autoencoder")).threshold == ae.threshold
    assert forest.detect(odd).where("iso_anomaly").where(late).count() > 50


def test_folds_hold_every_class(spark):
    rows = spark.range(400).selectExpr("id", "cast(id % 40 = 0 as double) AS y", "pmod(xxhash64(id), 1000003) / 1000003.0D AS u")
    counts = {(r.y, r._fold): r["count"] for r in M.stratified_folds(rows, "y", "u", 5).groupBy("y", "_fold").count().collect()}
    assert all(counts[1.0, k] == 2 for k in range(5)) and all(counts[0.0, k] == 78 for k in range(5))


def test_boosting_stops_early(spark, rows):
    settings = M.duration_settings(60.0).with_rounds(40, 2)
    model = M.fit_two_stage(rows, NAMES, ["id"], settings=settings)
    assert min(m.getNumTrees for m in (model.classifier, model.short, model.long)) < 40


def test_an_ensemble_in_many_files_is_explained_the_same(spark, rows, monkeypatch):
    model = M.fit_regressor(rows, NAMES, M.BoostSettings(12, 4, 0.3)).model
    raw = model.transform(M.assemble(rows, NAMES)).select("id", "_log_pred")
    for per_file in (2000, 20):            # beyond HELD_FILES files, tasks read them one after another
        monkeypatch.setattr(C, "FILE_LEAVES", per_file)
        explainer = C.tree_explainer(spark, model, NAMES)
        total = C.explain(rows, explainer, ["id"]).groupBy("id").agg((F.max("base_value") + F.sum("shap")).alias("s"))
        assert total.join(raw, "id").agg(F.max(F.abs(F.col("s") - F.col("_log_pred")))).first()[0] < 1e-9


def test_many_categories_become_one_sparse_column(spark):
    from gridpulse.operators import features as X
    df = spark.range(3000).selectExpr("id", "concat('c', id % 1000) AS event_type").unionByName(
        spark.createDataFrame([(5000, None), (5001, "unseen")], "id long, event_type string"))
    known = X.category_index(df.where("event_type IS NULL OR event_type <> 'unseen'"), "event_type")
    assert known.agg(F.max("index"), F.sum("rows")).first()[:] == (1000, 3001)
    found = {r.id: r.event_vector for r in X.one_hot_vector(df, known).collect()}
    order = sorted(["None", *[f"c{i}" for i in range(1000)]])
    assert all(v.size == 1002 and len(v.indices) == 1 for v in found.values())
    assert all(found[i].indices[0] == order.index(f"c{i % 1000}") for i in range(3000))
    assert found[5000].indices[0] == order.index("None") and found[5001].indices[0] == 1001


@pytest.fixture(scope="module")
def checkered(spark):
    """Class 1 where two features have the same sign, one row in ten flipped; every row twice."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(1500, 4))
    y = ((x[:, 0] > 0) == (x[:, 1] > 0)) ^ (rng.random(1500) < 0.1)
    data = [(i, *map(float, r), float(t), float(1 + 2 * t)) for i, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(data + data, "id long, a double, b double, c double, d double, _y double, _w double")
    return M.assemble(df, ["a", "b", "c", "d"]).cache()


@pytest.mark.parametrize("local", [1 << 16, 300])
def test_forest_learns_in_one_or_many_tasks(spark, checkered, tmp_path, monkeypatch, local):
    from gridpulse.operators import forest as R
    monkeypatch.setattr(R, "LOCAL_ROWS", local)        # at 300 the upper levels are summed over all blocks
    train, rest = checkered.where("id < 1000"), checkered.where("id >= 1000")
    model = R.fit_forest(train, M.VECTOR, "_y", "_w", R.ForestSettings(20, 8, 3, 1))
    right = (F.col("p") >= 0.5) == (F.col("_y") == 1)
    assert model.probability(rest, M.VECTOR, "p").agg(F.avg(right.cast("int"))).first()[0] > 0.75
    trees = spark.read.schema(R.NODES).parquet(model.folder).collect()
    assert sorted(t.tree for t in trees) == list(range(20))
    assert all((np.array(t.left) >= 0).any() and 0 <= min(t.share) <= max(t.share) <= 1 for t in trees)
    model.save(str(tmp_path / "f"))
    both = R.Forest.load(str(tmp_path / "f")).probability(model.probability(rest, M.VECTOR, "p"), M.VECTOR, "q")
    assert both.where("p <> q OR q IS NULL").isEmpty()


@pytest.mark.parametrize("local", [1 << 16, 300])
def test_tasks_that_hold_all_blocks_grow_the_trees_of_those_that_do_not(spark, checkered, monkeypatch, local):
    from gridpulse.operators import forest as R
    monkeypatch.setattr(R, "LOCAL_ROWS", local)
    train, found = checkered.where("id < 1000").repartition(3).cache(), []
    tops = R._grow_tops
    for held, spread in ((1 << 25, None), (0, tops)):
        monkeypatch.setattr(R, "HELD_BYTES", held)
        monkeypatch.setattr(R, "_grow_tops", spread)        # held blocks need no pass over all of them
        found.append(spark.read.schema(R.NODES).parquet(R.fit_forest(train, M.VECTOR, "_y", "_w", R.ForestSettings(12, 8, 3, 1)).folder)
                     .orderBy("tree").collect())
    assert [(t.tree, t.feature, t.cut, t.left) for t in found[0]] == [(t.tree, t.feature, t.cut, t.left) for t in found[1]]
    assert all(a.share == pytest.approx(b.share) for a, b in zip(*found)) and len(found[0]) == 12


def test_forest_tree_follows_its_rules():
    from gridpulse.operators import forest as R
    rng = np.random.default_rng(8)
    rows = np.zeros(400, dtype=R._dtype(3))
    rows["bins"], rows["y"], rows["n"], rows["w"] = rng.integers(0, 9, (400, 3)), rng.random(400) < 0.3, rng.integers(1, 4, 400), 1.5
    tree = R._grow(rows, 0, R.ForestSettings(1, 6, 5), np.random.default_rng(1))
    at = tree.place(rows["bins"])
    leaf = np.flatnonzero(tree.left < 0)
    assert tree.depth.max() <= 6 and set(at) == set(leaf)
    for node in leaf:
        own = rows[at == node]
        assert tree.draws[node].tolist() == [own["n"][own["y"] == c].sum() for c in (0, 1)] and tree.draws[node].sum() >= 5
        assert tree.weight[node] == pytest.approx(1.5 * tree.draws[node])


def test_large_nodes_stay_in_one_task_and_splits_are_compared_in_pieces(monkeypatch):
    from gridpulse.operators import forest as R
    top = R._Tree(np.array([900_000.0, 100_000.0]), np.array([1.0, 1.0]))
    assert R._large(top, R.ForestSettings()) == []           # no pass over all blocks for a million draws
    rng = np.random.default_rng(8)
    rows = np.zeros(2000, dtype=R._dtype(3))
    rows["bins"], rows["y"], rows["n"], rows["w"] = rng.integers(0, 9, (2000, 3)), rng.random(2000) < 0.3, rng.integers(1, 4, 2000), 1.5
    found = []
    for some in (1 << 10, 3):
        monkeypatch.setattr(R, "BEST_NODES", some)
        tree = R._grow(rows, 0, R.ForestSettings(1, 8, 3), np.random.default_rng(1))
        found.append([c.tolist() for c in (tree.feature, tree.bin, tree.left, tree.draws, tree.weight)])
    assert found[0] == found[1] and len(found[0][0]) > 50


def test_stack_is_the_same_whatever_runs_at_a_time(spark, checkered, tmp_path):
    rows = checkered.where("id < 400").drop(M.VECTOR, "_y", "_w").withColumn("label", ((F.col("a") > 0) == (F.col("b") > 0)).cast("int"))
    found = []
    for parallel in (1, 4):
        s = M.StackSettings(boost=M.BoostSettings(2, 2), forest_trees=5, forest_depth=4, plain=M.BoostSettings(2, 2), folds=2, parallel=parallel,
                            logistic_rounds=5, meta_rounds=5)
        model = M.fit_stacking(rows, ["a", "b", "c", "d"], ["id"], settings=s)
        model.save(str(tmp_path / f"s{parallel}"))
        again = M.StackedModel.load(spark, str(tmp_path / f"s{parallel}"))
        found.append(sorted(again.predict(rows).select("id", F.round("occ_prob", 9), "occ_pred").collect()))
    assert found[0] == found[1] and len({r[1] for r in found[0]}) > 1


def test_cascade_makes_each_matrix_once(spark, monkeypatch):
    from gridpulse.plans import catalog
    from gridpulse.plans import queries_models as Q
    frame, made = spark.createDataFrame([(1, 2)], "fips_code int, key_fips_code int"), []
    for name in ("occurrence_matrix", "scope_matrix", "duration_matrix"):
        monkeypatch.setattr(Q, name, lambda spark, sf, name=name: made.append(name) or frame)
    monkeypatch.setattr(Q, "stored_model", lambda spark, sf, name, kind, fit: fit())
    monkeypatch.setattr(Q.M, "fit_stacking", lambda m, *rest, **more: "stack")
    monkeypatch.setattr(Q.M, "fit_two_stage", lambda m, *rest, settings: settings.threshold)
    monkeypatch.setattr(Q.T, "cascade_batch", lambda *parts: parts)
    parts = catalog.QUERIES["pip8_cascade_batch"](spark, "none")
    assert sorted(made) == ["duration_matrix", "occurrence_matrix", "scope_matrix"]
    assert parts[3:6] == ("stack", Q.LARGE, Q.LONG_MINUTES) and all("code" in m.columns for m in parts[:3])


def test_jobs_of_long_tasks_leave_cores_free_one_at_a_time(spark):
    from gridpulse import session
    seen = []

    def job():
        with session.long_tasks(spark) as tasks:
            seen.append((tasks, session._LONG.acquire(blocking=False)))

    M.at_once(spark, [job] * 4)
    assert seen == [(spark.sparkContext.defaultParallelism * 3 // 4, False)] * 4 and not session._LONG.locked()


def test_leaves_read_from_files_are_the_games_they_were(spark, rows):
    from gridpulse.session import open_store
    model = M.fit_regressor(rows, NAMES, M.BoostSettings(3, 4, 0.3)).model
    explainer = C.tree_explainer(spark, model, NAMES)
    store, root = open_store(explainer.folder)
    files = [f.path for f in store.get_file_info(C.fs.FileSelector(root)) if f.path.endswith(".parquet")]
    x = np.random.default_rng(9).normal(size=(200, 3))
    for file in files:
        plain = [C._game(r["value"], dict(zip(r["features"], zip(r["low"], r["high"], r["shares"]))))
                 for r in C.parquet.read_table(file, filesystem=store).to_pylist() if r["features"]]
        read = C._games(store, file)
        assert len(read) == len(plain)
        for a, b in zip(read, plain):
            assert a.features.tolist() == b.features.tolist() and a.table == pytest.approx(b.table)
            # A feature's values lie side by side, and many leaves share one array.
            assert a.table[:, 0].flags.c_contiguous and a.table.base is not None
            assert a.contributions(x[:, a.features]) == pytest.approx(b.contributions(x[:, a.features]))


def test_training_rows_become_whole_matrices(spark, rows):
    x = rows.select(F.array("b", "c").alias("x"))
    stored = A._matrices(x, 2).collect()
    found = np.concatenate([np.frombuffer(r.x).reshape(-1, 2) for r in stored])
    assert sorted(map(tuple, found)) == sorted(tuple(r.x) for r in x.collect()) and len(stored) < len(found)
