"""Boosting of many ensembles side by side."""

from contextlib import nullcontext

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from gridpulse.operators import boosting as B
from gridpulse.operators import models as M


@pytest.fixture(scope="module")
def rows(spark):
    """Class 1 where two features have the same sign, one row in ten flipped; the last feature repeats the first."""
    rng = np.random.default_rng(11)
    x = np.clip(np.round(4 * rng.normal(size=(1200, 3))), -10, 10)       # few values: a bin each
    y = ((x[:, 0] > 0) == (x[:, 1] > 0)) ^ (rng.random(1200) < 0.1)
    data = [(i, *map(float, r), float(r[0]), float(t), float(1 + 2 * t), 1.0, i % 3, i % 7 == 0) for i, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(data, "id long, a double, b double, c double, d double, _y double, _w double, _one double, _fold int, _val boolean")
    return M.training_frame(df, ["a", "b", "c", "d"], ["id", "_y", "_w", "_one", "_fold", "_val"]).cache()


def fitted(rows, rounds=6):
    fits = [B.BoostFit(M.BoostSettings(rounds, 5, 0.1, subsample=0.8, columns="0.8"), 0, 1),
            B.BoostFit(M.BoostSettings(rounds, 3, 0.1, min_child=4), 1)]
    return B.fit_boosted(rows, M.VECTOR, "_y", fits, ["_w", "_one"], "_fold", "_val")


def test_one_task_and_many_grow_the_same_trees(spark, rows, monkeypatch, tmp_path):
    rows = rows.withColumn("_val", F.lit(False))        # so all rounds run
    held = fitted(rows)
    monkeypatch.setattr(B, "LOCAL_ROWS", 100)
    monkeypatch.setattr(B, "STORE_EVERY", 3)
    spread = fitted(rows)
    for a, b in zip(held, spread):
        one, many = (spark.read.schema(B.NODES).parquet(m.folder).orderBy("tree").collect() for m in (a, b))
        assert [(t.tree, t.feature, t.cut, t.left) for t in one] == [(t.tree, t.feature, t.cut, t.left) for t in many] and len(one) == 6
        assert all(x.share == pytest.approx(y.share, abs=1e-5) for x, y in zip(one, many))
    held[0].save(str(tmp_path / "b"))
    both = B.Boosted.load(str(tmp_path / "b")).probability(held[0].probability(rows, M.VECTOR, "p"), M.VECTOR, "q")
    assert both.where("p <> q OR q IS NULL").isEmpty()
    assert both.agg(F.avg(((F.col("p") >= 0.5) == (F.col("_y") == 1)).cast("int"))).first()[0] > 0.75


def test_a_task_may_grow_several_ensembles(spark, rows, monkeypatch):
    fits = [B.BoostFit(M.BoostSettings(2, depth, 0.1), 0) for depth in (1, 3, 2)]
    found = []
    for tasks in (2, 3):
        monkeypatch.setattr(B, "long_tasks", lambda spark, tasks=tasks: nullcontext(tasks))
        models = B.fit_boosted(rows, M.VECTOR, "_y", fits, ["_w"], "_fold", "_val")
        found.append([B.read_trees(m.folder) for m in models])
    # Each ensemble is in its own place: a tree of depth d has at most 2^(d+1)-1 nodes.
    assert [max(len(t[0]) for t in trees) for trees in found[0]] == [3, 15, 7]
    assert all((x == y).all() for a, b in zip(*found) for s, t in zip(a, b) for x, y in zip(s, t))


def test_probabilities_and_rounds_are_those_of_mllib(spark, rows):
    """Without any sampling both choose the same splits."""
    s = M.BoostSettings(40, 3, 0.1, tolerance=0.01)
    ours = B.fit_boosted(rows, M.VECTOR, "_y", [B.BoostFit(s, 0)], ["_w"], "_fold", "_val")[0]
    theirs = s.classifier().setWeightCol("_w").setValidationIndicatorCol("_val").fit(rows)
    n = spark.read.schema(B.NODES).parquet(ours.folder).count()
    assert n < 40 and abs(n - theirs.getNumTrees) <= 1
    both = theirs.transform(ours.probability(rows, M.VECTOR, "p")).withColumn("q", vector_to_array("_probability")[1])
    assert both.agg(F.corr("p", "q")).first()[0] > 0.99


def test_a_leaf_holds_the_mean_residual_of_its_rows(rows):
    held = rows.where("NOT _val").collect()
    x, y = np.array([r[M.VECTOR].toArray() for r in held]), np.array([r._y for r in held])
    s = M.BoostSettings(2, 2, 0.1)
    trees = B.read_trees(B.fit_boosted(rows.where("NOT _val"), M.VECTOR, "_y", [B.BoostFit(s, 0)], ["_w"], "_fold", "_val")[0].folder)
    w, sign = 1 + 2 * y, 2 * y - 1
    margin = np.zeros(len(x))
    for number, tree in enumerate(trees):
        residual = sign if number == 0 else 4 * sign / (1 + np.exp(2 * sign * margin))
        added = B.leaf_sums([tree], x)
        for leaf in np.unique(added):
            own = added == leaf
            assert leaf == pytest.approx((0.1 if number else 1.0) * (w * residual)[own].sum() / w[own].sum(), abs=1e-5)
        margin += added
    assert len(trees) == 2 and len(np.unique(added)) == 4


def test_labels_other_than_0_and_1_and_no_rows_are_refused(rows):
    with pytest.raises(ValueError):
        fitted(rows.withColumn("_y", F.col("_y") + 1))
    with pytest.raises(ValueError):
        fitted(rows.where("false"))


def test_jobs_of_a_stack_do_not_grow_with_the_rounds(spark, rows):
    df = rows.select("id", F.col("_y").alias("label"), *[vector_to_array(M.VECTOR)[i].alias(n) for i, n in enumerate("abcd")])
    sc, jobs = spark.sparkContext, []
    for rounds in (2, 12):
        boost = M.BoostSettings(rounds, 3, tolerance=-1.0)
        s = M.StackSettings(boost=boost, forest_trees=3, forest_depth=3, plain=boost, folds=2, logistic_rounds=1, meta_rounds=1)
        sc.setJobGroup(f"stack-{rounds}", "")
        M.fit_stacking(df, list("abcd"), ["id"], settings=s)
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(f"stack-{rounds}")))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] <= jobs[0] + 5


def test_features_summed_together_have_their_own_sums():
    rng = np.random.default_rng(5)
    wide = [1, 32, 7, 32, 2, 2, 32]                  # bins; one feature is constant
    cuts = [np.arange(k - 1, dtype=float) for k in wide]
    packs, n = B._Packs.of(cuts), 500
    assert len(packs.groups) < 5 and sorted(f for g in packs.groups for f, _, _ in g) == [1, 2, 3, 4, 5, 6]
    bins = np.stack([rng.integers(0, k, n) for k in wide]).astype("u1")
    rows, at, moved = rng.permutation(n)[:400], rng.integers(0, 3, 400), rng.normal(size=400)
    block = B._Block([(0, n)], bins, packs.codes(bins), *[None] * 5)
    for weight in (np.ones(400), np.where(at > 1, 2.5, 1.0), rng.random(400)):       # one value, two, many
        found = packs.sums(block, rows, at, 3, weight, moved)
        for j in range(len(wide)):
            for what, v in enumerate((None, weight, moved)):
                plain = np.bincount(at * B.BINS + bins[j, rows], v, 3 * B.BINS).reshape(3, B.BINS)
                assert found[:, what, j] == pytest.approx(plain)


@pytest.mark.parametrize("loss", ["log", "squared", "absolute"])
def test_models_are_those_mllib_fits(spark, rows, monkeypatch, loss):
    df = rows.withColumns({"_c": F.col("_y"), "_y": F.log1p(F.abs(vector_to_array(M.VECTOR)[0]) * 10 + F.col("id") % 11)}).cache()
    s = M.BoostSettings(12, 3, min_child=5, loss="absolute" if loss == "absolute" else "squared", tolerance=0.01)
    if loss == "log":
        learner, kind, weight, shown = s.classifier().setLabelCol("_c").setWeightCol("_w"), M.GBTClassificationModel, "_w", vector_to_array("_raw")[1]
    else:
        learner, kind, weight, shown = s.regressor(), M.GBTRegressionModel, None, F.col("_log_pred")
    theirs = learner.copy().setValidationIndicatorCol("_val").fit(df)
    for local in (B.LOCAL_ROWS, 100):               # held by a task, and spread
        monkeypatch.setattr(B, "LOCAL_ROWS", local)
        ours = B.fit_as_mllib(learner, kind, df, s, loss, M.VECTOR, learner.getLabelCol(), "_val", weight)
        assert ours.getNumTrees == theirs.getNumTrees and ours.treeWeights == theirs.treeWeights
        assert ours.featureImportances.toArray() == pytest.approx(theirs.featureImportances.toArray())
        both = ours.transform(df).select("id", shown.alias("p")).join(theirs.transform(df).select("id", shown.alias("q")), "id")
        assert both.agg(F.max(F.abs(F.col("p") - F.col("q")))).first()[0] < 1e-9


def test_cut_points_of_many_rows_lie_at_equal_steps_of_weight(spark, monkeypatch):
    rows = spark.range(0, 30000, 1, 3).select(
        F.array(F.col("id") % 5, F.pmod(F.xxhash64("id"), F.lit(1 << 20)), F.lit(7)).cast("array<double>").alias("x"),
        F.array(F.when(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < 100_000, 9.0).otherwise(1.0)).alias("w")).cache()
    few, many, one = B._weighted_cuts(rows, 3)
    assert few.tolist() == [0.5, 1.5, 2.5, 3.5] and len(one) == 0 and 20 <= len(many) <= 31
    held = rows.select(F.col("x")[1].alias("x"), F.col("w")[0].alias("w")).collect()
    x, w = np.array([r.x for r in held]), np.array([r.w for r in held])
    assert 12 <= len(many[many < 100_000]) <= 18     # a tenth of the rows has half of the weight
    monkeypatch.setattr(B, "EXACT_ROWS", 30000)
    assert B._weighted_cuts(rows, 3)[0].tolist() == few.tolist()
    exact = B._weighted_cuts(rows, 3)[1]
    assert np.abs([w[x <= c].sum() / w.sum() for c in exact] - np.arange(1, len(exact) + 1) / 32).max() < 0.03


def test_fits_run_at_the_same_time(spark):
    from threading import Barrier
    meet = Barrier(2)                    # one after another they would wait for each other in vain
    assert sorted(M.at_once(spark, [lambda: meet.wait(20)] * 2)) == [0, 1]
