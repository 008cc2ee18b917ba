"""The classifier search: the published settings, F1 and five folds."""

from __future__ import annotations

from math import sqrt

import numpy as np
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tillwise.operators import models as mo
from tillwise.operators import search as se
from tillwise.operators import shared_boosting as sb
from tillwise.plans.inputs import kept_features

FOLDER = "/root/testdata/sf0.001"


def f1(pairs):
    hits = sum(a and b for a, b in pairs)
    return 2 * hits / max(1, 2 * hits + sum(bool(a) != bool(b) for a, b in pairs))


def test_neighbour_search_matches_brute_force(spark):
    train = mo.train_rows(mo.model_rows(kept_features(spark, FOLDER)))
    found = se.classifier_search(train, models=("KNN",)).collect()
    got = {int(r["Params"]["k"]): (r["MeanScore"], r["StdScore"]) for r in found}
    rows = mo.with_folds(train, 5).collect()
    assert sorted(got) == [3, 5, 7, 9, 11, 15, 21]
    for k, (mean, deviation) in got.items():
        scores = []
        for fold in range(5):
            others, pairs = [r for r in rows if r["Fold"] != fold], []
            for row in (r for r in rows if r["Fold"] == fold):
                apart = sorted(
                    (round(sqrt(sum((row[c] - o[c]) ** 2 for c in mo.MODEL_FEATURES)), 9), o["Customer_ID"], o[mo.LABEL])
                    for o in others
                )[:k]
                pairs.append((row[mo.LABEL], sum(a[2] for a in apart) / len(apart) > 0.5))
            scores.append(f1(pairs))
        expected = sum(scores) / 5
        assert abs(mean - expected) < 1e-9
        assert abs(deviation - sqrt(sum((s - expected) ** 2 for s in scores) / 5)) < 1e-9


def train(spark):
    return mo.train_rows(mo.model_rows(kept_features(spark, FOLDER)))


def test_cut_trees_equal_single_fits(spark):
    fold = se.fold_parts(train(spark), 5)[1]
    nested = {dict(t.params)["maxDepth"]: t[3:] for t in se.nested_trees(fold)}
    assert sorted(map(int, nested)) == sorted(se.TREE_DEPTHS)
    for depth in se.TREE_DEPTHS:
        single = mo.CLASSIFIERS["DecisionTree"](maxDepth=depth).fit(fold.fit)
        assert nested[str(depth)] == se.held_counts(single, fold.held)


def test_a_whole_forest_votes_as_the_fitted_model(spark):
    fold = se.fold_parts(train(spark), 5)[0]
    model = mo.CLASSIFIERS["RandomForest"](maxDepth=6, numTrees=20).fit(fold.fit)
    found = se.cut_counts(fold.held, se.grown_trees(model, se.fresh_folder(fold.fit)), (3, 6), (5, 20))
    assert sorted(found) == [(3, 5), (3, 20), (6, 5), (6, 20)]
    assert found[6, 20] == se.held_counts(model, fold.held)


def test_grids_have_the_published_sizes():
    assert {name: len(se.fits(name)) for name in ("LogisticRegression", "LinearSVC")} == {"LogisticRegression": 6, "LinearSVC": 3}
    assert len(se.BOOSTING_RATES) * len(se.BOOSTING_DEPTHS) == 12 and se.BOOSTING_ROUNDS == 100
    assert len(se.FOREST_TREES) * len(se.FOREST_DEPTHS) == 12
    assert se.penalty(10.0)(se.Fold(0, None, None, 100)) == {"regParam": 0.001}


def test_one_row_per_setting(spark):
    found = se.classifier_search(mo.model_rows(kept_features(spark, FOLDER)), models=("DecisionTree", "RandomForest", "LinearSVC"))
    rows = found.collect()
    assert sorted(r["Model"] for r in rows) == ["DecisionTree"] * 5 + ["LinearSVC"] * 3 + ["RandomForest"] * 12
    assert all(0 <= r["MeanScore"] <= 1 and r["StdScore"] >= 0 for r in rows)
    best = {r["Model"]: r["BestScore"] for r in se.best_trials(found).collect()}
    assert best == {m: max(r["MeanScore"] for r in rows if r["Model"] == m) for m in best}
    flat = se.flat_trials(found).where("Model = 'RandomForest'").collect()
    assert {(r["maxDepth"], r["numTrees"], r["k"]) for r in flat} == {(d, n, None) for d in (3, 5, 10) for n in (50, 100, 200, 300)}


def grown_by_hand(bins, labels, model, folds, rounds):
    """Newton boosting of one model, node by node."""
    fit, margins = folds != model.fold, np.zeros(len(bins))
    for _ in range(rounds):
        chance = 1 / (1 + np.exp(-margins))
        g, h, step = chance - labels, chance * (1 - chance), np.zeros(len(bins))

        def grow(rows, level):
            mine = rows & fit
            whole_g, whole_h = g[mine].sum(), h[mine].sum()
            step[rows] = -model.rate * whole_g / (whole_h + sb.PENALTY)
            if level == model.depth or (level and whole_h < 2 * sb.LEAST_HESSIAN):
                return
            best = (sb.LEAST_GAIN, None, None)
            for k in range(bins.shape[1]):
                for cut in range(sb.BINS - 1):
                    left = mine & (bins[:, k] <= cut)
                    lg, lh = g[left].sum(), h[left].sum()
                    if min(lh, whole_h - lh) < sb.LEAST_HESSIAN:
                        continue
                    gain = (lg**2 / (lh + 1) + (whole_g - lg) ** 2 / (whole_h - lh + 1) - whole_g**2 / (whole_h + 1)) / 2
                    if round(gain, 9) > round(best[0], 9):
                        best = (gain, k, cut)
            if best[1] is not None:
                left = rows & (bins[:, best[1]] <= best[2])
                grow(left, level + 1)
                grow(rows & ~left, level + 1)

        grow(np.ones(len(bins), bool), 0)
        margins += step
    return margins


def test_shared_boosting_equals_models_grown_alone(spark):
    draw = np.random.default_rng(4)
    values = draw.normal(size=(160, 4)).round(2)
    labels = ((values[:, 0] * values[:, 1] + values[:, 2] > 0) ^ (draw.random(160) < 0.1)).astype(int)
    folds = np.arange(160) % 3
    rows = [(int(f), int(y), Vectors.dense(v)) for f, y, v in zip(folds, labels, values)] + [(0, None, Vectors.dense([0.0] * 4))]
    kinds = (("Fold", IntegerType()), ("y", IntegerType()), ("vector", VectorUDT()))
    frame = spark.createDataFrame(rows, StructType([StructField(*kind) for kind in kinds]))
    models = [sb.Model(f, rate, depth) for f in range(3) for rate, depth in ((0.1, 2), (0.5, 4))]
    monkey = sb.ROWS_PER_TASK
    sb.ROWS_PER_TASK = 50  # several tasks
    try:
        found = sb.boosted_margins(frame.repartition(4), F.col("y"), models, 7)
        counts = sb.held_out_counts(found, models)
        bins = sb.binned(frame.where("y is not null"), F.col("y"), 1, 4).collect()
    finally:
        sb.ROWS_PER_TASK = monkey
    matrix = np.stack([np.frombuffer(r["bins"], np.uint8) for r in bins])
    y, fold = np.array([r["label"] for r in bins]), np.array([r["fold"] for r in bins])
    for k, model in enumerate(models):
        margins = grown_by_hand(matrix, y, model, fold, 7)
        held = fold == model.fold
        decided = margins > 0
        assert counts[k] == tuple(int((held & a & b).sum()) for a, b in ((y == 1, decided), (y == 0, decided), (y == 1, ~decided)))
    ours = sorted(np.round(np.concatenate([np.frombuffer(r["margins"], float) for r in found.collect()]), 8).tolist())
    theirs = np.concatenate([grown_by_hand(matrix, y, m, fold, 7) for m in models])
    assert np.allclose(ours, np.sort(np.round(theirs, 8)), atol=1e-7)


def test_a_boosted_tree_is_applied_once(spark, monkeypatch):
    grow, waiting = sb.grow_round, []

    def watched(state, models, grown, tasks):
        waiting.append(len(grown))
        return grow(state, models, grown, tasks)

    monkeypatch.setattr(sb, "grow_round", watched)
    draw = np.random.default_rng(1).normal(size=(40, 2))
    rows = [(i % 2, int(v[0] > 0), Vectors.dense(v)) for i, v in enumerate(draw)]
    kinds = (("Fold", IntegerType()), ("y", IntegerType()), ("vector", VectorUDT()))
    frame = spark.createDataFrame(rows, StructType([StructField(*kind) for kind in kinds]))
    assert sb.boosted_margins(frame, F.col("y"), [sb.Model(0, 0.1, 2)], 4).count() == 40
    assert waiting == [0, 0, 0, 0]


def test_models_grown_by_tasks_equal_those_of_shared_passes(spark, monkeypatch):
    """A task grows a whole model while it can hold the binned rows, in few jobs; the counts are those of the passes."""
    rows = mo.with_folds(train(spark), 3)
    models = [sb.Model(f, rate, depth) for f in range(3) for rate, depth in ((0.1, 3), (0.2, 5))]

    def never(*_):
        raise AssertionError("a pass over the rows per level")

    with monkeypatch.context() as alone:
        alone.setattr(sb, "node_splits", never)
        found = sb.boosted_counts(rows, F.col(mo.LABEL), models, 6)
    monkeypatch.setattr(sb, "ROWS_ALONE", 0)
    assert found == sb.boosted_counts(rows, F.col(mo.LABEL), models, 6)
    assert sorted(found) == list(range(6)) and sum(map(sum, found.values())) > 0


def test_the_boosted_search_needs_no_pass_per_level(spark, monkeypatch):
    monkeypatch.setattr(sb, "node_splits", None)
    trials = se.boosted_trials(train(spark), 2, rounds=2)
    assert len(trials) == 24
