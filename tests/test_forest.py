"""The forests of the search, grown for all folds in shared passes."""

from __future__ import annotations

from math import ceil, sqrt

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from tillwise.operators import shared_forest as sf

FOLDS, TREES, DEPTH = 3, 4, 4
WEIGHTS = (0.75, 1.5)


def frame(spark, values, labels, folds):
    rows = [(f"{k:04d}", int(f), int(y), WEIGHTS[int(y)], Vectors.dense(v)) for k, (v, y, f) in enumerate(zip(values, labels, folds))]
    rows.append(("none", 0, None, 1.0, Vectors.dense([0.0] * values.shape[1])))
    kinds = ("Customer_ID", StringType()), ("Fold", IntegerType()), ("y", IntegerType()), ("Weight", DoubleType()), ("vector", VectorUDT())
    return spark.createDataFrame(rows, StructType([StructField(*kind) for kind in kinds]))


def made(count=240, width=5):
    draw = np.random.default_rng(7)
    values = draw.normal(size=(count, width)).round(2)
    values[:, 1] = draw.integers(0, 3, count)
    labels = ((values[:, 0] * (values[:, 1] - 1) + values[:, 2] > 0) ^ (draw.random(count) < 0.1)).astype(int)
    return values, labels, np.arange(count) % FOLDS


def votes_by_hand(bins, labels, folds, keys, fold, number, depth):
    """Positive share per row from one tree grown node by node, leaves that decide alike joined."""
    width, times = bins.shape[1], sf.times_drawn(keys, number)
    out = np.zeros(len(bins))

    def weighted(rows):
        return np.array([times[rows & (labels == c)].sum() * WEIGHTS[c] for c in (0, 1)])

    def gini(w):
        return 1 - ((w / w.sum()) ** 2).sum()

    def grow(rows, level, place):
        """Whether the node is a leaf, and its decision."""
        mine = rows & (folds != fold) & (times > 0)
        whole = weighted(mine)
        out[rows] = whole[1] / max(whole.sum(), 1e-300)
        decided = out[rows][0] > 0.5 if rows.any() else whole[1] / whole.sum() > 0.5
        best = (1e-12, None, None)
        if level < depth and min(whole) > 0:
            for k in sf.features_drawn(fold * TREES + number, level, width)[place]:
                for cut in range(sf.BINS - 1):
                    sides = weighted(mine & (bins[:, k] <= cut)), weighted(mine & (bins[:, k] > cut))
                    if min(s.sum() for s in sides) > 0:
                        gain = gini(whole) - sum(s.sum() / whole.sum() * gini(s) for s in sides)
                        if gain > best[0] + 1e-12:
                            best = (gain, k, cut)
        if best[1] is None:
            return True, decided
        share, left = out[rows].copy(), rows & (bins[:, best[1]] <= best[2])
        ends = grow(left, level + 1, 2 * place), grow(rows & ~left, level + 1, 2 * place + 1)
        if ends[0][0] and ends[1][0] and ends[0][1] == ends[1][1]:
            out[rows] = share
            return True, decided
        return False, decided

    grow(np.ones(len(bins), bool), 0, 0)
    return out


@pytest.mark.parametrize("least", [1_000, 40])
def test_shared_forests_equal_trees_grown_by_hand(spark, monkeypatch, least):
    monkeypatch.setattr(sf, "LEAST_ROWS", least)  # one task, several tasks
    values, labels, folds = made()
    rows = frame(spark, values, labels, folds)
    depths, sizes = (2, DEPTH), (1, 3, TREES)
    got = sf.forest_counts(rows.repartition(3), "Customer_ID", "y", FOLDS, depths, sizes)
    known = rows.where("y is not null").select(F.xxhash64("Customer_ID").alias("key")).collect()
    keys = np.array([r["key"] for r in known], np.int64).view(np.uint64)
    arrays = spark.createDataFrame([(v.tolist(),) for v in values], "v array<double>")
    ends = sf.bin_ends(arrays, values.shape[1])
    assert ends[1].tolist() == [0.5, 1.5] and all(len(e) < sf.BINS for e in ends)
    bins = np.stack([np.searchsorted(e, values[:, k]) for k, e in enumerate(ends)], axis=1)
    assert len(got) == FOLDS * len(depths) * len(sizes)
    for fold in range(FOLDS):
        held = folds == fold
        for depth in depths:
            trees = [votes_by_hand(bins, labels, folds, keys, fold, t, depth) for t in range(TREES)]
            for size in sizes:
                decided, y = sum(trees[:size]) * 2 > size, labels == 1
                expected = tuple(int((held & a & b).sum()) for a, b in ((y, decided), (~y, decided), (y, ~decided)))
                assert got[fold, depth, size] == expected


def test_shared_forests_score_as_spark_forests(spark):
    values, labels, folds = made(900)
    rows = frame(spark, values, labels, folds).where("y is not null")
    got = sf.forest_counts(rows, "Customer_ID", "y", FOLDS, (6,), (60,))
    for fold in range(FOLDS):
        forest = RandomForestClassifier(featuresCol="vector", labelCol="y", weightCol="Weight", numTrees=60, maxDepth=6, seed=1)
        scored = forest.fit(rows.where(F.col("Fold") != fold)).transform(rows.where(F.col("Fold") == fold))
        hits, wrong, missed = scored.agg(
            F.count_if((F.col("y") == 1) & (F.col("prediction") == 1)),
            F.count_if((F.col("y") == 0) & (F.col("prediction") == 1)),
            F.count_if((F.col("y") == 1) & (F.col("prediction") == 0)),
        ).first()
        f1 = lambda a, b, c: 2 * a / (2 * a + b + c)
        assert abs(f1(*got[fold, 6, 60]) - f1(hits, wrong, missed)) < 0.04


def test_draws():
    keys = np.random.default_rng(3).integers(0, 1 << 63, 200_000).view(np.uint64)
    times = sf.times_drawn(keys, 5)
    assert abs(times.mean() - 1) < 0.01 and abs(times.var() - 1) < 0.02
    assert abs(np.corrcoef(times, sf.times_drawn(keys, 6))[0, 1]) < 0.01
    drawn = sf.features_drawn(3, 4, 23)
    assert drawn.shape == (16, ceil(sqrt(23))) and all(len(set(d)) == 5 for d in drawn.tolist())


def test_no_rows_no_counts(spark):
    values, labels, folds = made(6)
    assert sf.forest_counts(frame(spark, values, labels, folds).where("y is null"), "Customer_ID", "y", 3, (2,), (2,)) == {}
