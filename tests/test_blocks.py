"""Neighbours, density clusters and silhouettes against brute force, with many cells and blocks."""

from __future__ import annotations

import time

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tillwise.operators import blocks as bl
from tillwise.operators import centroids as ce
from tillwise.operators import density as de
from tillwise.operators import neighbours as ne
from tillwise.operators import segments as sg

COLUMNS = ["x", "y", "z"]
OPTIONS = {"pivots": 6, "block_rows": 17}


@pytest.fixture(scope="module")
def points(spark):
    """Three clouds, a bridge, strays, and one point that a third of the rows share."""
    rng = np.random.default_rng(3)
    clouds = [rng.normal(c, 0.35, (40, 3)) for c in ((0, 0, 0), (4, 0, 0), (0, 5, 1))]
    bridge = np.column_stack([np.linspace(0, 4, 15), np.zeros(15), np.zeros(15)])
    strays = rng.uniform(-9, 9, (15, 3))
    same = np.tile([[4.0, 0.0, 0.0]], (75, 1))
    data = np.vstack([*clouds, bridge, strays, same])
    pdf = pd.DataFrame(data, columns=COLUMNS)
    pdf.insert(0, "Customer_ID", [f"{i:04d}" for i in range(len(pdf))])
    pdf["Target"] = np.round(rng.random(len(pdf)), 3)
    return pdf, spark.createDataFrame(pdf)


def apart(pdf, power=2):
    values = pdf[COLUMNS].to_numpy()
    step = np.abs(values[:, None] - values[None])
    total = step.sum(-1) if power == 1 else np.sqrt((step**2).sum(-1))
    return np.floor(total * 1e9 + 0.5) / 1e9


@pytest.mark.parametrize("power", [1, 2])
def test_neighbours(points, power):
    pdf, df = points
    k = 4
    found = ne.nearest_rows(df, df, COLUMNS, "Target", k, power, **OPTIONS).toPandas()
    order = np.argsort(apart(pdf, power), axis=1, kind="stable")[:, :k]
    ids = pdf["Customer_ID"].to_numpy()
    for i, part in found.sort_values("Place").groupby("Customer_ID"):
        assert list(part["Neighbour"]) == list(ids[order[int(i)]])


def brute_force(pdf, reach, least):
    near = apart(pdf) <= reach
    core = near.sum(1) >= least
    label = [-1] * len(pdf)
    for start in range(len(pdf)):
        if not core[start] or label[start] >= 0:
            continue
        todo = [start]
        label[start] = start
        while todo:
            i = todo.pop()
            for j in np.flatnonzero(near[i] & core):
                if label[j] < 0:
                    label[j] = start
                    todo.append(j)
    for i in np.flatnonzero(~core):
        close = np.flatnonzero(near[i] & core)
        if len(close):
            label[i] = label[min(close, key=lambda j: (apart(pdf)[i, j], j))]
    return label


def test_density_clusters(points):
    pdf, df = points
    trials = [(0.5, 4), (0.9, 5), (0.3, 3), (1.5, 10)]
    found = de.density_clusters(df, COLUMNS, trials, **OPTIONS).toPandas()
    for number, (reach, least) in enumerate(trials):
        part = found[found["Trial"] == number].set_index("Customer_ID")["Cluster"]
        want = [None if v < 0 else f"{v:04d}" for v in brute_force(pdf, reach, least)]
        assert [None if pd.isna(part[i]) else part[i] for i in pdf["Customer_ID"]] == want


def test_trial_choice(spark):
    columns = "Eps double, MinSamples int, Clusters int, Noise_Pct double, SilhouetteSquared double"
    rows = [(0.6, 5, 9, 80.0, 0.9), (2.0, 20, 4, 22.43, 0.3669), (2.0, 5, 3, 10.0, 0.1), (1.8, 5, 1, 5.0, None)]
    best = de.choose_trial(spark.createDataFrame(rows, columns)).first()
    assert (best["Eps"], best["MinSamples"]) == (2.0, 20)
    noisy = [(0.6, 5, 9, 80.0, 0.9), (0.8, 5, 9, 70.0, 0.2)]
    assert de.choose_trial(spark.createDataFrame(noisy, columns)).first()["Eps"] == 0.8


def test_silhouette(points):
    pdf, df = points
    rows = df.withColumn("Cluster", F.when(F.col("x") > 2, 1).when(F.col("y") > 2.5, 2).otherwise(0))
    label = rows.toPandas()["Cluster"].to_numpy()
    distance = np.sqrt(((pdf[COLUMNS].to_numpy()[:, None] - pdf[COLUMNS].to_numpy()[None]) ** 2).sum(-1))
    values = []
    for i in range(len(pdf)):
        means = {c: distance[i, label == c].sum() / ((label == c).sum() - (c == label[i])) for c in set(label)}
        a, b = means.pop(label[i]), min(means.values())
        values.append((b - a) / max(a, b))
    found = sg.silhouette_euclidean(rows, COLUMNS, ["Cluster"], block_rows=40).first()["Silhouette"]
    assert found == pytest.approx(np.mean(values))


def test_squared_silhouettes(points):
    pdf, df = points
    halves = F.when(F.col("x") > 2, "a").otherwise("b")
    rows = df.withColumns(
        {
            "three": F.when(F.col("x") > 2, 1).when(F.col("y") > 2.5, 2).otherwise(0),
            "noisy": F.when(F.col("z") < 1.5, halves),
            "one": F.lit("x"),
            "alone": F.when(F.col("Customer_ID") == "0000", "only").otherwise(halves),
        }
    )
    names = ["three", "noisy", "one", "alone"]
    squared = ((pdf[COLUMNS].to_numpy()[:, None] - pdf[COLUMNS].to_numpy()[None]) ** 2).sum(-1)
    found = {r["Label"]: r["SilhouetteSquared"] for r in ce.silhouettes_squared(rows, COLUMNS, names).collect()}
    labels = rows.toPandas()
    for name in names:
        mark = labels[name].to_numpy()
        kept = [i for i in range(len(mark)) if mark[i] is not None]
        values = []
        for i in kept:
            sizes = {c: [j for j in kept if mark[j] == c] for c in set(mark[kept])}
            if len(sizes) < 2:
                continue
            own = sizes.pop(mark[i])
            if len(own) == 1:
                values.append(0.0)
                continue
            a, b = squared[i, own].sum() / (len(own) - 1), min(squared[i, c].mean() for c in sizes.values())
            values.append((b - a) / max(a, b))
        assert found[name] == (pytest.approx(np.mean(values)) if values else None)


def test_kmeans_of_many_starts(points):
    pdf, df = points
    rows = ce.vector_rows(df, COLUMNS)
    fits = ce.fit_many(rows, [1, 2, 3, 5], starts=6)
    costs = [fits[k].cost for k in (1, 2, 3, 5)]
    assert costs == sorted(costs, reverse=True)
    assert costs[0] == pytest.approx(((pdf[COLUMNS] - pdf[COLUMNS].mean()) ** 2).to_numpy().sum())
    labels = ce.nearest_labels(rows, fits).toPandas().set_index("Id").loc[pdf["Customer_ID"]]
    for k, fit in fits.items():
        own = labels[f"K{k}"].to_numpy()
        for cluster in range(k):
            assert np.allclose(fit.centres[cluster], pdf[COLUMNS].to_numpy()[own == cluster].mean(axis=0))


class OneTask:
    """Takes the function of a pass, to run it here."""

    def select(self, *_):
        return self

    def mapInArrow(self, function, _):
        self.function = function
        raise InterruptedError


def test_a_pass_of_many_models(points):
    """Rows, costs and sums per cluster as found one model at a time, in a fraction of that time; equal centres too."""
    rng = np.random.default_rng(5)
    data = np.vstack([rng.normal(size=(6000, 23)), np.ones((50, 23))])
    models = {i: data[rng.choice(6000, 2 + i % 9, replace=False)] for i in range(90)}
    models[90] = np.vstack([data[:2], data[:2]])
    task = OneTask()
    with pytest.raises(InterruptedError):
        ce.one_pass(task, models)
    batch = pa.RecordBatch.from_arrays([pa.array(list(data))], ["Vector"])
    began = time.process_time()
    found = pa.Table.from_batches(task.function(iter([batch]))).to_pandas().set_index(["Model", "Cluster"])
    took, began = time.process_time() - began, time.process_time()
    for model, centres in models.items():
        squares = ce.squared_distances(data, centres)
        nearest = squares.argmin(axis=1) % (2 if model == 90 else 99)
        member = np.eye(len(centres))[nearest]
        sums, costs = member.T @ data, (member * squares).sum(axis=0)
        for cluster in range(len(centres)):
            row = found.loc[model, cluster]
            assert row["Rows"] == (nearest == cluster).sum()
            assert np.allclose(row["Sums"], sums[cluster]) and row["Cost"] == pytest.approx(costs[cluster])
    assert took < time.process_time() - began


def test_segment_names(spark):
    columns = (
        "Cluster int, AvgFutureSpend90Days double, RetentionRate_Pct double, AvgFrequency double, "
        "IsNewCustomer_mean double, AvgRecency double, ZeroFutureSpendRate_Pct double"
    )
    rows = [(0, 5.0, 50.0, 4.0, 0.1, 40.0, 20.0), (1, 90.0, 87.0, 20.0, 0.9, 10.0, 1.0), (2, 2.0, 30.0, 1.0, 0.8, 50.0, 60.0), (3, 1.0, 20.0, 2.0, 0.0, 99.0, 70.0)]
    named = sg.name_segments(spark.createDataFrame(rows, columns))
    found = {r["Cluster"]: r["SegmentName"] for r in named.collect()}
    # Cluster 1 is both the best and the newest: it keeps the first name, nobody is "new".
    assert found == {0: sg.REGULAR, 1: sg.BEST, 2: sg.REGULAR, 3: sg.INACTIVE}


def test_neighbours_of_other_folds(points):
    pdf, df = points
    folded = df.withColumn("Fold", F.col("Customer_ID").cast("int") % 3)
    found = ne.nearest_rows(folded, folded, COLUMNS, "Target", 4, fold="Fold", **OPTIONS).toPandas()
    fold = np.arange(len(pdf)) % 3
    far = np.where(fold[:, None] == fold[None], np.inf, apart(pdf))
    order = np.argsort(far, axis=1, kind="stable")[:, :4]
    assert len(found) == 4 * len(pdf)
    for i, part in found.sort_values("Place").groupby("Customer_ID"):
        assert list(part["Neighbour"]) == list(pdf["Customer_ID"].to_numpy()[order[int(i)]])


def test_a_stray_row_does_not_open_every_cell(spark):
    draw = np.random.default_rng(5).normal(size=(600, 3))
    draw[0] = 500.0
    rows = spark.createDataFrame([(f"{i:04d}", v.tolist()) for i, v in enumerate(draw)], "Customer_ID string, Vector array<double>")
    _, cells = bl.build_cells(rows, "Customer_ID", pivots=32)
    assert cells.rows.sum() == 600
    visits = cells.visits(draw, 0.2)
    assert all(own in found for own, found in zip(cells.place(draw), visits))
    assert np.mean([len(found) for found in visits]) < 10


@pytest.mark.parametrize("power", [1, 2])
def test_fast_distances_are_within_their_error(power):
    draw = np.random.default_rng(6)
    left, right = draw.normal(size=(50, 23)) * 40, draw.normal(size=(70, 23)) * 40
    right[:20] = left[:20] + 1e-7
    rough = bl.Rough(right, power)
    fast, error = rough.to(left)
    true = np.stack([bl.pair_distances(np.repeat(line[None], len(right), axis=0), right, power) for line in left])
    assert (np.abs(fast - (true if power == 1 else true**2)) <= error[:, None] + 4e-9 * (1 + true)).all()
    for reach in (float(true[0, 0]), float(true[3, 40]), 5.0):
        assert (bl.near_pairs(left, right, rough, reach, fast, error) == (true <= reach)).all()


def test_silhouette_blocks_travel_as_arrow_tables(points):
    _, df = points
    rows = df.withColumn("Cluster", F.when(F.col("x") > 2, 1).otherwise(0))
    plan = sg.silhouette_euclidean(rows, COLUMNS, ["Cluster"])._jdf.queryExecution().toString()
    assert "InArrow" in plan and "InPandas" not in plan


def test_density_links_beyond_the_nearest_rows(spark):
    """Copies fill the lists of nearest rows, so only a search beyond them finds the steps from heap to heap."""
    heaps = [[0.0, 0.0, 0.0], [0.5, 0.0, 0.0], [1.0, 0.0, 0.0], [3.0, 0.0, 0.0], [3.9, 0.0, 0.0]]
    data = np.repeat(heaps, 30, axis=0)[np.random.default_rng(2).permutation(150)]
    pdf = pd.DataFrame(data, columns=COLUMNS)
    pdf.insert(0, "Customer_ID", [f"{i:04d}" for i in range(150)])
    trials = [(0.4, 5), (0.5, 5), (0.5, 12), (1.0, 5), (2.0, 12), (1.0, 40)]
    found = de.density_clusters(spark.createDataFrame(pdf), COLUMNS, trials, **OPTIONS).toPandas()
    for number, (reach, least) in enumerate(trials):
        part = found[found["Trial"] == number].set_index("Customer_ID")["Cluster"]
        want = [None if v < 0 else f"{v:04d}" for v in brute_force(pdf, reach, least)]
        assert [None if pd.isna(part[i]) else part[i] for i in pdf["Customer_ID"]] == want


def test_neighbours_meet_pieces_without_a_shuffle(points):
    """Rows lie in pieces that tasks read; nothing is sent once per cell or block that it meets."""
    _, df = points
    plan = ne.nearest_rows(df, df, COLUMNS, "Target", 4, **OPTIONS)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "CoGroup" not in plan


def test_silhouette_rows_are_dealt_once(points):
    """No row is sent once per block it meets; noise, single rows and labels of one cluster count as before."""
    _, df = points
    halves = F.when(F.col("x") > 2, "a").otherwise("b")
    alone = F.when(F.col("Customer_ID") == "0000", "only").otherwise(halves)
    rows = df.withColumns({"noisy": F.when(F.col("z") < 1.5, halves), "one": F.lit("x"), "alone": alone, "none": F.lit(None).cast("string")})
    found = sg.silhouette_euclidean(rows, COLUMNS, ["noisy", "one", "alone", "none"], block_rows=40)
    plan = found._jdf.queryExecution().toString()
    assert "CoGroup" not in plan and "Explode" not in plan and "Generate" not in plan
    pdf = rows.toPandas()
    distance = np.sqrt(((pdf[COLUMNS].to_numpy()[:, None] - pdf[COLUMNS].to_numpy()[None]) ** 2).sum(-1))
    got = {r["Label"]: r["Silhouette"] for r in found.collect()}
    assert sorted(got) == ["alone", "noisy", "one"] and got["one"] is None
    for name in ("noisy", "alone"):
        mark = pdf[name].to_numpy()
        kept = [i for i in range(len(pdf)) if mark[i] is not None]
        values = []
        for i in kept:
            means = {c: distance[i, mark == c].sum() / max(1, (mark == c).sum() - (c == mark[i])) for c in set(mark[kept])}
            a, b = means.pop(mark[i]), min(means.values())
            values.append(0.0 if (mark == mark[i]).sum() == 1 else (b - a) / max(a, b))
        assert got[name] == pytest.approx(np.mean(values))


def test_trial_scores_equal_the_single_scores(points, spark):
    """Counts and scores of all trials from sums per cluster, few clusters at a time, as the operators give them one by one."""
    _, df = points
    trials = [(0.5, 4), (1.5, 10), (0.001, 200)]
    fit = de.density_fit(df, COLUMNS, trials, **OPTIONS)
    found = {r["Eps"]: r for r in de.trial_scores(fit, spark).collect()}
    labels = fit.labels(spark).where("Cluster is not null").join(df, "Customer_ID").select("Eps", "Customer_ID", *COLUMNS, "Cluster").toPandas()
    for reach, _ in trials[:2]:
        part = labels[labels["Eps"] == reach].drop(columns="Eps")
        rows, line = spark.createDataFrame(part), found[reach]
        assert line["Clusters"] == part["Cluster"].nunique() and line["NoiseCount"] == df.count() - len(part)
        assert line["SilhouetteSquared"] == pytest.approx(ce.silhouettes_squared(rows, COLUMNS, ["Cluster"]).first()[1])
        assert line["DaviesBouldin"] == pytest.approx(sg.davies_bouldin(rows, COLUMNS, "Cluster").first()[0])
        assert line["CalinskiHarabasz"] == pytest.approx(sg.calinski_harabasz(rows, COLUMNS, "Cluster").first()[0])
    assert found[0.001]["Noise_Pct"] == 100.0 and found[0.001]["DaviesBouldin"] is None
