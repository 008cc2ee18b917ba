"""The walk over written trees, and that a wrong tree or a point off the maximum is noticed."""

from __future__ import annotations

import random

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import DecisionTreeRegressor, GeneralizedLinearRegression
from pyspark.sql import functions as F

from tillwise.plans import fits
from tillwise.plans import models as pm


def rows(spark, width=3, count=120):
    draw = random.Random(5)
    made = []
    for k in range(count):
        v = [round(draw.uniform(-2, 2), 2) for _ in range(width)]
        made.append((f"{k:03d}", Vectors.dense(v), float(v[0] * v[1] > 0), round(3 + v[0] - v[-1] ** 2 / 4 + draw.random(), 3)))
    return spark.createDataFrame(made, ["Customer_ID", "vector", "label", "y"])


def test_walk_of_a_tree_and_of_a_changed_tree(spark):
    df = rows(spark)
    model = DecisionTreeRegressor(featuresCol="vector", labelCol="y", maxDepth=3, seed=1).fit(df)
    nodes = fits.written_nodes(model, df).persist()
    own = {r["Customer_ID"]: r["prediction"] for r in model.transform(df).collect()}
    got = {r["Customer_ID"]: r["value"] for r in fits.ends(df, nodes, 1, model.depth).collect()}
    assert got == own
    moved = nodes.withColumn("threshold", F.when(F.col("node") == 0, F.col("threshold") + 1).otherwise(F.col("threshold")))
    other = {r["Customer_ID"]: r["value"] for r in fits.ends(df, moved, 1, model.depth).collect()}
    assert sorted(other) == sorted(own) and other != own


def test_every_row_ends_once_in_every_tree(spark):
    df = rows(spark)
    model = RandomForestClassifier(featuresCol="vector", labelCol="label", numTrees=4, maxDepth=2, seed=1).fit(df)
    nodes = fits.written_nodes(model, df)
    found = fits.ends(df, nodes, 4, 2).groupBy("Customer_ID").agg(F.sort_array(F.collect_list("tree")).alias("t")).collect()
    assert len(found) == 120 and all(r["t"] == [0, 1, 2, 3] for r in found)


def test_slopes_vanish_at_the_maximum_only(spark):
    df = rows(spark, len(pm.COLUMNS))

    def steepest(power, strength, used):
        options = {"featuresCol": "vector", "labelCol": "y", "maxIter": 25, "tol": 1e-9}
        fit = GeneralizedLinearRegression(family="tweedie", variancePower=power, linkPower=0.0, regParam=strength, **options)
        return max(r["Slope"] for r in fits.log_link_slopes(df, fit.fit(df), "y", used).collect())

    assert steepest(1.5, 0.1, 1.5) == 0
    assert steepest(1.5, 0.1, 2.0) > 0
