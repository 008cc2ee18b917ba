"""Registered queries: fitted models held to numbers that follow from their method.

The nodes of a fitted tree are written, read back and walked by joins: the walk must give the model's
own score on every row, and a leaf must hold the mean of the training rows that end in it. A
penalised maximum has slope zero in every coefficient.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.functions.columns import settled
from tillwise.functions.lineage import cut_lineage
from tillwise.operators import models as mo
from tillwise.operators.search import fresh_folder
from tillwise.plans import models as pm
from tillwise.plans.oracle import with_tables

NEAR = 1e-9


def written_nodes(model, rows: DataFrame) -> DataFrame:
    """(tree, node, left, right, feature, threshold, value, gain, stats) of a fitted tree model."""
    folder = fresh_folder(rows)
    model.write().save(folder)
    data = rows.sparkSession.read.parquet(f"{folder}/data")
    tree = F.col("treeID") if "treeID" in data.columns else F.lit(0)
    nodes = data.select(tree.alias("tree"), "nodeData.*") if "nodeData" in data.columns else data.withColumn("tree", tree)
    return nodes.select(
        "tree",
        F.col("id").alias("node"),
        F.col("leftChild").alias("left"),
        F.col("rightChild").alias("right"),
        F.col("split.featureIndex").alias("feature"),
        F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
        F.col("prediction").alias("value"),
        "gain",
        F.col("impurityStats").alias("stats"),
    )


def ends(rows: DataFrame, nodes: DataFrame, trees: int, depth: int) -> DataFrame:
    """The rows with the leaf they end at in every tree; a model has at most 2 ** (depth + 1) nodes a tree."""
    now = rows.withColumns(
        {"tree": F.explode(F.sequence(F.lit(0), F.lit(trees - 1))), "node": F.lit(0), "values": vector_to_array("vector")}
    )
    inner = nodes.where("left >= 0").select("tree", "node", "left", "right", "feature", "threshold")
    for _ in range(depth):
        goes_left = F.get("values", F.col("feature")) <= F.col("threshold")
        step = F.when(F.col("left").isNull(), F.col("node")).when(goes_left, F.col("left")).otherwise(F.col("right"))
        now = now.join(F.broadcast(inner), ["tree", "node"], "left").withColumn("node", step)
        now = now.drop("left", "right", "feature", "threshold")
    return now.join(F.broadcast(nodes.select("tree", "node", "value", "stats")), ["tree", "node"])


def walked(name: str, classes: bool):
    """Rows, trees, rows that the walk scores otherwise, and leaves of the first tree that are no mean."""

    def query(spark, folder):
        rows = pm.rows(spark, folder)
        model = (mo.CLASSIFIERS if classes else mo.REGRESSORS)[name]().fit(mo.train_rows(rows))
        single, boosted = name == "DecisionTree", name == "BoostedTrees"
        trees = 1 if single else model.getNumTrees
        depth = model.depth if single else max(t.depth for t in model.trees)
        nodes = cut_lineage(written_nodes(model, rows))
        own = vector_to_array("probability")[1] if classes else F.col("prediction")
        keep = ["Customer_ID", "Split", mo.LABEL, mo.SPEND, "Weight", "vector"]
        placed = cut_lineage(ends(model.transform(rows).select(*keep, own.alias("Own")), nodes, trees, depth).drop("vector", "values"))

        whole = F.aggregate("stats", F.lit(0.0), lambda a, b: a + b)
        value = F.get("stats", F.lit(1)) / whole if classes and not boosted else F.col("value")
        shares = [1.0 / trees] * trees if not boosted else [float(w) for w in model.treeWeights]
        weighted = F.sum(value * F.get(F.array(*[F.lit(s) for s in shares]), F.col("tree")))
        score = 1 / (1 + F.exp(-2 * weighted)) if classes and boosted else weighted
        by_row = placed.groupBy("Customer_ID").agg(F.first("Own").alias("Own"), score.alias("Walked"))
        apart = F.abs(F.col("Own") - F.col("Walked")) <= NEAR * F.greatest(F.lit(1.0), F.abs("Own"))
        out = by_row.agg(
            F.count(F.lit(1)).alias("Rows"), F.lit(trees).alias("Trees"), F.count_if(~F.coalesce(apart, F.lit(False))).alias("Misread")
        )
        if name == "RandomForest":  # its trees see drawn rows
            return out
        target = F.col(mo.SPEND) if not classes else 2.0 * F.col(mo.LABEL) - 1 if boosted else F.col(mo.LABEL).cast("double")
        weight = F.col("Weight") if classes and not boosted else F.lit(1.0)
        first = mo.train_rows(placed).where("tree = 0").groupBy("node")
        leaves = first.agg((F.sum(weight * target) / F.sum(weight)).alias("Mean"), F.first(value).alias("Value"))
        off = F.abs(F.col("Mean") - F.col("Value")) > NEAR * F.greatest(F.lit(1.0), F.abs("Mean"))
        return out.join(F.broadcast(leaves.agg(F.count_if(off).alias("OffLeaves"))))

    return query


def gains(spark, folder):
    """Importances from the gains of the written nodes, each tree's adding up to one; how many features differ."""
    rows = pm.rows(spark, folder)
    out = None
    for name in ("RandomForest", "DecisionTree"):
        model = mo.CLASSIFIERS[name]().fit(mo.train_rows(rows))
        weight = F.aggregate("stats", F.lit(0.0), lambda a, b: a + b)
        inner = written_nodes(model, rows).where("left >= 0").select("tree", "feature", (F.col("gain") * weight).alias("g"))
        whole = inner.groupBy("tree").agg(F.sum("g").alias("whole"))
        parts = inner.join(F.broadcast(whole), "tree").groupBy("feature").agg(F.sum(F.col("g") / F.col("whole")).alias("part"))
        own = F.get(F.array(*[F.lit(float(v)) for v in model.featureImportances.toArray()]), F.col("feature"))
        trees = inner.select("tree").distinct().agg(F.count(F.lit(1)).alias("n"))
        line = parts.join(F.broadcast(trees)).agg(
            F.lit(name).alias("Model"),
            F.count_if(F.abs(F.col("part") / F.col("n") - own) > NEAR).alias("Differ"),
            F.sum(F.col("part") / F.col("n")).alias("Total"),
        )
        out = line if out is None else out.unionByName(line)
    return settled(out, 6)


def log_link_slopes(train: DataFrame, model, target: str, power: float) -> DataFrame:
    """Slope of the penalised likelihood of a log-link model per coefficient, in units of the mean working weight."""
    values, at = vector_to_array("vector"), list(enumerate(pm.COLUMNS))
    linear = sum((values[k] * float(model.coefficients[k]) for k, _ in at), F.lit(float(model.intercept)))
    rows = train.select(values.alias("v"), F.exp(linear).alias("mu"), F.col(target).alias("y"))
    off, weight = F.pow("mu", 1 - power) * (F.col("mu") - F.col("y")), F.sum(F.pow("mu", 2 - power))
    strength = model.getRegParam()
    slopes = [(F.sum(off * F.col("v")[k]) / weight + strength * float(model.coefficients[k])).alias(c) for k, c in at]
    long = rows.agg((F.sum(off) / weight).alias("Intercept"), *slopes).unpivot([], ["Intercept", *pm.COLUMNS], "Feature", "Slope")
    return settled(long.withColumn("Slope", F.abs("Slope")), 3)


def tweedie_slopes(spark, folder):
    train = cut_lineage(mo.train_rows(mo.scaled_spend(pm.rows(spark, folder))))
    return log_link_slopes(train, mo.tweedie(1.5).fit(train), mo.SCALED, 1.5)


def amount_slopes(spark, folder):
    """The second stage of the two: the spend of buyers."""
    buyers = cut_lineage(mo.train_rows(pm.rows(spark, folder)).where(F.col(mo.SPEND) > 0))
    return log_link_slopes(buyers, mo.buyers_spend().fit(buyers), mo.SPEND, 2.0)


WALKS = {
    "mod04_walk_checked": ("DecisionTree", True, 1),
    "mod06_walk_checked": ("RandomForest", True, 100),
    "mod07_walk_checked": ("BoostedTrees", True, 20),
    "mod11_walk_checked": ("DecisionTree", False, 1),
    "mod12_walk_checked": ("RandomForest", False, 100),
    "mod13_walk_checked": ("BoostedTrees", False, 20),
}

QUERIES = {
    **{query: walked(name, classes) for query, (name, classes, _) in WALKS.items()},
    "att05_gains_checked": gains,
    "mod14_gradient_checked": tweedie_slopes,
    "mod15_gradient_checked": amount_slopes,
}


def walk_sql(name, trees):
    leaves = "" if name == "RandomForest" else ", cast(0 as bigint) as OffLeaves"
    return with_tables(
        "features", f"select count(*) as Rows, cast({trees} as int) as Trees, cast(0 as bigint) as Misread{leaves} from features"
    )


NO_SLOPE = f"select unnest({['Intercept', *pm.COLUMNS]}) as Feature, 0.0::double as Slope"

ORACLES = {
    **{query: walk_sql(name, trees) for query, (name, _, trees) in WALKS.items()},
    "att05_gains_checked": "select unnest(['RandomForest', 'DecisionTree']) as Model, cast(0 as bigint) as Differ, 1.0::double as Total",
    "mod14_gradient_checked": NO_SLOPE,
    "mod15_gradient_checked": NO_SLOPE,
}
