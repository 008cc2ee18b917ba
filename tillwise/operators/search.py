"""Parameter search over the classifiers, with fits that answer many settings at once.

A tree cut at a depth is the tree that a fit to that depth grows, so one deep tree per fold answers
every depth; the first trees of a forest are a smaller forest (another random draw than a fit of
that size), so one deep forest per fold answers all depths and numbers of trees. Forests of all
folds (``shared_forest``) and boosted models of all folds and settings (``shared_boosting``) grow in
the same passes. Folds are written
once, gathered into as many tasks as their rows ask for, and fits run side by side. Held-out rows
are scored where they are: a fit sends counts to the driver, never rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from functools import partial
from multiprocessing.pool import ThreadPool
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillwise.functions.columns import ratio
from tillwise.functions.joins import join_on
from tillwise.functions.lineage import cut_lineage, ensure_checkpoint_dir
from tillwise.operators.metrics import confusion_counts
from tillwise.operators.models import CLASSIFIERS, LABEL, MODEL_FEATURES, train_rows, with_folds
from tillwise.operators.neighbours import nearest_rows
from tillwise.operators.shared_boosting import Model, boosted_counts
from tillwise.operators.shared_forest import forest_counts

# The grids as published. C is the weight of the loss against the penalty.
LOGISTIC_C = (0.001, 0.01, 0.1, 1.0, 10.0, 100.0)
NEIGHBOUR_COUNTS = (3, 5, 7, 9, 11, 15, 21)
TREE_DEPTHS = (3, 5, 10, 15, 20)
SVC_C = (0.1, 1.0, 10.0)
FOREST_TREES, FOREST_DEPTHS = (50, 100, 200, 300), (3, 5, 10)
BOOSTING_RATES, BOOSTING_DEPTHS, BOOSTING_ROUNDS = (0.01, 0.05, 0.1, 0.2), (3, 5, 7), 100

PARAMETERS = ("C", "k", "maxDepth", "numTrees", "stepSize")
FOLDS = 5
LEAST_ROWS, MOST_ROWS = 50_000, 500_000  # of a task
COUNTS = ("TruePositives", "FalsePositives", "FalseNegatives")


class Fold(NamedTuple):
    number: int
    fit: DataFrame
    held: DataFrame
    rows: int  # to fit on


class Trial(NamedTuple):
    model: str
    params: tuple[tuple[str, str], ...]
    fold: int
    hits: int
    wrong: int
    missed: int


class Nodes(NamedTuple):
    """A grown tree; children have larger numbers than their parent, -1 where there are none."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    decision: np.ndarray
    share: np.ndarray  # of the positive class
    depth: np.ndarray

    def ends(self, depth: int) -> np.ndarray:
        """The nodes that are leaves when the tree is cut at a depth; leaves that decide alike are joined."""
        ends = (self.left < 0) | (self.depth >= depth)
        for level in range(int(self.depth.max(initial=0)) - 1, -1, -1):
            inner = np.flatnonzero((self.depth == level) & ~ends)
            left, right = self.left[inner], self.right[inner]
            ends[inner] = ends[left] & ends[right] & (self.decision[left] == self.decision[right])
        return ends

    def reached(self, vectors: np.ndarray, depths: Sequence[int]) -> list[np.ndarray]:
        """Per depth, the leaf that each row reaches."""
        ends = [self.ends(depth) for depth in depths]
        out = [np.full(len(vectors), -1) for _ in depths]
        rows, now = np.arange(len(vectors)), np.zeros(len(vectors), int)
        for _ in range(max(depths) + 1):
            for found, end in zip(out, ends, strict=True):
                found[(found < 0) & end[now]] = now[(found < 0) & end[now]]
            goes_left = vectors[rows, np.maximum(self.feature[now], 0)] <= self.threshold[now]
            below = np.where(goes_left, self.left[now], self.right[now])
            now = np.where(self.left[now] < 0, now, below)
        return out


def grown_trees(model, folder: str) -> list[Nodes]:
    """The trees of a fitted model, read back from its nodes (at most 2 ** (depth + 1) a tree)."""
    from pyspark.sql import SparkSession

    model.write().save(folder)
    data, trees = SparkSession.active().read.parquet(f"{folder}/data"), []
    several = "treeID" in data.columns
    nodes = data.select(F.col("treeID").alias("tree"), "nodeData.*") if several else data.select(F.lit(0).alias("tree"), "*")
    columns = [
        F.col("split.featureIndex").alias("feature"), F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
        F.col("leftChild").alias("left"), F.col("rightChild").alias("right"), F.col("prediction").alias("decision"),
        ratio(F.get("impurityStats", F.lit(1)), F.aggregate("impurityStats", F.lit(0.0), lambda a, b: a + b)).alias("share"),
    ]
    found = nodes.select("tree", "id", *columns).toPandas().sort_values(["tree", "id"])
    for _, nodes in found.groupby("tree"):
        left = nodes["left"].to_numpy()
        right = nodes["right"].to_numpy()
        depth = np.zeros(len(nodes), int)
        for k in np.flatnonzero(left >= 0):
            depth[left[k]] = depth[right[k]] = depth[k] + 1
        threshold = nodes["threshold"].fillna(0.0).to_numpy()
        decision = nodes["decision"].to_numpy().astype(int)
        share = nodes["share"].fillna(0.0).to_numpy()
        trees.append(Nodes(nodes["feature"].to_numpy(), threshold, left, right, decision, share, depth))
    return trees


def cut_counts(held: DataFrame, trees: list[Nodes], depths: Sequence[int], sizes: Sequence[int]) -> dict:
    """(depth, number of trees) -> hits, wrong and missed of the held-out rows; one pass for all."""
    settings = [(depth, size) for depth in depths for size in sizes]

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if frame.empty:
                continue
            vectors, labels = np.stack(frame["vector"].to_list()), frame["label"].to_numpy() == 1
            votes = np.zeros((len(depths), len(vectors)))
            decided = {}
            for number, tree in enumerate(trees, 1):
                for k, leaf in enumerate(tree.reached(vectors, depths)):
                    votes[k] += tree.decision[leaf] if len(trees) == 1 else tree.share[leaf]
                    if number in sizes:
                        decided[depths[k], number] = votes[k] * 2 > number
            rows = [(k, decided[s]) for k, s in enumerate(settings)]
            yield pd.DataFrame(
                [(k, int((labels & d).sum()), int((~labels & d).sum()), int((labels & ~d).sum())) for k, d in rows],
                columns=["Setting", *COUNTS],
            )

    rows = held.where(F.col(LABEL).isNotNull()).select(vector_to_array("vector").alias("vector"), F.col(LABEL).alias("label"))
    found = rows.mapInPandas(counted, "Setting int, " + ", ".join(f"{c} bigint" for c in COUNTS))
    summed = found.groupBy("Setting").agg(*[F.sum(c).alias(c) for c in COUNTS]).collect()
    return {settings[r["Setting"]]: tuple(r[c] for c in COUNTS) for r in summed}


def held_counts(model, held: DataFrame) -> tuple[int, ...]:
    scored = model.transform(held).select(F.col(LABEL).alias("Label"), F.col("prediction").alias("Decision"))
    counts = confusion_counts(F.col("Label"), F.col("Decision"))
    return tuple(scored.agg(*[counts[c].alias(c) for c in COUNTS]).first())


def nested_trees(fold: Fold) -> list[Trial]:
    model = CLASSIFIERS["DecisionTree"](maxDepth=max(TREE_DEPTHS)).fit(fold.fit)
    found = cut_counts(fold.held, grown_trees(model, fresh_folder(fold.fit)), TREE_DEPTHS, (1,))
    return [Trial("DecisionTree", (("maxDepth", str(d)),), fold.number, *c) for (d, _), c in found.items()]


def single_fit(name: str, shown: dict[str, float], options: Callable[[Fold], dict]) -> Callable[[Fold], list[Trial]]:
    def run(fold: Fold) -> list[Trial]:
        model = CLASSIFIERS[name](**options(fold)).fit(fold.fit)
        return [Trial(name, tuple((k, str(v)) for k, v in shown.items()), fold.number, *held_counts(model, fold.held))]

    return run


def penalty(strength: float) -> Callable[[Fold], dict]:
    """A penalty of the mean loss for a weight of the summed one."""
    return lambda fold: {"regParam": 1.0 / (strength * max(fold.rows, 1))}


def fits(model: str) -> list[Callable[[Fold], list[Trial]]]:
    """What one fold runs for a model, the dearest first."""
    if model == "DecisionTree":
        return [nested_trees]
    strengths = {"LogisticRegression": LOGISTIC_C, "LinearSVC": SVC_C}[model]
    return [single_fit(model, {"C": c}, penalty(c)) for c in strengths]


FITTED = ("LogisticRegression", "LinearSVC", "DecisionTree")
MODELS = ("RandomForest", *FITTED, "BoostedTrees", "KNN")


def fresh_folder(df: DataFrame) -> str:
    return f"{ensure_checkpoint_dir(df.sparkSession)}/model-{uuid.uuid4().hex}"


def tasks_per_fit(rows: int, side_by_side: int, cores: int) -> int:
    """Tasks of one of several fits: all of them together fill the cores, and a task's rows stay bounded.

    An iteration takes a task longer to start than to compute, so more tasks than that only add work to each.
    """
    return max(1, min(-(-rows // LEAST_ROWS), max(-(-cores // side_by_side), -(-rows // MOST_ROWS))))


def fold_parts(train: DataFrame, folds: int) -> list[Fold]:
    """What the folds fit on, kept, and hold out; only the columns of a fit."""
    rows = cut_lineage(with_folds(train, folds).select("Fold", LABEL, "Weight", "vector"))
    sizes = {r["Fold"]: r["count"] for r in rows.groupBy("Fold").count().collect()}
    total, out = sum(sizes.values()), []
    tasks = tasks_per_fit(total, folds, train.sparkSession.sparkContext.defaultParallelism)
    for number in range(folds):
        fit = rows.where(F.col("Fold") != number).coalesce(tasks).persist()
        held = rows.where(F.col("Fold") == number).coalesce(tasks)
        out.append(Fold(number, fit, held, total - sizes.get(number, 0)))
    return out


def neighbour_trials(train: DataFrame, folds: int, counts: Sequence[int] = NEIGHBOUR_COUNTS) -> list[Trial]:
    """Fold counts of the neighbour classifier; the neighbours of all folds and counts are found together."""
    rows = cut_lineage(with_folds(train, folds))
    found = nearest_rows(rows, rows, MODEL_FEATURES, LABEL, max(counts), fold="Fold")
    shares = [F.avg(F.when(F.col("Place") <= k, F.col("Target"))).alias(f"k{k}") for k in counts]
    voted = found.groupBy("Customer_ID").agg(*shares)
    scored = join_on(voted, rows.select("Customer_ID", "Fold", F.col(LABEL).alias("Label")), ["Customer_ID"])
    each = []
    for k in counts:
        decision = (F.col(f"k{k}") > 0.5).cast("int")
        each += [c.alias(f"{n}{k}") for n, c in confusion_counts(F.col("Label"), decision).items() if n in COUNTS]
    return [
        Trial("KNN", (("k", str(k)),), row["Fold"], *[row[f"{c}{k}"] for c in COUNTS])
        for row in scored.groupBy("Fold").agg(*each).collect()
        for k in counts
    ]


def boosted_trials(train: DataFrame, folds: int, rounds: int = BOOSTING_ROUNDS) -> list[Trial]:
    """Fold counts of the boosted classifiers of all settings and folds."""
    settings = [(fold, rate, depth) for fold in range(folds) for rate in BOOSTING_RATES for depth in BOOSTING_DEPTHS]
    models = [Model(*setting) for setting in settings]
    found = boosted_counts(with_folds(train, folds), F.col(LABEL), models, rounds)
    return [
        Trial("BoostedTrees", (("maxDepth", str(m.depth)), ("stepSize", str(m.rate))), m.fold, *found[k])
        for k, m in enumerate(models)
        if k in found
    ]


def forest_trials(train: DataFrame, folds: int) -> list[Trial]:
    """Fold counts of the forests; the trees of all folds grow in shared passes, smaller forests are cuts and prefixes."""
    found = forest_counts(with_folds(train, folds), "Customer_ID", LABEL, folds, FOREST_DEPTHS, FOREST_TREES)
    return [
        Trial("RandomForest", (("maxDepth", str(depth)), ("numTrees", str(size))), fold, *counts)
        for (fold, depth, size), counts in found.items()
    ]


def classifier_search(rows: DataFrame, folds: int = FOLDS, models: Sequence[str] = MODELS) -> DataFrame:
    """The published grids of the models named, by the mean and deviation of the F1 of the positive class.

    One row per setting: Model, Params, MeanScore, StdScore.
    """
    train = train_rows(rows)
    fitted = [name for name in FITTED if name in models]
    parts = fold_parts(train, folds) if fitted else []
    # The longest chain of jobs starts first; the others run beside it.
    jobs = [partial(boosted_trials, train, folds)] if "BoostedTrees" in models else []
    jobs += [partial(forest_trials, train, folds)] if "RandomForest" in models else []
    jobs += [partial(neighbour_trials, train, folds)] if "KNN" in models else []
    jobs += [partial(fit, part) for name in fitted for fit in fits(name) for part in parts]
    side_by_side = max(1, min(len(jobs), train.sparkSession.sparkContext.defaultParallelism))
    with ThreadPool(side_by_side) as pool:
        done = pool.map(inheritable_thread_target(train.sparkSession)(lambda job: job()), jobs, chunksize=1)
    for part in parts:
        part.fit.unpersist()
    trials = [trial for more in done for trial in more]
    return scored_trials(train.sparkSession, trials)


def scored_trials(spark, trials: list[Trial]) -> DataFrame:
    """Mean and deviation over the folds; at most a row per setting and fold comes in."""
    counted = spark.createDataFrame(
        [(t.model, dict(t.params), t.fold, t.hits or 0, t.wrong or 0, t.missed or 0) for t in trials],
        "Model string, Params map<string,string>, Fold int, Hits bigint, Wrong bigint, Missed bigint",
    )
    f1 = F.coalesce(ratio(2.0 * F.col("Hits"), 2 * F.col("Hits") + F.col("Wrong") + F.col("Missed")), F.lit(0.0))
    settings = counted.withColumn("Setting", F.to_json("Params"))
    scores = settings.groupBy("Model", "Setting").agg(F.avg(f1).alias("MeanScore"), F.stddev_pop(f1).alias("StdScore"))
    return scores.select(
        "Model", F.from_json("Setting", "map<string,string>").alias("Params"), "MeanScore", "StdScore"
    )


def flat_trials(trials: DataFrame) -> DataFrame:
    """The trials with one numeric column per parameter (null where a model has none)."""
    settings = [F.col("Params")[name].cast("double").alias(name) for name in PARAMETERS]
    return trials.select("Model", F.lit("F1").alias("Metric"), "MeanScore", "StdScore", *settings)


def best_trials(trials: DataFrame) -> DataFrame:
    """The best setting per model; of several the one with the least parameters, in the order of their names."""
    order = W.partitionBy("Model").orderBy(
        F.desc("MeanScore"), *[F.col("Params")[name].cast("double") for name in PARAMETERS]
    )
    first = trials.withColumn("_place", F.row_number().over(order)).where("_place = 1")
    return first.select("Model", F.col("MeanScore").alias("BestScore"), F.col("Params").alias("BestParams"))
