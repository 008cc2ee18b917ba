"""Boosted trees with Tweedie loss on the log link, out of Spark ML regression trees.

Every round fits a weighted tree to the Newton step of the loss, -gradient / hessian with the hessian
as weight, and adds a share of it to the margin. The margin is a column of the rows.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.functions.lineage import cut_lineage
from tillwise.operators.metrics import tweedie_deviance
from tillwise.operators.models import SCALED, _spend, calibrated_on_train, scaled_spend, train_rows

#: Rounds between two written copies of the rows.
WRITTEN_EVERY = 10


class Settings(NamedTuple):
    power: float = 1.5
    rounds: int = 100
    rate: float = 0.1
    depth: int = 3
    subsample: float = 0.8
    least_rows: int = 5


def newton_step(rows: DataFrame, power: float) -> DataFrame:
    """Add the step towards the least loss at the current margin, and its weight.

    Both terms of the hessian are positive for a power between 1 and 2, so the step lies between
    -1 / (2 - power) and 1 / (power - 1).
    """
    bought = F.col(SCALED) * F.exp((1 - power) * F.col("Margin"))
    expected = F.exp((2 - power) * F.col("Margin"))
    weight = (power - 1) * bought + (2 - power) * expected
    return rows.withColumns({"_step": (bought - expected) / weight, "_weight": weight})


def boosted_margin(rows: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, list[tuple[int, float]]]:
    """The scaled rows with their margin, and the mean train deviance after every tenth round.

    A round sees the training rows whose hash of id and round falls into its share.
    """
    state = cut_lineage(scaled_spend(rows).withColumn("Margin", F.lit(0.0)))
    path = [(0, train_deviance(state, settings.power))]
    tree = DecisionTreeRegressor(
        featuresCol="vector", labelCol="_step", weightCol="_weight", predictionCol="_leaf",
        maxDepth=settings.depth, minInstancesPerNode=settings.least_rows, seed=42,
    )
    for number in range(1, settings.rounds + 1):
        drawn = F.pmod(F.xxhash64("Customer_ID", F.lit(number)), F.lit(1000)) < int(1000 * settings.subsample)
        seen = newton_step(train_rows(state).where(drawn), settings.power).select("vector", "_step", "_weight")
        moved = tree.fit(seen).transform(state)
        state = moved.withColumn("Margin", F.col("Margin") + settings.rate * F.col("_leaf")).drop("_leaf")
        if number % WRITTEN_EVERY == 0 or number == settings.rounds:
            state = cut_lineage(state)
            path.append((number, train_deviance(state, settings.power)))
    return state, path


def train_deviance(state: DataFrame, power: float) -> float:
    return train_rows(state).agg(F.avg(tweedie_deviance(F.col(SCALED), F.exp("Margin"), power))).first()[0]


def boosted_spend(rows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Test spend by boosted Tweedie trees, calibrated on the training rows."""
    state, _ = boosted_margin(rows, settings)
    return calibrated_on_train(_spend(state, F.exp("Margin") * F.col("SpendMean")))
