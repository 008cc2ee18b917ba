"""Which features move a score, and by how much."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions.columns import numeric_columns, ratio
from tillwise.functions.lineage import cut_lineage
from tillwise.functions.ranking import hash_positions, running_totals
from tillwise.operators.preparation import finite_or_median

# Columns that are identifiers, labels or segment results, not features.
NOT_FEATURES = (
    "Customer_ID",
    "Cluster",
    "KMeans_Cluster",
    "SegmentName",
    "FutureSpend90Days",
    "RetentionLabel",
)


def feature_frame(df: DataFrame) -> DataFrame:
    """Numeric columns that are not ids or labels, infinite and missing values filled."""
    names = [c for c in numeric_columns(df) if c not in NOT_FEATURES]
    return finite_or_median(df.select("Customer_ID", *names), names)


def contributions(matrix: DataFrame, weights: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Per row and feature, weight times deviation from the mean: exact for a linear model.

    ``weights`` is one row with a weight per feature column.
    """
    means = matrix.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns])
    betas = weights.select(*[F.col(c).alias(f"_b_{c}") for c in columns])
    rows = matrix.join(F.broadcast(means)).join(F.broadcast(betas))
    return rows.select(
        "Customer_ID",
        *keep,
        *[F.col(c) for c in columns],
        *[(F.col(f"_b_{c}") * (F.col(c) - F.col(f"_m_{c}"))).alias(f"_a_{c}") for c in columns],
    )


def mean_attribution(given: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Features by mean absolute contribution, largest first, from one aggregate."""
    one = given.agg(*[F.avg(F.abs(F.col(f"_a_{c}"))).alias(c) for c in columns])
    return one.unpivot([], list(columns), "Feature", "MeanAbsAttribution").orderBy(
        F.col("MeanAbsAttribution").desc(), "Feature"
    )


def pick_cases(scored: DataFrame) -> DataFrame:
    """Highest and lowest score, and the first false positive and false negative by id."""
    wrong_up = (F.col("Decision") == 1) & (F.col("Label") == 0)
    wrong_down = (F.col("Decision") == 0) & (F.col("Label") == 1)
    picks = scored.agg(
        F.min_by("Customer_ID", F.struct(-F.col("Score"), F.col("Customer_ID"))).alias("highest_score"),
        F.min_by("Customer_ID", F.struct("Score", "Customer_ID")).alias("lowest_score"),
        F.min(F.when(wrong_up, F.col("Customer_ID"))).alias("false_positive"),
        F.min(F.when(wrong_down, F.col("Customer_ID"))).alias("false_negative"),
    )
    return picks.unpivot([], list(picks.columns), "Case", "Customer_ID").where(
        F.col("Customer_ID").isNotNull()
    )


def _long(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("Feature"), F.col(c).alias("Value"), F.col(f"_a_{c}").alias("Attribution"))
            for c in columns
        ]
    )
    return rows.select(*keys, F.inline(pairs))


def case_contributions(given: DataFrame, cases: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The contributions of the picked customers, one line per case and feature."""
    return _long(given.join(F.broadcast(cases), "Customer_ID"), ["Case", "Customer_ID"], columns)


def dependence(given: DataFrame, columns: Sequence[str], top: int = 5) -> DataFrame:
    """Value and contribution of every customer for the features that matter most."""
    best = mean_attribution(given, columns).limit(top).select("Feature")
    return _long(given, ["Customer_ID"], columns).join(F.broadcast(best), "Feature")


def model_weights(spark, columns: Sequence[str], coefficients: Sequence[float]) -> DataFrame:
    """Coefficients of a linear model as the one-row frame ``contributions`` takes."""
    return spark.range(1).select(*[F.lit(float(v)).alias(c) for c, v in zip(columns, coefficients)])


def importances(spark, columns: Sequence[str], model, name: str) -> DataFrame:
    """Tree importances as a frame: one row per feature."""
    values = model.featureImportances.toArray()
    rows = [(c, float(v)) for c, v in zip(columns, values)]
    return spark.createDataFrame(rows, f"Feature string, {name} double")


def _auc_by(scores: DataFrame, by: str) -> DataFrame:
    counts = scores.groupBy(by, "Score").agg(
        F.count_if(F.col("Label") == 1).alias("p"), F.count_if(F.col("Label") == 0).alias("n")
    )
    rows = running_totals(counts, [F.col("Score").desc()], {"fp": F.col("n")}, [by])
    area = F.sum(F.col("p") * (F.col("fp") - F.col("n") / F.lit(2.0)))
    return rows.groupBy(by).agg((1 - ratio(area, F.sum("p") * F.sum("n"))).alias("RocAuc"))


def permutation_importance(model, rows: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """Loss of ROC AUC when one feature is taken from another customer.

    Partners come from two md5 orders of the ids, matched by position. Every row is scored
    once as it is and once per feature with the partner's value.
    """
    first = hash_positions(rows.select("Customer_ID", label, *columns), "Customer_ID").drop("StratumSize")
    other = hash_positions(
        rows.select(F.concat("Customer_ID", F.lit("#")).alias("Other"), F.struct(*columns).alias("Partner")), "Other"
    ).select("Position", "Partner")
    paired = cut_lineage(first.join(other, "Position"))

    def variant(swapped: str | None) -> Column:
        values = [F.col(f"Partner.{c}") if c == swapped else F.col(c) for c in columns]
        return F.struct(
            F.lit(swapped or "").alias("Feature"), *[v.alias(f"v{i}") for i, v in enumerate(values)]
        )

    variants = paired.select(
        F.col(label).alias("Label"), F.inline(F.array(*[variant(c) for c in (None, *columns)]))
    )
    vectors = VectorAssembler(inputCols=[f"v{i}" for i in range(len(columns))], outputCol="vector").transform(variants)
    scores = model.transform(vectors).select("Feature", "Label", vector_to_array("probability")[1].alias("Score"))
    areas = cut_lineage(_auc_by(scores, "Feature"))
    base = areas.where(F.col("Feature") == "").select(F.col("RocAuc").alias("_base"))
    return (
        areas.where(F.col("Feature") != "")
        .join(F.broadcast(base))
        .select("Feature", "RocAuc", (F.col("_base") - F.col("RocAuc")).alias("AucLoss"))
        .orderBy(F.col("AucLoss").desc(), "Feature")
    )
