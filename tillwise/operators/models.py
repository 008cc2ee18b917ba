"""Retention and spend models on Spark ML, from prepared feature rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import (
    DecisionTreeRegressor,
    GBTRegressor,
    GeneralizedLinearRegression,
    LinearRegression,
    RandomForestRegressor,
)
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions.columns import ratio
from tillwise.functions.joins import join_on
from tillwise.functions.lineage import cut_lineage
from tillwise.functions.ranking import hash_positions
from tillwise.operators.diagnostics import (
    calibrate,
    calibration_factor,
    clip_at_zero,
    smear,
    smearing_factor,
)
from tillwise.operators.features import fill_gap_with_sentinel
from tillwise.operators.metrics import rescale_scores
from tillwise.operators.preparation import (
    LOG_FEATURES,
    SCALE_FEATURES,
    class_weights,
    scaled_matrix,
    split_rows,
)


def majority_class(df: DataFrame, label: str) -> DataFrame:
    """The most frequent class and the accuracy of always choosing it."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("Rows"))
    total = counts.agg(F.sum("Rows").alias("_n"))
    return (
        counts.join(F.broadcast(total))
        .select(label, "Rows", ratio(F.col("Rows"), F.col("_n")).alias("Accuracy"))
        .orderBy(F.col("Rows").desc(), label)
        .limit(1)
    )


LABEL, SPEND = "RetentionLabel", "FutureSpend90Days"
MODEL_FEATURES = (*LOG_FEATURES, *SCALE_FEATURES)

CLASSIFIERS = {
    "LogisticRegression": lambda **o: LogisticRegression(
        featuresCol="vector", labelCol=LABEL, weightCol="Weight", regParam=o.get("regParam", 0.01), maxIter=100
    ),
    "DecisionTree": lambda **o: DecisionTreeClassifier(
        featuresCol="vector", labelCol=LABEL, weightCol="Weight", maxDepth=o.get("maxDepth", 5), seed=42
    ),
    "LinearSVC": lambda **o: LinearSVC(
        featuresCol="vector", labelCol=LABEL, weightCol="Weight", regParam=o.get("regParam", 0.01), maxIter=100
    ),
    "RandomForest": lambda **o: RandomForestClassifier(
        featuresCol="vector", labelCol=LABEL, weightCol="Weight", numTrees=o.get("numTrees", 100),
        maxDepth=o.get("maxDepth", 5), seed=42,
    ),
    "BoostedTrees": lambda **o: GBTClassifier(
        featuresCol="vector", labelCol=LABEL, maxIter=o.get("maxIter", 20), maxDepth=o.get("maxDepth", 3),
        stepSize=o.get("stepSize", 0.1), seed=42,
    ),
}
REGRESSORS = {
    "DecisionTree": lambda **o: DecisionTreeRegressor(
        featuresCol="vector", labelCol=SPEND, maxDepth=o.get("maxDepth", 5), seed=42
    ),
    "RandomForest": lambda **o: RandomForestRegressor(
        featuresCol="vector", labelCol=SPEND, numTrees=o.get("numTrees", 100), maxDepth=o.get("maxDepth", 5), seed=42
    ),
    "BoostedTrees": lambda **o: GBTRegressor(
        featuresCol="vector", labelCol=SPEND, maxIter=o.get("maxIter", 20), maxDepth=o.get("maxDepth", 3),
        stepSize=0.1, seed=42,
    ),
}
VARIANCE_POWERS = (1.1, 1.3, 1.5, 1.7, 1.9)


def model_rows(features: DataFrame, test_share: float = 0.2) -> DataFrame:
    """Prepared rows with vector, both targets, class weight and split, written once.

    Medians, means and deviations come from the training rows only.
    """
    parts = cut_lineage(split_rows(fill_gap_with_sentinel(features), test_share, [LABEL]))
    train = parts.where(F.col("Split") == "train")
    matrix = scaled_matrix(parts, fitted_on=train, keep=["Customer_ID", "Split", LABEL, SPEND])
    weights = class_weights(train, LABEL).select(F.col("Label").alias(LABEL), "Weight")
    vectors = VectorAssembler(inputCols=list(MODEL_FEATURES), outputCol="vector").transform(matrix)
    joined = join_on(vectors.withColumn(LABEL, F.col(LABEL).cast("int")), F.broadcast(weights), [LABEL], "left")
    return cut_lineage(joined)


def train_rows(rows: DataFrame) -> DataFrame:
    """The rows to fit on; those without a label can only be scored."""
    return rows.where((F.col("Split") == "train") & F.col(LABEL).isNotNull())


def test_rows(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("Split") == "test")


def score_classes(model, rows: DataFrame) -> DataFrame:
    """Label, positive-class score and decision. A margin without probability is rescaled."""
    scored = model.transform(rows)
    if "probability" in scored.columns:
        scored = scored.withColumn("Score", vector_to_array("probability")[1])
    else:
        scored = rescale_scores(scored.withColumn("Score", vector_to_array("rawPrediction")[1]), "Score")
    return scored.select(
        "Customer_ID", F.col(LABEL).alias("Label"), "Score", F.col("prediction").cast("int").alias("Decision")
    )


def classify(rows: DataFrame, name: str, **options) -> DataFrame:
    model = CLASSIFIERS[name](**options).fit(train_rows(rows))
    return score_classes(model, test_rows(rows))


def _spend(scored: DataFrame, value: Column) -> DataFrame:
    return scored.select(
        "Customer_ID", F.col(SPEND).alias("Actual"), clip_at_zero(value).alias("Predicted"), "Split"
    )


def calibrated_on_train(scored: DataFrame) -> DataFrame:
    """Scale the test predictions by the total ratio of the training rows."""
    rows = cut_lineage(scored)
    factor = calibration_factor(rows.where(F.col("Split") == "train"))
    return calibrate(rows.where(F.col("Split") == "test").drop("Split"), factor)


def regress(rows: DataFrame, name: str, **options) -> DataFrame:
    model = REGRESSORS[name](**options).fit(train_rows(rows))
    return calibrated_on_train(_spend(model.transform(rows), F.col("prediction")))


def ridge(strength: float = 0.1) -> LinearRegression:
    return LinearRegression(featuresCol="vector", labelCol="LogSpend", regParam=strength, elasticNetParam=0.0)


def ridge_on_log(rows: DataFrame, strength: float = 0.1) -> DataFrame:
    logged = rows.withColumn("LogSpend", F.log1p(SPEND))
    model = ridge(strength).fit(train_rows(logged))
    return _spend(model.transform(logged), F.expm1("prediction")).where(F.col("Split") == "test").drop("Split")


SCALED = "ScaledSpend"


def scaled_spend(rows: DataFrame) -> DataFrame:
    """The spend as a multiple of its training mean (``SpendMean``), near 1 for a stable fit.

    A log-link Tweedie model of the multiple is the same model of the spend.
    """
    mean = train_rows(rows).agg(F.avg(SPEND).alias("SpendMean"))
    return rows.join(F.broadcast(mean)).withColumn(
        SCALED, F.coalesce(ratio(F.col(SPEND), F.col("SpendMean")), F.lit(0.0))
    )


def tweedie(power: float, strength: float = 0.1) -> GeneralizedLinearRegression:
    return GeneralizedLinearRegression(
        featuresCol="vector", labelCol=SCALED, family="tweedie", variancePower=power, linkPower=0.0,
        regParam=strength, maxIter=25,
    )


def tweedie_spend(rows: DataFrame, power: float = 1.5) -> DataFrame:
    """Log-link Tweedie model of the spend with its many zeros, calibrated on the training rows."""
    scaled = cut_lineage(scaled_spend(rows))
    model = tweedie(power).fit(train_rows(scaled))
    return calibrated_on_train(_spend(model.transform(scaled), F.col("prediction") * F.col("SpendMean")))


def tweedie_search(rows: DataFrame, powers: Sequence[float] = VARIANCE_POWERS, folds: int = 5) -> DataFrame:
    """Mean and deviation of the fold error per variance power, in multiples of the mean spend."""
    estimator = tweedie(powers[0])
    grid = ParamGridBuilder().addGrid(estimator.variancePower, list(powers)).build()
    evaluator = RegressionEvaluator(labelCol=SCALED, predictionCol="prediction", metricName="rmse")
    return search(train_rows(scaled_spend(rows)), "Tweedie", estimator, grid, evaluator, folds)


def buyers_spend(strength: float = 0.1) -> GeneralizedLinearRegression:
    return GeneralizedLinearRegression(
        featuresCol="vector", labelCol=SPEND, family="gamma", link="log", regParam=strength, maxIter=25
    )


def two_stage_spend(rows: DataFrame) -> DataFrame:
    """Chance to buy times the spend expected from buyers; the second model sees buyers only."""
    train = train_rows(rows)
    buys = CLASSIFIERS["LogisticRegression"]().fit(train)
    amount = buyers_spend().fit(train.where(F.col(SPEND) > 0))
    chance = buys.transform(rows).withColumn("Chance", vector_to_array("probability")[1]).drop(
        "prediction", "probability", "rawPrediction"
    )
    return calibrated_on_train(_spend(amount.transform(chance), F.col("Chance") * F.col("prediction")))


def with_folds(rows: DataFrame, folds: int) -> DataFrame:
    """Fold numbers from the md5 order of the ids, even within each class."""
    placed = hash_positions(rows, "Customer_ID", [LABEL])
    return placed.withColumn("Fold", F.pmod(F.col("Position"), F.lit(folds)).cast("int")).drop(
        "Position", "StratumSize"
    )


def search(train: DataFrame, name: str, estimator, grid, evaluator, folds: int = 5) -> DataFrame:
    """One row per setting with the mean and deviation of the fold scores."""
    rows = cut_lineage(with_folds(train, folds))
    fitted = CrossValidator(
        estimator=estimator, estimatorParamMaps=grid, evaluator=evaluator, numFolds=folds,
        foldCol="Fold", parallelism=4,
    ).fit(rows)
    trials = [
        (name, {p.name: str(v) for p, v in setting.items()}, float(mean), float(std))
        for setting, mean, std in zip(grid, fitted.avgMetrics, fitted.stdMetrics)
    ]
    return train.sparkSession.createDataFrame(
        trials, "Model string, Params map<string,string>, MeanScore double, StdScore double"
    )


def log_stage(rows: DataFrame, rounds: int = 100) -> DataFrame:
    """The spend of buyers from boosted trees on its log, with the retransformation factor.

    Trees and factor come from the training rows that bought; the test rows that bought are scored.
    """
    bought = rows.where(F.col(SPEND) > 0).withColumn("LogActual", F.log1p(SPEND))
    train = train_rows(bought)
    model = GBTRegressor(featuresCol="vector", labelCol="LogActual", maxIter=rounds, maxDepth=3, stepSize=0.1, seed=42)
    fitted = model.fit(train.select("vector", "LogActual").coalesce(max(1, -(-train.count() // 50_000))))
    logs = cut_lineage(
        fitted.transform(bought).select("Customer_ID", "Split", "LogActual", F.col("prediction").alias("LogPredicted"))
    )
    factor = smearing_factor(logs.where(F.col("Split") == "train"))
    return smear(logs.where(F.col("Split") == "test").drop("Split"), factor)
