"""Customer segments: fits, scores, profiles, names and cards."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import BisectingKMeans, GaussianMixture
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillwise.functions import shared
from tillwise.functions.columns import ratio
from tillwise.functions.joins import attach, join_on
from tillwise.functions.lineage import cut_lineage
from tillwise.functions.ranking import exact_quantiles
from tillwise.operators.blocks import AT_ONCE, MAX_TASKS, Rough, matrix_of
from tillwise.operators.centroids import fit_many, nearest_labels, silhouettes_squared, vector_rows
from tillwise.operators.features import mark_missing_gap, require_columns
from tillwise.operators.pieces import TASKS_PER_CORE, each_piece
from tillwise.operators.preparation import scaled_matrix

# Parameters: rows of a block of the Euclidean silhouette, and of those that rows meet at once.
SILHOUETTE_ROWS = 16_000
COLUMNS_AT_ONCE = 1024

# The clustering features, log-scaled and plain.
CLUSTER_LOG = (
    "Frequency",
    "Monetary",
    "AvgBasketValue",
    "UniqueProducts",
    "SpendLast30Days",
    "SpendLast90Days",
    "RevenuePerDay",
    "AvgSpendPerProduct",
    "ProductDiversityRate",
    "RecencyFrequency",
)
CLUSTER_PLAIN = (
    "Recency",
    "AvgQuantity",
    "LifetimeDays",
    "PurchaseRate",
    "AvgGapDays",
    "AvgGapDaysMissing",
    "StdGapDays",
    "PurchasesLast30Days",
    "PurchasesLast90Days",
    "ReturnRate",
    "SpendTrendRatio",
    "FrequencyLast90DaysRatio",
    "IsNewCustomer",
)
CLUSTER_FEATURES = (*CLUSTER_LOG, *CLUSTER_PLAIN)

# Segment names and the texts of the segment cards.
BEST, NEW, INACTIVE, REGULAR = (
    "High-Value Loyalists",
    "New / One-Time Customers",
    "At-Risk Inactive Customers",
    "Regular Mid-Value Customers",
)
RECOMMENDATIONS = {
    BEST: "Protect with loyalty rewards, VIP campaigns, early access, and personalized recommendations.",
    REGULAR: "Grow using cross-sell offers, bundles, category recommendations, and moderate-value campaigns.",
    INACTIVE: "Reactivate using win-back discounts, reminder campaigns, and limited-time offers.",
    NEW: "Nurture using onboarding flows, first-repeat-purchase offers, and low-cost engagement campaigns.",
}
OTHER_RECOMMENDATION = "Use personalized campaigns based on recent purchase behavior."
INSIGHTS = {
    BEST: "Small but extremely valuable group that drives most future revenue.",
    REGULAR: "Largest stable customer group with moderate revenue potential.",
    INACTIVE: "Previously active customers whose long recency makes them risky.",
    NEW: "Low-frequency customers with limited history and high zero-spend risk.",
}
OTHER_INSIGHT = "Behaviorally distinct customer group."

# Names of the profile measures and the columns they average.
PROFILE_MEANS = {
    "AvgRecency": "Recency",
    "AvgFrequency": "Frequency",
    "AvgMonetary": "Monetary",
    "AvgBasketValue": "AvgBasketValue",
    "AvgQuantity": "AvgQuantity",
    "UniqueProducts_mean": "UniqueProducts",
    "LifetimeDays_mean": "LifetimeDays",
    "PurchaseRate_mean": "PurchaseRate",
    "AvgGapDays": "AvgGapDays",
    "StdGapDays_mean": "StdGapDays",
    "PurchasesLast30Days_mean": "PurchasesLast30Days",
    "SpendLast30Days_mean": "SpendLast30Days",
    "PurchasesLast90Days_mean": "PurchasesLast90Days",
    "SpendLast90Days_mean": "SpendLast90Days",
    "ReturnRate_mean": "ReturnRate",
    "RevenuePerDay_mean": "RevenuePerDay",
    "AvgSpendPerProduct_mean": "AvgSpendPerProduct",
    "ProductDiversityRate_mean": "ProductDiversityRate",
    "RecencyFrequency_mean": "RecencyFrequency",
    "SpendTrendRatio_mean": "SpendTrendRatio",
    "FrequencyLast90DaysRatio_mean": "FrequencyLast90DaysRatio",
    "IsNewCustomer_mean": "IsNewCustomer",
    "AvgFutureSpend90Days": "FutureSpend90Days",
}
# The measures of the profile heatmap.
HEATMAP = (
    "AvgRecency",
    "AvgFrequency",
    "AvgMonetary",
    "AvgBasketValue",
    "AvgFutureSpend90Days",
    "RetentionRate_Pct",
    "ZeroFutureSpendRate_Pct",
    "CustomerShare_Pct",
    "FutureRevenueShare_Pct",
)


def cluster_matrix(features: DataFrame, keep: Sequence[str] = ("Customer_ID",)) -> DataFrame:
    """The scaled clustering features per customer, beside the kept columns."""
    marked = mark_missing_gap(features)
    require_columns(marked, CLUSTER_FEATURES)
    return scaled_matrix(marked, CLUSTER_LOG, CLUSTER_PLAIN, keep=keep)


def assembled(matrix: DataFrame, columns: Sequence[str] = CLUSTER_FEATURES) -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol="vector").transform(matrix)


def principal_components(matrix: DataFrame, columns: Sequence[str], k: int) -> DataFrame:
    """Coordinates on the first components and the share of variance they explain."""
    vectors = assembled(matrix, columns).select("Customer_ID", "vector")
    model = PCA(k=k, inputCol="vector", outputCol="pc").fit(vectors)
    explained = float(model.explainedVariance.toArray().sum())
    values = vector_to_array("pc")
    return model.transform(vectors).select(
        "Customer_ID",
        *[values[i].alias(f"PCA{i + 1}") for i in range(k)],
        F.lit(explained).alias("ExplainedVariance"),
    )


def labelled(model, vectors: DataFrame) -> DataFrame:
    return model.transform(vectors).withColumnRenamed("prediction", "Cluster")


def kmeans_labels(matrix: DataFrame, k: int = 4, starts: int = 20) -> DataFrame:
    """(Customer_ID, Cluster) of the k-means fit of least cost out of several starts."""
    rows = cut_lineage(vector_rows(matrix, CLUSTER_FEATURES))
    return nearest_labels(rows, fit_many(rows, [k], starts)).select(
        F.col("Id").alias("Customer_ID"), F.col(f"K{k}").alias("Cluster")
    )


def mixture_labels(vectors: DataFrame, k: int = 4) -> DataFrame:
    return labelled(GaussianMixture(k=k, seed=42, featuresCol="vector").fit(vectors), vectors)


def divisive_labels(vectors: DataFrame, k: int = 4) -> DataFrame:
    return labelled(BisectingKMeans(k=k, seed=42, featuresCol="vector").fit(vectors), vectors)


def silhouette_squared(labels: DataFrame) -> float:
    """Silhouette on squared Euclidean distance: linear in the rows, the one for large tables."""
    return ClusteringEvaluator(
        featuresCol="vector", predictionCol="Cluster", distanceMeasure="squaredEuclidean"
    ).evaluate(labels)


def silhouette_euclidean(
    matrix: DataFrame,
    columns: Sequence[str],
    labels: Sequence[str],
    identifier: str = "Customer_ID",
    block_rows: int = SILHOUETTE_ROWS,
) -> DataFrame:
    """Silhouette on Euclidean distance over all rows, one line per label column.

    Every row meets every other one, so the work grows with the square of the rows; every row is written
    once, in a block that tasks read, and a task returns the sum of its rows' silhouettes. Null labels (noise)
    are left out. Null with fewer than two clusters.
    """
    names = list(labels)
    spark = matrix.sparkSession
    rows = cut_lineage(
        matrix.select(
            F.col(identifier).cast("string").alias("Id"),
            F.array(*[F.col(c).cast("double") for c in columns]).alias("Vector"),
            F.array(*[F.col(c).cast("string") for c in names]).alias("Labels"),
        )
    )
    blocks = max(1, -(-rows.count() // block_rows))
    folder = shared.shared_folder(spark, "silhouette")

    def kept(block: pa.Table) -> pa.Table:
        path = shared.save(folder, block.drop_columns(["_block"]))
        return pa.table([block.column("_block").slice(0, 1).combine_chunks(), pa.array([path])], names=["Block", "Path"])

    dealt = rows.withColumn("_block", F.pmod(F.xxhash64("Id"), F.lit(blocks)).cast("int")).repartition(min(blocks, MAX_TASKS), "_block")
    paths = [r["Path"] for r in sorted(dealt.groupBy("_block").applyInArrow(kept, "Block int, Path string").collect())]
    sizes_of = (
        rows.select(F.posexplode("Labels").alias("At", "Cluster")).where(F.col("Cluster").isNotNull()).groupBy("At", "Cluster").count().collect()
    )
    sizes: list[dict[str, int]] = [{} for _ in names]
    for r in sizes_of:
        sizes[r["At"]][r["Cluster"]] = r["count"]
    # A block has so many tasks that all cores have work; each takes a share of its rows past all blocks.
    shares = max(1, -(-TASKS_PER_CORE * spark.sparkContext.defaultParallelism // max(1, len(paths))))

    def scored(number: int) -> Iterator[pa.Table]:
        block, share = divmod(number, shares)
        mine = shared.load(paths[block])
        size = -(-len(mine) // shares)
        mine = mine.slice(share * size, size)
        if not len(mine):
            return
        here, ours = matrix_of(mine, "Vector"), np.array(mine.column("Labels").to_pylist(), object).reshape(len(mine), -1)
        held = [sorted(found) for found in sizes]
        totals = [np.zeros((len(here), len(found))) for found in held]
        for path in paths:
            table = shared.load(path)
            there, theirs = matrix_of(table, "Vector"), np.array(table.column("Labels").to_pylist(), object).reshape(len(table), -1)
            member = [(theirs[:, t, None] == np.array(found, object)[None]).astype(float) for t, found in enumerate(held)]
            # Rows meet some columns at a time, which stay in the processor's cache.
            for first in range(0, len(there), COLUMNS_AT_ONCE):
                columns = slice(first, first + COLUMNS_AT_ONCE)
                rough = Rough(there[columns], 2)
                for start in range(0, len(here), AT_ONCE):
                    some = slice(start, start + AT_ONCE)
                    squares, _ = rough.to(here[some])
                    apart = np.sqrt(np.maximum(squares, 0.0, out=squares), out=squares)
                    for total, marks in zip(totals, member, strict=True):
                        total[some] += apart @ marks[columns]
        for t, (name, found, total) in enumerate(zip(names, held, totals, strict=True)):
            own = np.array([found.index(v) if v is not None else -1 for v in ours[:, t]])
            rows_of = np.flatnonzero(own >= 0)
            if len(found) < 2 or not len(rows_of):
                continue
            count, own, total = np.array([sizes[t][v] for v in found], float), own[rows_of], total[rows_of]
            line = np.arange(len(rows_of))
            inner = total[line, own] / np.maximum(count[own] - 1, 1)
            outer = total / count
            outer[line, own] = np.inf
            outer = outer.min(axis=1)
            top = np.maximum(inner, outer)
            value = np.where((count[own] > 1) & (top > 0), (outer - inner) / np.where(top > 0, top, 1), 0.0)
            yield pa.table([pa.array([name]), pa.array([value.sum()]), pa.array([len(value)], pa.int64())], names=["Label", "Total", "Rows"])

    parts = each_piece(spark, len(paths) * shares, lambda: scored, "Label string, Total double, Rows bigint")
    found = parts.groupBy("Label").agg((F.sum("Total") / F.sum("Rows")).alias("Silhouette"))
    labelled_rows = [name for name, known in zip(names, sizes, strict=True) if known]
    every = spark.createDataFrame([(name,) for name in labelled_rows], "Label string")
    return every.join(found, "Label", "left")


def cluster_sums(matrix: DataFrame, columns: Sequence[str], label: str, by: Sequence[str] = ()) -> DataFrame:
    """Per cluster: rows, centre and the squared deviations from it."""
    inner = sum((F.var_pop(c) * F.count(c) for c in columns), F.lit(0.0))
    return matrix.groupBy(*by, label).agg(
        F.count(F.lit(1)).alias("Size"), inner.alias("Within"), *[F.avg(c).alias(f"_c_{c}") for c in columns]
    )


def calinski_harabasz(matrix: DataFrame, columns: Sequence[str], label: str, by: Sequence[str] = ()) -> DataFrame:
    clusters = cluster_sums(matrix, columns, label, by)
    inside = clusters.groupBy(*by).agg(
        F.sum("Within").alias("_w"), F.count(F.lit(1)).alias("_k"), F.sum("Size").alias("_n")
    )
    whole = sum((F.var_pop(c) * F.count(c) for c in columns), F.lit(0.0))
    total = matrix.groupBy(*by).agg(whole.alias("_t"))
    joined = join_on(inside, total, by) if by else inside.join(F.broadcast(total))
    between = F.col("_t") - F.col("_w")
    score = ratio(between * (F.col("_n") - F.col("_k")), F.col("_w") * (F.col("_k") - 1))
    return joined.select(*by, F.when(F.col("_k") > 1, score).alias("CalinskiHarabasz"))


def davies_bouldin(matrix: DataFrame, columns: Sequence[str], label: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean over clusters of the worst (spread + spread) / centre distance."""
    keys = [*by, label]
    centres = cut_lineage(cluster_sums(matrix, columns, label, by).drop("Within", "Size"))

    def apart(left: str, right: str) -> Column:
        return F.sqrt(sum(((F.col(left.format(c)) - F.col(right.format(c))) ** 2 for c in columns), F.lit(0.0)))

    spread = (
        attach(matrix, centres, keys)
        .groupBy(*keys)
        .agg(F.avg(apart("{}", "_c_{}")).alias("_s"))
    )
    known = cut_lineage(centres.join(spread, keys))
    other = known.select(*by, *[F.col(c).alias(f"_o{c}") for c in known.columns if c not in by])
    condition = F.col(label) != F.col(f"_o{label}")
    pairs = known.join(other, list(by)).where(condition) if by else known.join(other, condition)
    worst = pairs.groupBy(*keys).agg(
        F.max(ratio(F.col("_s") + F.col("_o_s"), apart("_c_{}", "_o_c_{}"))).alias("_r")
    )
    return worst.groupBy(*by).agg(F.avg("_r").alias("DaviesBouldin"))


def k_search(matrix: DataFrame, ks: Sequence[int], starts: int = 20) -> DataFrame:
    """Inertia and three scores for each number of clusters, all fitted together."""
    rows = cut_lineage(vector_rows(matrix, CLUSTER_FEATURES))
    fits = fit_many(rows, list(ks), starts)
    names = [f"K{k}" for k in ks]
    labels = nearest_labels(rows, fits).withColumnRenamed("Id", "Customer_ID")
    placed = cut_lineage(matrix.select("Customer_ID", *CLUSTER_FEATURES).join(labels, "Customer_ID"))
    long = placed.unpivot(["Customer_ID", *CLUSTER_FEATURES], names, "Label", "Cluster")
    scores = (
        silhouettes_squared(placed, CLUSTER_FEATURES, names)
        .join(davies_bouldin(long, CLUSTER_FEATURES, "Cluster", ["Label"]), "Label")
        .join(calinski_harabasz(long, CLUSTER_FEATURES, "Cluster", ["Label"]), "Label")
    )
    inertia = F.create_map(*[F.lit(v) for k in ks for v in (f"K{k}", float(fits[k].cost))])
    return scores.select(
        F.substring("Label", 2, 3).cast("int").alias("K"),
        inertia[F.col("Label")].alias("Inertia"),
        "SilhouetteSquared",
        "DaviesBouldin",
        "CalinskiHarabasz",
    )


def rule_clusters(features: DataFrame) -> DataFrame:
    """Four groups by median recency and frequency: repeatable labels for checks."""
    middle = exact_quantiles(features, ["Recency", "Frequency"], {"Median": 0.5}).agg(
        F.max(F.when(F.col("Measure") == "Recency", F.col("Median"))).alias("_r"),
        F.max(F.when(F.col("Measure") == "Frequency", F.col("Median"))).alias("_f"),
    )
    code = (F.col("Recency") > F.col("_r")).cast("int") + 2 * (F.col("Frequency") > F.col("_f")).cast("int")
    return features.join(F.broadcast(middle)).withColumn("Cluster", code).drop("_r", "_f")


def cluster_counts(labels: DataFrame, label: str = "Cluster") -> DataFrame:
    return labels.groupBy(label).agg(F.count(F.lit(1)).alias("Customers"))


def join_labels(features: DataFrame, labels: dict[str, DataFrame]) -> DataFrame:
    """Each labelling as a column beside the customer features."""
    for name, frame in labels.items():
        features = features.join(frame.select("Customer_ID", F.col("Cluster").alias(name)), "Customer_ID", "left")
    return features


def cluster_profile(customers: DataFrame, label: str = "Cluster") -> DataFrame:
    """Size, means, revenue and retention per cluster, with shares of the whole."""
    future = F.col("FutureSpend90Days")
    missing = F.col("AvgGapDays").isNull().cast("double")
    sums = customers.groupBy(label).agg(
        F.count(F.lit(1)).alias("ClusterSize"),
        *[F.avg(F.col(c).cast("double")).alias(n) for n, c in PROFILE_MEANS.items()],
        F.sum("Monetary").alias("TotalHistoricalRevenue"),
        (F.avg(missing) * 100).alias("AvgGapDaysMissingRate_Pct"),
        F.sum(future).alias("TotalFutureRevenue"),
        (F.avg((future > 0).cast("double")) * 100).alias("RetentionRate_Pct"),
        (F.avg((future == 0).cast("double")) * 100).alias("ZeroFutureSpendRate_Pct"),
    )
    total = customers.agg(F.count(F.lit(1)).alias("_n"), F.sum(future).alias("_f"))
    return (
        sums.join(F.broadcast(total))
        .withColumns(
            {
                "CustomerShare_Pct": ratio(F.col("ClusterSize"), F.col("_n")) * 100,
                "FutureRevenueShare_Pct": ratio(F.col("TotalFutureRevenue"), F.col("_f")) * 100,
            }
        )
        .drop("_n", "_f")
    )


def _rank(column: str, descending: bool) -> Column:
    """Rank among the clusters, ties share the mean rank. Rows here are clusters."""
    order = F.col(column).desc() if descending else F.col(column).asc()
    everything = W.partitionBy(F.lit(0))
    ties = F.count(F.lit(1)).over(W.partitionBy(column))
    return F.rank().over(everything.orderBy(order)) + (ties - 1) / F.lit(2.0)


def profile_ranks(profile: DataFrame) -> DataFrame:
    return profile.withColumns(
        {
            "RevenueRank": _rank("AvgFutureSpend90Days", True),
            "RetentionRank": _rank("RetentionRate_Pct", True),
            "RecencyRank": _rank("AvgRecency", False),
            "FrequencyRank": _rank("AvgFrequency", True),
        }
    )


def name_segments(profile: DataFrame, label: str = "Cluster") -> DataFrame:
    """Best by future spend, new by share of new customers, inactive by recency, else regular.

    A cluster that wins twice keeps the first of these names.
    """

    def winner(*order: Column) -> Column:
        return F.min_by(label, F.struct(*order, F.col(label)))

    picks = profile.agg(
        winner(-F.col("AvgFutureSpend90Days"), -F.col("RetentionRate_Pct"), -F.col("AvgFrequency")).alias("_best"),
        winner(-F.col("IsNewCustomer_mean"), F.col("AvgFrequency")).alias("_new"),
        winner(-F.col("AvgRecency"), -F.col("ZeroFutureSpendRate_Pct")).alias("_inactive"),
    )
    cluster = F.col(label)
    name = (
        F.when(cluster == F.col("_best"), BEST)
        .when(cluster == F.col("_new"), NEW)
        .when(cluster == F.col("_inactive"), INACTIVE)
        .otherwise(REGULAR)
    )
    return profile.join(F.broadcast(picks)).withColumn("SegmentName", name).drop("_best", "_new", "_inactive")


def segment_customers(customers: DataFrame, named: DataFrame, label: str = "Cluster") -> DataFrame:
    return attach(customers, named.select(label, "SegmentName"), [label])


def feature_means(customers: DataFrame, label: str = "Cluster") -> DataFrame:
    return customers.groupBy(label).agg(
        *[F.avg(F.col(c).cast("double")).alias(c) for c in CLUSTER_FEATURES]
    )


def _text(texts: dict[str, str], other: str) -> Column:
    chosen = F.lit(other)
    for name, text in texts.items():
        chosen = F.when(F.col("SegmentName") == name, text).otherwise(chosen)
    return chosen


def segment_cards(named: DataFrame, label: str = "Cluster") -> DataFrame:
    return named.select(
        label,
        "SegmentName",
        "ClusterSize",
        "CustomerShare_Pct",
        "AvgRecency",
        "AvgFrequency",
        "AvgMonetary",
        "AvgFutureSpend90Days",
        "TotalFutureRevenue",
        "FutureRevenueShare_Pct",
        "RetentionRate_Pct",
        "ZeroFutureSpendRate_Pct",
        _text(INSIGHTS, OTHER_INSIGHT).alias("Insight"),
        _text(RECOMMENDATIONS, OTHER_RECOMMENDATION).alias("Recommendation"),
    )


def profile_heatmap(profile: DataFrame, label: str = "Cluster") -> DataFrame:
    """Profile measures as deviations from the mean over clusters, population scale."""
    everything = W.partitionBy(F.lit(0))

    def scaled(name: str) -> Column:
        value = F.col(name)
        spread = F.stddev_pop(value).over(everything)
        return ratio(value - F.avg(value).over(everything), spread).alias(name)

    return profile.select(label, *[scaled(c) for c in HEATMAP])


def compare_clusterings(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.col("SilhouetteSquared").desc_nulls_last(), "Model")
