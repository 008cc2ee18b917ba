"""Registered queries: segmentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillwise.functions.columns import settled
from tillwise.functions.lineage import cut_lineage
from tillwise.operators import density as de
from tillwise.operators import segments as sg
from tillwise.operators.centroids import silhouettes_squared
from tillwise.plans.inputs import kept_features
from tillwise.plans.oracle import r, ra, rounded, with_tables
from tillwise.plans.preparation import matrix_sql

TRIALS = [(e, m) for e in de.REACHES for m in de.MIN_SAMPLES]


def matrix(spark, folder):
    return cut_lineage(sg.cluster_matrix(kept_features(spark, folder)))


def vectors(spark, folder):
    return sg.assembled(matrix(spark, folder))


def ruled(spark, folder):
    return cut_lineage(sg.rule_clusters(kept_features(spark, folder)))


def ruled_matrix(spark, folder):
    """The scaled features with the rule labels."""
    return cut_lineage(sg.cluster_matrix(ruled(spark, folder), ["Customer_ID", "Cluster"]))


def fitted(fit):
    def query(spark, folder):
        return fit(vectors(spark, folder)).select("Customer_ID", "Cluster")

    return query


def rule_score(score):
    return lambda spark, folder: settled(score(ruled_matrix(spark, folder)), 5)


def squared_silhouette(spark, folder):
    rows = sg.assembled(ruled_matrix(spark, folder))
    score = sg.silhouette_squared(rows)
    return settled(rows.agg(F.count(F.lit(1)).alias("Rows")).withColumn("Silhouette", F.lit(score)), 5)


def density_labels(spark, folder):
    return de.density_clusters(matrix(spark, folder), sg.CLUSTER_FEATURES, [(REACH, LEAST)]).select(
        "Customer_ID", "Cluster"
    )


def density_trials(rows, trials):
    """Every trial with its counts and the scores over its clustered rows."""
    return de.trial_scores(de.density_fit(rows, sg.CLUSTER_FEATURES, trials), rows.sparkSession)


def density_search(spark, folder):
    return density_trials(matrix(spark, folder), TRIALS)


def density_choice(spark, folder):
    return de.choose_trial(cut_lineage(density_search(spark, folder)))


def comparison(spark, folder):
    """The four clusterings with their scores, best silhouette first."""
    rows = matrix(spark, folder)
    prepared = sg.assembled(rows)
    found = {
        "KMeans": sg.kmeans_labels(rows),
        "Divisive": sg.divisive_labels(prepared),
        "GaussianMixture": sg.mixture_labels(prepared),
        "Density": de.density_clusters(rows, sg.CLUSTER_FEATURES, [(2.0, 20)]),
    }
    whole = cut_lineage(sg.join_labels(rows, found))
    names = list(found)
    silhouettes = silhouettes_squared(whole, sg.CLUSTER_FEATURES, names)
    labels = whole.select(
        "Customer_ID", *sg.CLUSTER_FEATURES, *[F.col(n).cast("string").alias(n) for n in names]
    ).unpivot(["Customer_ID", *sg.CLUSTER_FEATURES], names, "Label", "Cluster")
    noise = F.count_if(F.col("Cluster").isNull())
    counts = labels.groupBy("Label").agg(
        F.countDistinct("Cluster").alias("Clusters"),
        noise.alias("NoiseCount"),
        (noise / F.count(F.lit(1)) * 100).alias("Noise_Pct"),
    )
    placed = cut_lineage(labels.where(F.col("Cluster").isNotNull()))
    scored = (
        counts.join(silhouettes, "Label", "left")
        .join(sg.davies_bouldin(placed, sg.CLUSTER_FEATURES, "Cluster", ["Label"]), "Label", "left")
        .join(sg.calinski_harabasz(placed, sg.CLUSTER_FEATURES, "Cluster", ["Label"]), "Label", "left")
    )
    return sg.compare_clusterings(scored.withColumnRenamed("Label", "Model"))


def named(spark, folder):
    return named_segments(ruled(spark, folder))


def named_segments(customers):
    return sg.name_segments(sg.profile_ranks(cut_lineage(sg.cluster_profile(customers))))


def segmented(spark, folder):
    customers = ruled(spark, folder)
    return sg.segment_customers(customers, sg.name_segments(sg.cluster_profile(customers)))


QUERIES = {
    "seg01_scaled_matrix": lambda s, d: settled(sg.cluster_matrix(kept_features(s, d)), 5),
    "seg02_kmeans": lambda s, d: sg.kmeans_labels(matrix(s, d)),
    "seg03_k_search": lambda s, d: sg.k_search(matrix(s, d), range(2, 11)),
    "seg04_silhouette": rule_score(
        lambda m: sg.silhouette_euclidean(m, sg.CLUSTER_FEATURES, ["Cluster"])
    ),
    "seg04_silhouette_squared": squared_silhouette,
    "seg05_davies_bouldin": rule_score(
        lambda m: sg.davies_bouldin(m, sg.CLUSTER_FEATURES, "Cluster")
    ),
    "seg06_calinski_harabasz": rule_score(
        lambda m: sg.calinski_harabasz(m, sg.CLUSTER_FEATURES, "Cluster")
    ),
    "seg07_density_clusters": density_labels,
    "seg07_density_search": density_search,
    "seg08_density_choice": density_choice,
    "seg09_gaussian_mixture": fitted(sg.mixture_labels),
    "seg10_divisive": fitted(sg.divisive_labels),
    "seg11_comparison": comparison,
    "seg12_cluster_counts": lambda s, d: sg.cluster_counts(ruled(s, d)),
    "seg13_profile": lambda s, d: settled(sg.cluster_profile(ruled(s, d)), 4),
    "seg14_profile_ranks": lambda s, d: sg.profile_ranks(sg.cluster_profile(ruled(s, d))).select(
        "Cluster", "RevenueRank", "RetentionRank", "RecencyRank", "FrequencyRank"
    ),
    "seg15_segment_names": lambda s, d: named(s, d).select("Cluster", "SegmentName"),
    "seg16_feature_means": lambda s, d: settled(
        sg.feature_means(sg.mark_missing_gap(ruled(s, d))), 3
    ),
    "seg17_segment_cards": lambda s, d: settled(sg.segment_cards(named(s, d)), 4),
    "seg18_profile_heatmap": lambda s, d: settled(sg.profile_heatmap(sg.cluster_profile(ruled(s, d)))),
}

MARKED = "marked as (select *, cast(AvgGapDays is null as int) as AvgGapDaysMissing from features)"
MATRIX = matrix_sql(sg.CLUSTER_LOG, sg.CLUSTER_PLAIN, "marked", "marked")
RULED = """
ruled as (
  select *, cast(Recency > (select median(Recency) from features) as int)
          + 2 * cast(Frequency > (select median(Frequency) from features) as int) as Cluster
  from marked)
"""
RULED_MATRIX = matrix_sql(sg.CLUSTER_LOG, sg.CLUSTER_PLAIN, "marked", "ruled")
_COLUMNS = ", ".join(sg.CLUSTER_FEATURES)
PAIRS = f"""
points as (select Customer_ID, Cluster, [{_COLUMNS}] as v from matrix),
sizes as (select Cluster, count(*) as n from points group by 1),
reach as (
  select a.Customer_ID, a.Cluster as own, b.Cluster as other, sum(list_distance(a.v, b.v)) as total,
    sum(pow(list_distance(a.v, b.v), 2)) as squares
  from points a, points b group by 1, 2, 3)
"""


def _silhouette(total):
    return f"""
    sides as (
      select Customer_ID, max(case when own = other then {total} / nullif(n - 1, 0) end) as a,
        min(case when own <> other then {total} / n end) as b, max(case when own = other then n end) as n
      from reach join sizes on other = Cluster group by 1),
    result as (select avg(case when n = 1 then 0 else coalesce((b - a) / nullif(greatest(a, b), 0), 0) end) as s,
               count(*) as rows_seen from sides)"""


PROFILE = f"""
profile as (
  select Cluster, count(*) as ClusterSize,
    {', '.join(f'avg({c}) as {n}' for n, c in sg.PROFILE_MEANS.items())},
    sum(Monetary) as TotalHistoricalRevenue, avg(AvgGapDaysMissing) * 100 as AvgGapDaysMissingRate_Pct,
    sum(FutureSpend90Days) as TotalFutureRevenue,
    avg(cast(FutureSpend90Days > 0 as int)) * 100 as RetentionRate_Pct,
    avg(cast(FutureSpend90Days = 0 as int)) * 100 as ZeroFutureSpendRate_Pct,
    count(*) / cast((select count(*) from ruled) as double) * 100 as CustomerShare_Pct,
    sum(FutureSpend90Days) / (select sum(FutureSpend90Days) from ruled) * 100 as FutureRevenueShare_Pct
  from ruled group by 1)
"""
NAMED = f"""
winners as (
  select (select Cluster from profile order by AvgFutureSpend90Days desc, RetentionRate_Pct desc, AvgFrequency desc, Cluster limit 1) as best,
    (select Cluster from profile order by IsNewCustomer_mean desc, AvgFrequency, Cluster limit 1) as newest,
    (select Cluster from profile order by AvgRecency desc, ZeroFutureSpendRate_Pct desc, Cluster limit 1) as inactive),
named as (
  select *, case when Cluster = best then '{sg.BEST}' when Cluster = newest then '{sg.NEW}'
    when Cluster = inactive then '{sg.INACTIVE}' else '{sg.REGULAR}' end as SegmentName
  from profile, winners)
"""
_PROFILE_DOUBLES = [
    *sg.PROFILE_MEANS, "TotalHistoricalRevenue", "AvgGapDaysMissingRate_Pct", "TotalFutureRevenue",
    "RetentionRate_Pct", "ZeroFutureSpendRate_Pct", "CustomerShare_Pct", "FutureRevenueShare_Pct",
]


def _rank(name, order):
    return f"rank() over (order by {name} {order}) + (count(*) over (partition by {name}) - 1) / 2.0::double"


def _texts(texts, other):
    whens = " ".join(f"when SegmentName = '{n}' then '{t}'" for n, t in texts.items())
    return f"case {whens} else '{other}' end"


def ruled_sql(body, *extra):
    return with_tables("features", body, MARKED, RULED, *extra)


REACH, LEAST = 2.0, 20
DENSE = f"""
points as (select Customer_ID, [{_COLUMNS}] as v from matrix),
near as (
  select * from (select a.Customer_ID as a, b.Customer_ID as b, floor(list_distance(a.v, b.v) * 1e9 + 0.5) / 1e9 as d
                 from points a, points b) where d <= {REACH}),
core as (select a as id from near group by 1 having count(*) >= {LEAST}),
links as (select a, b from near where a in (select id from core) and b in (select id from core)),
reach as (select id, id as seen from core union select l.b, r.seen from reach r join links l on l.a = r.id),
grouped as (select id, min(seen) as Cluster from reach group by 1),
edge as (
  select a as id, min_by(b, (d, b)) as nearest from near
  where a not in (select id from core) and b in (select id from core) group by 1),
clusters as (
  select Customer_ID, coalesce(g.Cluster, h.Cluster) as Cluster from points p left join grouped g on g.id = p.Customer_ID
  left join edge e on e.id = p.Customer_ID left join grouped h on h.id = e.nearest)
"""

ORACLES = {
    "seg07_density_clusters": with_tables(
        "features", "select Customer_ID, Cluster from clusters", MARKED, MATRIX, DENSE
    ).replace("with ", "with recursive ", 1),
    "seg01_scaled_matrix": with_tables(
        "features",
        "select Customer_ID, " + ", ".join(ra(c, 5) for c in sg.CLUSTER_FEATURES) + " from matrix",
        MARKED,
        MATRIX,
    ),
    "seg04_silhouette": ruled_sql(
        f"select 'Cluster' as Label, {r('s', 5)} as Silhouette from result", RULED_MATRIX, PAIRS, _silhouette("total")
    ),
    "seg04_silhouette_squared": ruled_sql(
        f"select rows_seen as Rows, {r('s', 5)} as Silhouette from result", RULED_MATRIX, PAIRS, _silhouette("squares")
    ),
    "seg05_davies_bouldin": ruled_sql(
        f"""select {r('avg(worst)', 5)} as DaviesBouldin from (
              select a.Cluster, max((a.s + b.s) / list_distance(a.c, b.c)) as worst
              from spreads a join spreads b on a.Cluster <> b.Cluster group by 1)""",
        RULED_MATRIX,
        f"""points as (select Customer_ID, Cluster, [{_COLUMNS}] as v from matrix),
            centres as (select Cluster, [{', '.join(f'avg({c})' for c in sg.CLUSTER_FEATURES)}] as c from matrix group by 1),
            spreads as (select Cluster, any_value(c) as c, avg(list_distance(v, c)) as s
                        from points join centres using (Cluster) group by 1)""",
    ),
    "seg06_calinski_harabasz": ruled_sql(
        f"""select {r('(t - w) * (n - k) / (w * (k - 1))', 5)} as CalinskiHarabasz from (
              select sum(w) as w, sum(n) as n, count(*) as k from (
                select Cluster, count(*) as n, {' + '.join(f'count(*) * var_pop({c})' for c in sg.CLUSTER_FEATURES)} as w
                from matrix group by 1)),
              (select {' + '.join(f'count(*) * var_pop({c})' for c in sg.CLUSTER_FEATURES)} as t from matrix)""",
        RULED_MATRIX,
    ),
    "seg12_cluster_counts": ruled_sql("select Cluster, count(*) as Customers from ruled group by 1"),
    "seg13_profile": ruled_sql(
        f"select Cluster, ClusterSize, {rounded(' '.join(_PROFILE_DOUBLES), 4)} from profile", PROFILE
    ),
    "seg14_profile_ranks": ruled_sql(
        f"""select Cluster, {_rank('AvgFutureSpend90Days', 'desc')} as RevenueRank,
            {_rank('RetentionRate_Pct', 'desc')} as RetentionRank, {_rank('AvgRecency', 'asc')} as RecencyRank,
            {_rank('AvgFrequency', 'desc')} as FrequencyRank from profile""",
        PROFILE,
    ),
    "seg15_segment_names": ruled_sql("select Cluster, SegmentName from named", PROFILE, NAMED),
    "seg16_feature_means": ruled_sql(
        "select Cluster, " + ", ".join(f"{r(f'avg({c})', 3)} as {c}" for c in sg.CLUSTER_FEATURES) + " from ruled group by 1"
    ),
    "seg17_segment_cards": ruled_sql(
        f"""select Cluster, SegmentName, ClusterSize, {rounded('CustomerShare_Pct AvgRecency AvgFrequency AvgMonetary '
            'AvgFutureSpend90Days TotalFutureRevenue FutureRevenueShare_Pct RetentionRate_Pct ZeroFutureSpendRate_Pct', 4)},
            {_texts(sg.INSIGHTS, sg.OTHER_INSIGHT)} as Insight,
            {_texts(sg.RECOMMENDATIONS, sg.OTHER_RECOMMENDATION)} as Recommendation from named""",
        PROFILE,
        NAMED,
    ),
    "seg18_profile_heatmap": ruled_sql(
        "select Cluster, "
        + ", ".join(
            f"{r(f'({c} - avg({c}) over ()) / nullif(stddev_pop({c}) over (), 0)')} as {c}" for c in sg.HEATMAP
        )
        + " from profile",
        PROFILE,
    ),
}
