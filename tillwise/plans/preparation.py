"""Registered queries: preparation for models."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillwise.functions.columns import safe_log1p, settled
from tillwise.operators import preparation as pr
from tillwise.functions.lineage import cut_lineage
from tillwise.plans.inputs import features, kept_features, purchases
from tillwise.plans.oracle import r, ra, with_tables

MATRIX = (*pr.LOG_FEATURES, *pr.SCALE_FEATURES)
FEW = ("AvgGapDays", "Monetary", "Recency")


def split_sql(strata="", share=0.2, table="features"):
    over = f"partition by {strata}" if strata else ""
    return f"""select *, case when row_number() over ({over} order by md5(Customer_ID), Customer_ID)
        <= ceil(count(*) over ({over}) * cast({share} as double)) then 'test' else 'train' end as Split from {table}"""


def matrix_sql(log=pr.LOG_FEATURES, plain=pr.SCALE_FEATURES, fit="features", source="features", name="matrix"):
    """Expressions med, prepared and the scaled matrix; statistics come from ``fit``."""
    names = [*log, *plain]
    med = ", ".join(f"median({c}) as med_{c}" for c in names)

    def value(c):
        filled = f"coalesce(cast({c} as double), med_{c})"
        return f"ln(1 + greatest({filled}, 0))" if c in log else filled

    prepared = ", ".join(f"{value(c)} as {c}" for c in names)
    stats = ", ".join(f"avg({c}) as mean_{c}, stddev_pop({c}) as std_{c}" for c in names)
    scaled = ", ".join(
        f"({c} - mean_{c}) / case when std_{c} = 0 then 1 else std_{c} end as {c}" for c in names
    )
    keep = "* exclude (" + ", ".join(names) + ")"
    return f"""{name}_med as (select {med} from {fit}),
      {name}_fit as (select {prepared} from {fit}, {name}_med),
      {name}_stats as (select {stats} from {name}_fit),
      {name}_ready as (select {keep}, {prepared} from {source}, {name}_med),
      {name} as (select {keep.replace(')', ', ' + ', '.join(f'mean_{c}, std_{c}' for c in names) + ')')}, {scaled}
        from {name}_ready, {name}_stats)"""


def trained_matrix(spark, folder):
    parts = cut_lineage(pr.split_rows(kept_features(spark, folder), 0.2, ["RetentionLabel"]))
    train = parts.where(F.col("Split") == "train")
    return settled(
        pr.scaled_matrix(parts, fitted_on=train, keep=["Customer_ID", "Split"]), 5
    )


def infinite_ratio(spark, folder):
    """Spend per prior spend: infinite or undefined for customers without prior spend."""
    top, bottom = F.col("SpendLast90Days"), F.col("SpendPrior90Days")
    grown = F.when(bottom != 0, top / F.nullif(bottom, F.lit(0.0))).otherwise(
        F.when(top > 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    )
    frame = kept_features(spark, folder, "SpendLast90Days", "SpendPrior90Days").select("Customer_ID", grown.alias("Growth"))
    return settled(pr.finite_or_median(frame, ["Growth"]))


def pca(spark, folder):
    from tillwise.operators.segments import principal_components

    matrix = cut_lineage(pr.scaled_matrix(kept_features(spark, folder)))
    return principal_components(matrix, MATRIX, 3)


QUERIES = {
    "pre01_median_imputation": lambda s, d: settled(
        pr.impute_median(kept_features(s, d, *FEW), FEW).select("Customer_ID", *FEW)
    ),
    "pre02_log1p": lambda s, d: settled(
        pr.log_columns(features(s, d), ["Monetary"]).select("Customer_ID", "Monetary")
    ),
    "pre03_clipped_log1p": lambda s, d: settled(
        purchases(s, d).select(
            "Invoice", "StockCode", safe_log1p(F.col("TransactionValue") - 100).alias("LogValue")
        )
    ),
    "pre04_standardise": lambda s, d: settled(
        pr.standardise(kept_features(s, d, "Recency", "Monetary"), ["Recency", "Monetary"]).select(
            "Customer_ID", "Recency", "Monetary"
        )
    ),
    "pre05_scaled_groups": trained_matrix,
    "pre06_stratified_split": lambda s, d: pr.split_rows(
        kept_features(s, d, "RetentionLabel"), 0.2, ["RetentionLabel"]
    ),
    "pre07_plain_split": lambda s, d: pr.split_rows(
        cut_lineage(features(s, d).select("Customer_ID")), 0.25
    ),
    "pre09_finite_or_median": infinite_ratio,
    "pre10_class_weights": lambda s, d: settled(pr.class_weights(features(s, d))),
    "pre11_principal_components": pca,
    "pre12_plot_sample": lambda s, d: settled(
        pr.hash_sample(features(s, d), 1500).select("Customer_ID", "Monetary", "Recency")
    ),
}

ORACLES = {
    "pre01_median_imputation": with_tables(
        "features",
        "select Customer_ID, "
        + ", ".join(f"{r(f'coalesce({c}, (select median({c}) from features))')} as {c}" for c in FEW)
        + " from features",
    ),
    "pre02_log1p": with_tables(
        "features", f"select Customer_ID, {r('ln(1 + Monetary)')} as Monetary from features"
    ),
    "pre03_clipped_log1p": with_tables(
        "clean",
        f"select Invoice, StockCode, {r('ln(1 + greatest(TransactionValue - 100, 0))')} as LogValue from purchases",
    ),
    "pre04_standardise": with_tables(
        "features",
        f"""select Customer_ID, {r('(Recency - m1) / s1')} as Recency, {r('(Monetary - m2) / s2')} as Monetary
            from features, (select avg(Recency) as m1, stddev_pop(Recency) as s1, avg(Monetary) as m2,
                                   stddev_pop(Monetary) as s2 from features)""",
    ),
    "pre05_scaled_groups": with_tables(
        "features",
        "select Customer_ID, Split, " + ", ".join(ra(c, 5) for c in MATRIX) + " from matrix",
        f"parts as ({split_sql('RetentionLabel')}), train as (select * from parts where Split = 'train')",
        matrix_sql(fit="train", source="parts"),
    ),
    "pre06_stratified_split": with_tables(
        "features", f"select Customer_ID, RetentionLabel, Split from ({split_sql('RetentionLabel')})"
    ),
    "pre07_plain_split": with_tables(
        "features", f"select Customer_ID, Split from ({split_sql('', 0.25)})"
    ),
    "pre09_finite_or_median": with_tables(
        "features",
        f"""select Customer_ID, {r('coalesce(g, (select median(g) from grown), 0)')} as Growth from grown""",
        """grown as (select Customer_ID,
             case when SpendPrior90Days <> 0 then SpendLast90Days / SpendPrior90Days end as g from features)""",
    ),
    "pre10_class_weights": with_tables(
        "features",
        f"""select cast(RetentionLabel as int) as Label, count(*) as Rows,
              {r('(select count(*) from features) / (2.0 * count(*))')} as Weight,
              {r('''(select count(*) filter (RetentionLabel = 0) / cast(count(*) filter (RetentionLabel = 1) as double)
                   from features)''')} as NegativeToPositive
            from features group by RetentionLabel""",
    ),
    "pre12_plot_sample": with_tables(
        "features",
        f"""select Customer_ID, {ra('Monetary')}, Recency from (
              select * from features order by md5(Customer_ID), Customer_ID limit 1500)""",
    ),
}
