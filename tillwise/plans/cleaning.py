"""Registered queries: sources and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillwise.functions.columns import settled
from tillwise.functions.lineage import cut_lineage, ensure_checkpoint_dir
from tillwise.operators import cleaning as cl
from tillwise.plans.inputs import lines, purchases, raw, tidied
from tillwise.plans.oracle import r, with_tables
from tillwise.sources import readers, sinks

TIDY_COLUMNS = "Invoice, StockCode, Description, Quantity, InvoiceDate, Price, Customer_ID, Country"


def result_folder(spark, name: str) -> str:
    """Where the sink queries write: beside the checkpoints, in a folder of their own."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/sinks/{name}-{spark.sparkContext.applicationId}"


def union_parts(spark, folder):
    sheets = [
        readers.invoice_lines(spark, folder, end="1998-01-01"),
        readers.invoice_lines(spark, folder, start="1998-01-01"),
    ]
    whole = cl.trim_headers(readers.read_parts(sheets))
    return whole.groupBy(F.year("InvoiceDate").alias("Year")).agg(
        F.count(F.lit(1)).alias("Lines"), F.sum("Quantity").alias("Quantity")
    )


def csv_round_trip(spark, folder):
    lines_of_customers = readers.read_table(spark, folder, "customer")
    path = result_folder(spark, "customer_csv")
    sinks.write_csv(lines_of_customers, path)
    return readers.read_csv(spark, path, lines_of_customers.schema)


def weekly_csv(spark, folder):
    from tillwise.operators.series import weekly_series

    path = result_folder(spark, "weekly_csv")
    frame = weekly_series(cl.strict_purchases(lines(spark, folder)))
    sinks.write_csv(frame, path)
    return readers.read_csv(spark, path, frame.schema)


def weekly_json(spark, folder):
    from tillwise.operators.series import weekly_series

    path = result_folder(spark, "weekly_json")
    frame = weekly_series(cl.strict_purchases(lines(spark, folder)))
    sinks.write_json_records(frame, path)
    return spark.read.schema(frame.schema).json(path)


def column_subset(spark, folder):
    return readers.read_columns(
        spark, f"{folder}/lineitem.parquet", ["l_orderkey", "l_partkey", "l_quantity"]
    )


def preview(spark, folder):
    from tillwise.operators.viewer import head_preview

    shown = ["Customer_ID", "InvoiceDate", "Invoice", "StockCode", "Quantity", "Price"]
    return head_preview(purchases(spark, folder).select(*shown), shown, 20)


def profile(spark, folder):
    from tillwise.operators.viewer import table_profile

    return table_profile(lines(spark, folder), ["Customer_ID", "InvoiceDate", "Invoice", "StockCode", "Quantity"])


RAW_ALIASED = (
    'Invoice, StockCode, Description, Quantity, InvoiceDate, Price, "Customer ID" as Customer_ID, Country'
)


def _flag(name, derive):
    def query(spark, folder):
        return derive(tidied(spark, folder)).groupBy("Invoice", name).agg(
            F.count(F.lit(1)).alias("Lines")
        )

    return query


def resolved(spark, folder):
    frame = cl.trim_headers(raw(spark, folder))
    customer = cl.resolve_column(frame, ["CustomerID", "Customer ID", "Customer_ID"])
    invoice = cl.resolve_column(frame, ["Invoice", "InvoiceNo"])
    return frame.groupBy(F.col(customer).alias("Customer")).agg(
        F.count(F.col(invoice)).alias("Lines")
    )


def text_timestamps(spark, folder):
    text = cl.trim_headers(raw(spark, folder)).withColumn(
        "InvoiceDate", F.date_format("InvoiceDate", "yyyy-MM-dd HH:mm:ss")
    )
    return cl.parse_timestamps(text).groupBy("InvoiceDate").agg(F.count(F.lit(1)).alias("Lines"))


def derived_when_absent(spark, folder):
    return cl.ensure_flags(tidied(spark, folder)).select(
        *TIDY_COLUMNS.split(", "), "IsCancelled", "IsReturn", "IsNonProduct", "TransactionValue"
    )


MEASURES = ("Quantity", "Price", "TransactionValue")

QUERIES = {
    "src01_union_parts": union_parts,
    "src02_csv_read": csv_round_trip,
    "src03_column_subset": column_subset,
    "src04_csv_sink": lambda s, d: settled(weekly_csv(s, d), 4),
    "src05_json_sink": lambda s, d: settled(weekly_json(s, d), 4),
    "src06_head_preview": preview,
    "src07_table_profile": profile,
    "cln01_trim_headers": lambda s, d: cl.trim_headers(raw(s, d)),
    "cln02_resolve_column": resolved,
    "cln03_drop_missing_customer": lambda s, d: cl.drop_missing_customer(
        cl.trim_headers(raw(s, d))
    ),
    "cln04_parse_timestamps": text_timestamps,
    "cln05_customer_id_text": lambda s, d: cl.customer_id_text(cl.trim_headers(raw(s, d)))
    .groupBy("Customer_ID")
    .agg(F.count(F.lit(1)).alias("Lines")),
    "cln06_normalise_codes": lambda s, d: cl.normalise_codes(cl.trim_headers(raw(s, d)))
    .groupBy("StockCode")
    .agg(F.count(F.lit(1)).alias("Lines")),
    "cln07_title_countries": lambda s, d: cl.title_countries(cl.trim_headers(raw(s, d)))
    .groupBy("Country")
    .agg(F.count(F.lit(1)).alias("Lines")),
    "cln08_drop_exact_copies": lambda s, d: cl.drop_exact_copies(tidied(s, d)),
    "cln09_positive_price": lambda s, d: cl.positive_price(tidied(s, d)),
    "cln10_flag_non_product": lambda s, d: cl.flag_non_product(tidied(s, d))
    .groupBy("StockCode", "IsNonProduct")
    .agg(F.count(F.lit(1)).alias("Lines")),
    "cln11_flag_cancelled": _flag("IsCancelled", cl.flag_cancelled),
    "cln12_flag_return": _flag("IsReturn", cl.flag_return),
    "cln13_transaction_value": lambda s, d: settled(
        cl.transaction_value(tidied(s, d)).select("Invoice", "StockCode", "TransactionValue"), 4
    ),
    "cln14_chronological": lambda s, d: cl.chronological(lines(s, d)),
    "cln15_cleaning_funnel": lambda s, d: cl.cleaning_funnel(raw(s, d)),
    "cln16_cleaning_summary": lambda s, d: cl.cleaning_summary(lines(s, d)),
    "cln17_genuine_purchases": purchases,
    "cln18_strict_purchases": lambda s, d: cl.strict_purchases(lines(s, d)),
    "cln19_flags_when_absent": derived_when_absent,
    "cln20_null_counts": lambda s, d: cl.null_counts(cl.trim_headers(raw(s, d))),
    "cln21_describe": lambda s, d: settled(cl.describe(cut_lineage(lines(s, d).select(*MEASURES)), MEASURES), 4),
    "cln22_distinct_counts": lambda s, d: cl.distinct_counts(lines(s, d)),
}

CLEAN_COLUMNS = f"{TIDY_COLUMNS}, IsCancelled, IsReturn, IsNonProduct, TransactionValue"

_DESCRIBE = " union all ".join(
    f"""select '{c}' as Measure, count({c}) as Count, {r(f'avg({c})', 4)} as Mean,
    {r(f'stddev_samp({c})', 4)} as Std, {r(f'min({c})', 4)} as Min, {r(f'quantile_cont({c}, 0.25)', 4)} as P25,
    {r(f'quantile_cont({c}, 0.5)', 4)} as P50, {r(f'quantile_cont({c}, 0.75)', 4)} as P75,
    {r(f'max({c})', 4)} as Max from clean"""
    for c in MEASURES
)
_NULLS = " union all ".join(
    f"select '{c.strip()}' as \"Column\", count(*) filter ({src} is null) as Nulls from raw"
    for c, src in [
        (c, '"Customer ID"' if c.strip() == "Customer_ID" else c) for c in TIDY_COLUMNS.split(",")
    ]
)
_DISTINCT = " union all ".join(
    f"select '{c.strip()}' as \"Column\", count(distinct {c}) as DistinctValues from clean"
    for c in CLEAN_COLUMNS.split(",")
)

ORACLES = {
    "src01_union_parts": with_tables(
        "raw",
        """select cast(year(InvoiceDate) as int) as Year, count(*) as Lines, cast(sum(Quantity) as bigint) as Quantity
           from raw group by 1""",
    ),
    "src02_csv_read": "select * from customer",
    "src03_column_subset": "select l_orderkey, l_partkey, l_quantity from lineitem",
    "src06_head_preview": with_tables(
        "clean",
        """select Customer_ID, InvoiceDate, Invoice, StockCode, Quantity, Price,
             least(20, (select count(*) from purchases)) as RowsShown,
             (select count(*) from purchases) as TotalRows
           from purchases order by Customer_ID, InvoiceDate, Invoice, StockCode, Quantity, Price limit 20""",
    ),
    "cln01_trim_headers": with_tables("raw", f"select {RAW_ALIASED} from raw"),
    "cln02_resolve_column": with_tables(
        "raw", 'select "Customer ID" as Customer, count(Invoice) as Lines from raw group by 1'
    ),
    "cln03_drop_missing_customer": with_tables(
        "raw", f'select {RAW_ALIASED} from raw where "Customer ID" is not null'
    ),
    "cln04_parse_timestamps": with_tables(
        "raw", "select InvoiceDate, count(*) as Lines from raw group by 1"
    ),
    "cln05_customer_id_text": with_tables(
        "tidy", "select Customer_ID, count(*) as Lines from tidy group by 1"
    ),
    "cln06_normalise_codes": with_tables(
        "tidy", "select StockCode, count(*) as Lines from tidy group by 1"
    ),
    "cln07_title_countries": with_tables(
        "tidy", "select Country, count(*) as Lines from tidy group by 1"
    ),
    "cln08_drop_exact_copies": with_tables("tidy", f"select distinct {TIDY_COLUMNS} from tidy"),
    "cln09_positive_price": with_tables(
        "tidy", f"select {TIDY_COLUMNS} from tidy where Price > 0"
    ),
    "cln10_flag_non_product": with_tables(
        "tidy",
        """select StockCode, coalesce(StockCode in ('POST', 'DOT', 'BANK CHARGES', 'AMAZONFEE', 'MANUAL', 'CRUK'), false) as IsNonProduct,
           count(*) as Lines from tidy group by 1, 2""",
    ),
    "cln11_flag_cancelled": with_tables(
        "tidy",
        "select Invoice, starts_with(Invoice, 'C') as IsCancelled, count(*) as Lines from tidy group by 1, 2",
    ),
    "cln12_flag_return": with_tables(
        "tidy", "select Invoice, coalesce(Quantity <= 0, false) as IsReturn, count(*) as Lines from tidy group by 1, 2"
    ),
    "cln13_transaction_value": with_tables(
        "tidy", f"select Invoice, StockCode, {r('Quantity * Price', 4)} as TransactionValue from tidy"
    ),
    "cln14_chronological": with_tables("clean", f"select {CLEAN_COLUMNS} from clean"),
    "cln15_cleaning_funnel": with_tables(
        "clean",
        """select (select count(*) from raw) as RawRows,
             (select count(*) from tidy where Customer_ID is not null) as RowsWithCustomer,
             (select count(*) from (select distinct * from tidy where Customer_ID is not null)) as DistinctRows,
             (select count(*) from clean) as PricedRows,
             (select count(*) from tidy where Customer_ID is null) as MissingCustomerRows,
             (select count(*) from tidy where Customer_ID is not null)
               - (select count(*) from (select distinct * from tidy where Customer_ID is not null)) as DuplicateRows,
             (select count(*) from (select distinct * from tidy where Customer_ID is not null) where not Price > 0) as BadPriceRows,
             (select count(*) from clean where IsNonProduct) as NonProductRows""",
    ),
    "cln16_cleaning_summary": with_tables(
        "clean",
        """select count(*) as Rows, count(distinct Customer_ID) as Customers, count(distinct Invoice) as Invoices,
             min(InvoiceDate) as FirstDate, max(InvoiceDate) as LastDate,
             count(*) filter (IsCancelled) as CancelledRows, count(*) filter (IsReturn) as ReturnRows,
             count(*) filter (IsNonProduct) as NonProductRows from clean""",
    ),
    "cln17_genuine_purchases": with_tables("clean", f"select {CLEAN_COLUMNS} from purchases"),
    "cln18_strict_purchases": with_tables(
        "clean",
        f"""select {CLEAN_COLUMNS} from purchases where Quantity > 0 and Price > 0 and TransactionValue > 0
            and Customer_ID is not null""",
    ),
    "cln19_flags_when_absent": with_tables(
        "tidy",
        f"""select {TIDY_COLUMNS}, starts_with(Invoice, 'C') as IsCancelled, coalesce(Quantity <= 0, false) as IsReturn,
            coalesce(StockCode in ('POST', 'DOT', 'BANK CHARGES', 'AMAZONFEE', 'MANUAL', 'CRUK'), false) as IsNonProduct,
            Quantity * Price as TransactionValue from tidy""",
    ),
    "cln20_null_counts": with_tables("raw", _NULLS),
    "cln21_describe": with_tables("clean", _DESCRIBE),
    "cln22_distinct_counts": with_tables("clean", _DISTINCT),
}
