"""Hand-made customers around the period limits."""

from __future__ import annotations

import datetime as dt

import pytest

from tillwise.functions.columns import title_case
from tillwise.operators import cleaning as cl
from tillwise.operators import features as fe
from tillwise.operators import series as se
from tillwise.sources.readers import RAW_LINE

CUT = dt.datetime(2011, 9, 9)
PERIODS = fe.Periods("2011-09-09")


def line(customer, invoice, when, code="a1", quantity=1, price=10.0):
    return (invoice, code, "thing", quantity, when, price, float(customer) if customer else None, " united kingdom ")


def days(n, **more):
    return CUT + dt.timedelta(days=n, **more)


@pytest.fixture(scope="module")
def rows(spark):
    lines = [
        line(1, "10", days(-5)),
        line(2, "20", days(0, minutes=-1)),
        line(2, "21", days(0), price=3.0),
        line(3, "30", days(-30)),
        line(3, "31", days(-90)),
        line(3, "32", days(-180)),
        line(3, "33", days(90)),
        line(4, "40", days(-3)),
        line(4, "41", days(-3)),
        line(4, "42", days(-1), code="b"),
        line(5, "C50", days(-3), quantity=-1),
        line(6, "60", days(-9)),
        line(6, "C61", days(-8), quantity=-2),
        line(7, "70", days(-181)),
        line(8, "80", days(-2), code=" post "),
        line(None, "90", days(-2)),
        line(9, "91", days(-2)),
        line(9, "91", days(-2)),
        line(9, "92", days(-2, hours=-30), price=0.0),
    ]
    raw = spark.createDataFrame(lines, RAW_LINE)
    clean = cl.clean_lines(raw)
    return {r["Customer_ID"]: r for r in fe.customer_features(clean, PERIODS).collect()}


def test_who_is_active(rows):
    assert sorted(rows) == ["1", "2", "3", "4", "6", "9"]


def test_single_purchase(rows):
    one = rows["1"]
    assert (one["AvgGapDays"], one["StdGapDays"], one["LifetimeDays"], one["IsNewCustomer"]) == (None, 0.0, 1, 1)


def test_cutoff_is_future(rows):
    two = rows["2"]
    assert two["Recency"] == 0 and two["Frequency"] == 1
    assert two["FutureSpend90Days"] == 3.0 and two["RetentionLabel"] == 1


def test_window_starts_are_inside_and_ends_outside(rows):
    three = rows["3"]
    assert three["PurchasesLast30Days"] == 1 and three["PurchasesLast90Days"] == 2
    assert three["PurchasesPrior90Days"] == 1 and three["SpendPrior90Days"] == 10.0
    assert three["RetentionLabel"] == 0 and three["FutureSpend90Days"] == 0.0


def test_same_time_invoices(rows):
    four = rows["4"]
    assert four["Frequency"] == 3 and four["AvgGapDays"] == 1.0
    assert four["StdGapDays"] == pytest.approx(2**0.5)
    assert four["UniqueProducts"] == 3


def test_returns_count_in_the_rate_only(rows):
    six = rows["6"]
    assert six["Frequency"] == 1 and six["ReturnRate"] == 0.5 and six["CancellationRate"] == 0.5


def test_copies_and_bad_prices(rows):
    assert rows["9"]["Frequency"] == 1 and rows["9"]["Monetary"] == 10.0


def test_non_product_codes(spark):
    codes = ["POST", " dot", "Bank charges", "amazonfee ", "Manual", "cruk", "x1"]
    frame = spark.createDataFrame([(c,) for c in codes], "StockCode string")
    flagged = cl.flag_non_product(cl.normalise_codes(frame))
    assert [r["IsNonProduct"] for r in flagged.collect()] == [True] * 6 + [False]


def test_title_case(spark):
    frame = spark.createDataFrame([(" channel islands",), ("guinea-bissau",), ("EIRE",), ("o'brien x_y",)], "c string")
    shown = [r[0] for r in frame.select(title_case(frame["c"])).collect()]
    assert shown == ["Channel Islands", "Guinea-Bissau", "Eire", "O'Brien X_Y"]


def test_week_labels_and_empty_weeks(spark):
    sales = [
        ("1", "a", dt.datetime(2011, 1, 2, 23, 59), 5.0),
        ("1", "b", dt.datetime(2011, 1, 3), 7.0),
        ("2", "c", dt.datetime(2011, 1, 17), 1.0),
    ]
    frame = spark.createDataFrame(
        sales, "Customer_ID string, Invoice string, InvoiceDate timestamp_ntz, TransactionValue double"
    )
    found = [(str(r["Date"]), r["Revenue"], r["AvgOrderValue"]) for r in se.weekly_series(frame).orderBy("Date").collect()]
    assert found == [
        ("2011-01-02", 5.0, 5.0),
        ("2011-01-09", 7.0, 7.0),
        ("2011-01-16", 0.0, 0.0),
        ("2011-01-23", 1.0, 1.0),
    ]


def test_required_columns(spark):
    with pytest.raises(ValueError):
        cl.resolve_column(spark.range(1), ["Customer ID"])
    with pytest.raises(ValueError):
        cl.require_columns(spark.range(1), ["id", "Recency"])


def test_a_product_counts_once_per_invoice_and_only_if_bought(spark):
    lines = [
        line(1, "10", days(-5), code="a"),
        line(1, "10", days(-5), code="a", quantity=2),
        line(1, "10", days(-5), code="A "),
        line(1, "10", days(-5), code="b", quantity=-1),
        line(1, "10", days(-5), code="b", quantity=3),
        line(1, "10", days(-5), code="c", quantity=-1),
        line(1, "10", days(-5), code=None),
        line(1, "10", days(-5), code=" post "),
        line(1, "11", days(-4), code="a"),
        line(1, "12", days(1), code="d"),
    ]
    clean = cl.clean_lines(spark.createDataFrame(lines, RAW_LINE))
    assert clean.count() == 9
    found = {r["Invoice"]: r["InvoiceProducts"] for r in fe.invoice_rollup(clean, PERIODS).collect()}
    assert found == {"10": 2, "11": 1, "12": 0}


def test_copies_in_dealt_rows_are_the_copies_of_any_rows(spark):
    rows = [("k", None, float("nan")), ("k", None, float("nan")), ("k", "", 1.0), (None, "", 1.0), (None, "", 1.0), ("k", None, None)]
    frame = spark.createDataFrame(rows, "k string, s string, v double")
    dealt = cl.drop_exact_copies(frame.repartition("k"), ["k"])
    assert dealt.columns == frame.columns
    assert sorted(map(str, dealt.collect())) == sorted(map(str, cl.drop_exact_copies(frame).collect()))
    assert dealt.count() == 4
