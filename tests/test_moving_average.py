"""Moving-average models: the recursion, the refinement and forecasts against plain loops."""

from __future__ import annotations

import datetime

import numpy as np
import pytest

from tillwise.operators import forecasting as fo
from tillwise.operators import moving_average as ma
from tillwise.operators import smoothing as sm


def errors_by_hand(w, point, order):
    """The defining equation with explicit products of both polynomials."""
    a = point[: order.lags]
    b = point[order.lags : order.lags + order.errors]
    sa = point[order.lags + order.errors :][: order.seasonal_lags]
    sb = point[order.lags + order.errors + order.seasonal_lags :]
    ar_poly, ma_poly = np.zeros(60), np.zeros(60)
    ar_poly[0] = ma_poly[0] = 1
    ar_poly[1 : 1 + len(a)] -= a
    ma_poly[1 : 1 + len(b)] += b
    for poly, seasonal, sign in ((ar_poly, sa, -1), (ma_poly, sb, 1)):
        plain = poly.copy()
        for j, c in enumerate(seasonal, 1):
            shift = j * order.season
            poly[shift:] += sign * c * plain[: len(plain) - shift]
    start = max([k for k in range(60) if ar_poly[k] != 0] or [0])
    e = np.zeros(len(w))
    for t in range(start, len(w)):
        e[t] = sum(ar_poly[k] * w[t - k] for k in range(min(t, 59) + 1)) - sum(ma_poly[k] * e[t - k] for k in range(1, min(t, 59) + 1))
    return e


@pytest.mark.parametrize("order", [*ma.ORDERS, ma.SEASONAL_ORDERS[2], ma.SEASONAL_ORDERS[-1]], ids=str)
def test_errors_follow_the_recursion(order):
    draw = np.random.default_rng(1)
    w, points = draw.normal(size=80), draw.uniform(-0.8, 0.8, (5, order.size))
    found = ma.residuals(w, points, order)
    for k, point in enumerate(points):
        assert found[k] == pytest.approx(errors_by_hand(w, point, order))


def test_all_orders_are_there():
    assert len(ma.ORDERS) == 8 and len(ma.SEASONAL_ORDERS) == 24 and len(set(map(str, ma.ORDERS + ma.SEASONAL_ORDERS))) == 32


@pytest.mark.parametrize("order", [ma.Order(1, 0, 1), ma.Order(2, 1, 1), ma.Order(0, 1, 1, 0, 1, 1, 4)], ids=str)
def test_refinement_never_rises_above_the_grid_and_ends_in_a_minimum(order):
    draw = np.random.default_rng(2)
    y = np.cumsum(draw.normal(size=90)) * 0.1 + 5
    w, _ = ma.differenced(y, order)
    coarse, fine = ma.fitted(w, order, refine=False), ma.fitted(w, order)
    assert fine[1] <= coarse[1]
    for k in range(order.size):
        for step in (-0.002, 0.002):
            near = fine[0].copy()
            near[k] = np.clip(near[k] + step, -ma.LIMIT, ma.LIMIT)
            assert ma.squares(w, near[None], order)[0] >= fine[1] - 1e-6


def test_forecasts_take_differences_back():
    y = np.array([float(3 * t + (10 if t % 4 == 0 else 0)) for t in range(40)])
    seasonal = ma.Order(0, 1, 1, 0, 1, 1, 4)
    expected = [float(3 * t + (10 if t % 4 == 0 else 0)) for t in range(40, 48)]
    assert ma.ahead(y, seasonal, np.array([0.3, -0.2]), 8) == pytest.approx(expected)
    walk = ma.ahead(np.array([1.0, 2.0, 4.0]), ma.Order(1, 1, 0), np.array([0.5]), 3)
    assert walk == pytest.approx([5.0, 5.5, 5.75])
    level = ma.ahead(np.full(10, 7.0), ma.Order(1, 0, 1), np.array([0.5, 0.1]), 2)
    assert level == pytest.approx([7.0, 7.0])


def series(spark, names=("A", "B")):
    draw = np.random.default_rng(5)
    rows = [
        (name, datetime.date(2000, 1, 2) + datetime.timedelta(weeks=t), float(np.exp(5 + 0.01 * t + draw.normal() * 0.2)))
        for name in names
        for t in range(70 if name != "short" else 12)
    ]
    return spark.createDataFrame(rows, "Country string, Date date, Revenue double")


def test_series_and_orders_are_fitted_apart(spark):
    frame = series(spark, ("A", "B", "short"))
    found = ma.fits(frame, 4, ma.ORDERS[:3], ["Country"]).collect()
    assert {(r["Country"], r["Order"]) for r in found if r["Country"] != "short"} == {(c, str(o)) for c in "AB" for o in ma.ORDERS[:3]}
    one = {r["Order"]: r["SSE"] for r in ma.fits(frame.where("Country = 'A'").drop("Country"), 4, ma.ORDERS[:3]).collect()}
    assert one == {r["Order"]: r["SSE"] for r in found if r["Country"] == "A"}
    ahead = ma.forecasts(frame.where("Country = 'B'"), 4, ma.ORDERS[:1], ["Country"]).collect()
    assert sorted(r["Step"] for r in ahead) == [1, 2, 3, 4] and all(r["Forecast"] > 0 for r in ahead)


def test_smoothing_weights_are_refined(spark):
    draw = np.random.default_rng(6)
    y = np.log1p(np.exp(5 + np.cumsum(draw.normal(size=60)) * 0.1))
    for kind, season in (("simple", 0), ("trend", 0), ("seasonal", 4)):
        grid = min(sm._fitted(y, kind, season, 2, sm._weights(kind)[part :: sm.SLICES])[0] for part in range(sm.SLICES))
        best = min((sm._search(y, kind, season, 2, part) for part in range(sm.SLICES)), key=lambda f: f[0])
        fine = sm._refined(y, kind, season, 2, best[1])
        assert fine[0] <= grid == best[0]
        assert len(sm._allowed(kind, np.array([fine[1]]))) == 1


def test_folds_are_series_of_their_own(spark):
    frame = series(spark)
    rows = fo.rolling_origin_rows(frame, 6, 2, ["Country"])
    sizes = {(r["Country"], r["Fold"]): r["count"] for r in rows.groupBy("Country", "Fold").count().collect()}
    assert sizes == {(c, f): 70 - 6 * f for c in "AB" for f in (1, 2)}


def test_a_single_short_series_is_an_error(spark):
    short = series(spark, ("short",)).drop("Country")
    with pytest.raises(ValueError, match="no more than"):
        fo.evaluate_models(short, 6)
