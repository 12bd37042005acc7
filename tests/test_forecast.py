"""Sums of products, linear fits from them, the seasonal forecast and the model search."""

import datetime as dt
import json
import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tillsight.operators import forecast as FC
from tillsight.operators import gram as GM
from tillsight.operators import ml as ML


def test_gram_adds_over_partitions_and_keys(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(k, float(a), float(b), float(y)) for k in ("a", "b", None) for a, b, y in rng.normal(size=(50, 3))]
    df = spark.createDataFrame(rows, "k string, a double, b double, label double").repartition(5)
    got = {r.k: GM.matrix(r.z, r.p) for r in GM.gram(df, ["k"], ["a", "b"], lambda c: np.column_stack([np.ones(len(c["a"])), c["a"], c["b"]])).collect()}
    for k in ("a", "b", None):
        x = np.array([[1, a, b] for n, a, b, _ in rows if n == k])
        y = np.array([v for n, _, _, v in rows if n == k])
        xtx, xty, yty, n = got[k]
        np.testing.assert_allclose(xtx, x.T @ x)
        np.testing.assert_allclose(xty, x.T @ y)
        assert n == 50 and math.isclose(yty, y @ y)
        b = GM.ridge(xtx.copy(), xty, np.zeros(3))
        np.testing.assert_allclose(b, np.linalg.lstsq(x, y, rcond=None)[0])
        assert math.isclose(GM.residual_std(xtx, xty, yty, n, b), np.std(y - x @ b, ddof=1))
    assert GM.gram(df.limit(0), ["k"], ["a"], lambda c: None).count() == 0


def test_lasso_and_ridge_from_sums_equal_mllib(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 4)) * [1, 5, 0.2, 1]
    y = 3 + x @ [2, 0.1, 0, -1] + rng.normal(size=300)
    df = spark.createDataFrame([(r.tolist(), float(v), 0) for r, v in zip(x, y)], "x array<double>, label double, block int") \
              .withColumn("features", array_to_vector("x"))
    z = np.column_stack([np.ones(300), x])
    fit = LinearRegression(regParam=0.3, elasticNetParam=1.0, tol=1e-12, maxIter=1000).fit(df)
    b = ML.fit_from_sums("lasso", {"regParam": 0.3}, z.T @ z, z.T @ y, 300.0)
    # the library standardises by the sample deviation, the sums by that of the population
    np.testing.assert_allclose(b, [fit.intercept, *fit.coefficients], atol=5e-3)
    assert b[3] == 0.0 and abs(b[2]) < 0.1
    b = ML.fit_from_sums("ridge", {"regParam": 0.5}, z.T @ z, z.T @ y, 300.0)
    s = x.std(axis=0)
    xs = np.column_stack([np.ones(300), x / s])
    want = np.linalg.solve(xs.T @ xs + 150 * np.diag([0, 1, 1, 1, 1]), xs.T @ y)
    np.testing.assert_allclose(b, np.r_[want[0], want[1:] / s])


def series(n, weekly=2.0, holiday=0.0, days=()):
    start = dt.date(2024, 1, 1)
    return [("p", start + dt.timedelta(days=i), 20 + 0.05 * i + weekly * ((i % 7) >= 5) + holiday * (start + dt.timedelta(days=i) in days),
             float(10 - i % 3), int(i % 4 == 0), i % 5) for i in range(n)]


DAILY = "product_code string, sale_date date, qty double, list_price double, is_promo int, promo_count int"


@pytest.fixture(scope="module")
def calendar(spark):
    off = [dt.date(2024, 2, 10), dt.date(2024, 4, 4), dt.date(2024, 5, 1)]
    rows = [(d, float(any(abs((d - h).days) <= 2 for h in off))) for d in (dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(140))]
    return spark.createDataFrame(rows, "date date, holiday_window double"), [d for d, w in rows if w]


def test_a_holiday_in_the_horizon_moves_the_forecast(spark, calendar):
    cal, days = calendar
    daily = spark.createDataFrame(series(118, holiday=30.0, days=days), DAILY)          # the horizon holds 29 April to 3 May
    with_ = {r.ds: r for r in FC.seasonal_forecast(daily, cal).collect()}
    without = {r.ds: r for r in FC.seasonal_forecast(daily, cal.where("date < '2024-04-25'")).collect()}
    assert sorted(with_) == [dt.date(2024, 4, 28) + dt.timedelta(days=i) for i in range(7)]
    for d, r in with_.items():
        moved = r.yhat - without[d].yhat
        assert moved > 20 if d in days else moved == 0
        assert r.yhat_lower < r.yhat < r.yhat_upper
    assert abs(with_[dt.date(2024, 4, 28)].yhat - (20 + 0.05 * 118 + 2)) < 2


def test_regressors_move_the_forecast(spark, calendar):
    rng = np.random.default_rng(3)
    rows = [(p, d, q + 4.0 * f - 1.5 * c + rng.normal() * 0.01, c, f, k) for p, d, q, c, f, k in series(120, weekly=0.0)]
    daily = spark.createDataFrame(rows, DAILY)
    future = [("p", dt.date(2024, 4, 30) + dt.timedelta(days=i), 8.0, float(i % 2)) for i in range(4)]
    got = FC.seasonal_forecast(daily, calendar[0], ["list_price"], ["is_promo"], future=spark.createDataFrame(
        future, "product_code string, ds date, list_price double, is_promo double")).collect()
    hat = [r.yhat for r in sorted(got, key=lambda r: r.ds)]
    assert abs((hat[1] - hat[0]) - 4.05) < 0.4 and abs((hat[2] - hat[1]) + 3.95) < 0.4


def test_future_values_by_kind(spark):
    rows = [("p", dt.date(2024, 1, 1) + dt.timedelta(days=i), float(i), 1 if i % 2 else 0, i) for i in range(12)]
    rows += [("q", dt.date(2024, 1, 1), 3.0, 1, None), ("r", dt.date(2024, 1, 1), 3.0, 0, 4)]
    df = spark.createDataFrame(rows, "product_code string, sale_date date, price double, flag int, code int")
    got = FC.future_values(df, ["price"], ["flag"], ["code"], horizon=400).collect()
    own = lambda k: [r for r in got if r.product_code == k]
    assert {r.price for r in own("p")} == {8.0} and {r.code for r in own("p")} == {11.0}
    assert 160 < sum(r.flag for r in own("p")) < 240                        # about its frequency
    assert {r.flag for r in own("q")} == {1.0} and {r.flag for r in own("r")} == {0.0} and {r.code for r in own("q")} == {0.0}
    again = FC.future_values(df.repartition(3), ["price"], ["flag"], ["code"], horizon=400).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_short_series_give_nothing(spark, calendar):
    assert FC.seasonal_forecast(spark.createDataFrame(series(13), DAILY), calendar[0], ["list_price"]).count() == 0


def test_search_over_all_kinds(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 3))
    y = x @ [2.0, -1.0, 0.0] + 5 + rng.normal(size=200) * 0.3
    df = spark.createDataFrame([(r.tolist(), float(v), i // 40) for i, (r, v) in enumerate(zip(x, y))], "x array<double>, label double, block int") \
              .select(array_to_vector("x").alias("features"), "label", "block")
    grids = {"ridge": [{"regParam": 0.01}, {"regParam": 10.0}], "lasso": [{"regParam": 0.01}, {"regParam": 1.0}],
             "random_forest": [{"numTrees": 3, "maxDepth": 2}], "gbt": [{"maxIter": 2, "maxDepth": 2}]}
    got = ML.search_models(df, grids).collect()
    assert {r.model for r in got} == set(grids) and len(got) == 6 and sum(r.is_best for r in got) == 1 and sum(r.best_of_kind for r in got) == 4
    assert got[0].is_best == 1 and got[0].model in ("ridge", "lasso") and [r.mean_rmse for r in got] == sorted(r.mean_rmse for r in got)
    # the errors from sums are those of the rows
    for r in got:
        if r.model != "ridge":
            continue
        alpha, rmses = json.loads(r.params)["regParam"], []
        for i in range(4):
            tr, va = slice(0, 40 * (i + 1)), slice(40 * (i + 1), 40 * (i + 2))
            m, s = x[tr].mean(axis=0), x[tr].std(axis=0)
            xs = (x[tr] - m) / s
            b = np.linalg.solve(xs.T @ xs + alpha * len(xs) * np.eye(3), xs.T @ (y[tr] - y[tr].mean()))
            rmses.append(np.sqrt(np.mean((y[va] - y[tr].mean() - ((x[va] - m) / s) @ b) ** 2)))
        assert math.isclose(r.mean_rmse, np.mean(rmses), rel_tol=1e-8)


def test_rounds_of_boosting_share_a_fit(spark, monkeypatch):
    from pyspark.ml.regression import GBTRegressor
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 3))
    y = x @ [2.0, -1.0, 0.0] + x[:, 0] * x[:, 1] + rng.normal(size=200) * 0.3
    df = spark.createDataFrame([(r.tolist(), float(v), i // 40) for i, (r, v) in enumerate(zip(x, y))], "x array<double>, label double, block int") \
              .select(array_to_vector("x").alias("features"), "label", "block").coalesce(1).cache()
    alone = [ML.tune_by_fits(df, {"gbt": [{"maxIter": k, "maxDepth": 2, "stepSize": 0.1}]})[0] for k in (2, 4)]
    fits, fit = [], GBTRegressor.fit
    monkeypatch.setattr(GBTRegressor, "fit", lambda self, d: fits.append(self.getMaxIter()) or fit(self, d))
    got = ML.tune_by_fits(df, {"gbt": [{"maxIter": k, "maxDepth": 2, "stepSize": 0.1} for k in (4, 2)]})
    assert fits == [4] * 4 and [p["maxIter"] for _, p, _, _ in got] == [4, 2]
    for (_, p, rmse, n), want in zip(got, alone[::-1]):
        assert p == want[1] and n == 4 and math.isclose(rmse, want[2], rel_tol=1e-9)
