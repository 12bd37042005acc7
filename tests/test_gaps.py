"""Cost fallbacks, single discount with leftover penalty, nested record, re-joined folds, CSV quarantine, weather gaps."""

from math import exp, floor

import pytest
from pyspark.sql import functions as F

from tillsight.operators import features as FT
from tillsight.operators import ml as ML
from tillsight.operators import patterns as PT
from tillsight.operators import pricing as PR
from tillsight.sources import files as FS


def test_cost_falls_back_by_category(spark):
    rows = spark.createDataFrame(
        [("a", 10.0, 0.5, 1, "2001"), ("a", 10.0, 1.0, 0, "2001"), ("b", 10.0, 1.0, 0, "2001"), ("c", 10.0, 1.0, 0, "3001"),
         ("d", 10.0, 1.0, 0, "4001"), ("e", 10.0, 1.0, 0, "9901"), ("f", 10.0, 1.0, 0, None), ("g", None, 1.0, 0, "2001"),
         ("h", 10.0, None, 1, "2001")],
        "product_code string, list_price double, discount_rate double, is_promo int, category_code string")
    got = {r[0]: (r[1], r[2]) for r in PT.cost_estimate_any(rows).collect()}
    assert got["a"] == (pytest.approx(2.25), "discounted_price")
    assert [got[k] for k in "bcde"] == [(pytest.approx(x), "category_rate") for x in (4.0, 3.0, 2.0, 2.5)]
    assert got["f"] == (0.0, "none") and got["g"] == (0.0, "none")
    assert got["h"] == (pytest.approx(4.0), "category_rate")
    assert PT.cost_estimate_any(rows.limit(0)).count() == 0


def by_hand(stock, base, cost, least, hist, elasticity, ratio, trend):
    best = None
    for pct in range(round(least * 100), 101):
        d, left = pct / 100.0, stock
        for i in range(8):
            tau = 1.0 - i / 8
            dem = (hist * (1 / d) ** elasticity * exp(3 * (1 - tau)) * (1 + 2 / (1 + exp(-5 * (left / max(hist * 3, 10.0) - 0.5))))
                   * (1 + (ratio - 1) * (1 - tau)) * (1 + trend))
            left -= min(floor(max(0.1, min(dem, left * 0.8)) / 8), left)
        profit = (base * d - cost) * (stock - left) - left * cost * 0.3
        best = max(best or (profit, d, stock - left), (profit, d, stock - left))
    return best


def test_single_discount_counts_what_is_left(spark):
    cases = [(40, 10.0, 6.0, 0.4, 3.0, 1.2, 1.5, 0.1), (200, 8.0, 1.0, 0.4, 1.0, 2.0, 1.2, 0.0), (0, 5.0, 2.0, 0.5, 4.0, 1.2, 1.0, 0.0),
             (5, 5.0, 4.9, 0.4, 20.0, 1.0, 1.0, -0.2)]
    cols = ["plan_id", "initial_stock", "base_price", "cost_price", "min_discount", "hist_avg_sales", "price_elasticity",
            "hist_promo_sales_ratio", "sales_trend", "is_fresh", "shelf_life_hours"]
    plans = spark.createDataFrame([(str(i), *c, 0, 168) for i, c in enumerate(cases)], cols)
    got = {r["plan_id"]: r for r in PR.best_discount_with_leftover(plans).collect()}
    for i, c in enumerate(cases):
        profit, d, sold = by_hand(*c)
        r = got[str(i)]
        assert (r["profit"], r["discount"], r["sold"]) == (pytest.approx(profit), pytest.approx(d), sold)
        assert r["sold"] + r["leftover"] == c[0]


def test_nested_profile_keeps_each_hour(spark):
    rows = spark.createDataFrame([("s", "p", "2024-01-01 20:10:00", 2.0, 0.5), ("s", "p", "2024-01-01 20:40:00", 4.0, 1.0),
                                  ("s", "p", "2024-01-02 09:00:00", 1.0, None)],
                                 "store_code string, product_code string, t string, qty double, discount_rate double")
    hours = PT.hourly_profile(rows.withColumn("sale_ts", F.to_timestamp("t")))
    record = PT.nested_profile(hours, PT.KEYS, "hour", "hourly_pattern").first()["hourly_pattern"]
    assert set(record) == {9, 20}
    assert (record[20]["avg_sales"], record[20]["transactions"], record[20]["avg_discount"]) == (3.0, 2, 0.75)
    assert record[9]["avg_discount"] is None


def test_rejoined_rows_fall_into_the_same_folds(spark):
    rows = ML.time_split(spark.range(1, 24).select(F.col("id").alias("position"), F.lit(23).alias("n_rows"), F.col("id").cast("double").alias("qty"),
                                                   F.expr("date_add(date'2024-01-01', cast(id as int))").alias("sale_date")))
    both = ML.rejoin(rows.where("is_train = 1"), rows.where("is_train = 0"))
    assert both.count() == 23
    got = {r["fold"]: (r["train_rows"], r["valid_rows"], r["train_mean"], r["valid_mean"]) for r in ML.fold_sizes(both, "qty").collect()}
    assert got == {0: (4, 4, 2.5, 6.5), 1: (8, 4, 4.5, 10.5), 2: (12, 4, 6.5, 14.5), 3: (16, 4, 8.5, 18.5)}


def test_quarantine_names_the_field(spark, tmp_path):
    rows = spark.createDataFrame([("1", "2.0", "5.0"), ("2", "n/a", "5.0"), ("3", "1.0", "12,5"), ("4", None, "")], ["product_code", "qty", "list_price"])
    path = FS.write_tx_csv(rows, str(tmp_path / "t"))
    good, bad = FS.read_tx_csv(spark, path, rows.columns)
    assert {r["product_code"]: r["qty"] for r in good.collect()} == {"1": 2.0, "4": None}
    fields = {r["product_code"]: (r["qty"], r["list_price"]) for r in FS.quarantined_fields(bad, rows.columns).collect()}
    assert fields == {"2": ("n/a", "5.0"), "3": ("1.0", "12,5")}


def test_weather_gaps_take_the_day_before_then_the_next(spark):
    w = spark.createDataFrame([("2024-01-01", "--", "1"), ("2024-01-02", "9", None), ("2024-01-03", None, "3"), ("2024-01-04", "7", "x")],
                              "date string, high string, low string").withColumns({"code_day": F.lit("01"), "rainfall": F.lit(None).cast("string")})
    got = [(r["temp_high"], r["temp_low"], r["rainfall"]) for r in FT.clean_weather(w).orderBy("date").collect()]
    assert got == [(9.0, 1.0, 0.0), (9.0, 1.0, 0.0), (9.0, 3.0, 0.0), (7.0, 3.0, 0.0)]
