"""Invariant and brute-force checks for pricing, monitoring and model-preparation rules."""

import math

import numpy as np
from pyspark.sql import functions as F

from tillsight.operators import features as FT
from tillsight.operators import ml as ML
from tillsight.operators import pricing as PR
from tillsight.streaming import monitor as MON


def _greedy_reference(stock, base, min_price, rates, hours, cands):
    """The clearing rule written out directly: highest price everywhere, then deepen
    stages from the last one until the expected units cover the stock."""
    exp = [[max(0.0, r * (base / max(base * (1 - c), min_price)) * hours) for c in cands] for r in rates]
    choice = [0] * len(rates)
    cum = sum(e[0] for e in exp)
    for k in reversed(range(len(rates))):
        if cum >= stock:
            break
        for j in range(1, len(cands)):
            new = cum - exp[k][choice[k]] + exp[k][j]
            if new >= stock or j == len(cands) - 1:
                cum, choice[k] = new, j
                break
    return [cands[j] for j in choice]


def test_greedy_clearing_matches_rule(spark):
    cands = (0.1, 0.2, 0.3, 0.4, 0.5)
    cases = [("a", 40, 10.0, 6.0, [2.0, 3.0, 4.0, 5.0]), ("b", 3, 10.0, 6.0, [2.0, 3.0, 4.0, 5.0]),
             ("c", 200, 8.0, 1.0, [1.0, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(p, s, b, m, r, 0.5) for p, s, b, m, r in cases],
                               "plan_id string, initial_stock long, base_price double, min_price double, "
                               "base_rates array<double>, stage_hours double")
    got = {}
    for r in PR.greedy_clearing(df, stages=4, candidates=cands).collect():
        got.setdefault(r.plan_id, {})[r.stage] = r.discount
    for p, s, b, m, r in cases:
        assert [got[p][k] for k in range(4)] == _greedy_reference(s, b, m, r, 0.5, cands)


def test_single_discount_is_best_on_ladder(spark):
    rows = [("a", 20, 10.0, 4.0, 8.0, 0.1), ("b", 50, 5.0, 4.6, 2.0, 0.05)]
    plans = spark.createDataFrame(rows, "plan_id string, initial_stock long, base_price double, cost_price double, "
                                        "sales_rate double, min_gross_margin double") \
                 .withColumn("promotion_start", F.lit("20:00")).withColumn("promotion_end", F.lit("22:00"))
    got = {r.plan_id: r.discount for r in PR.best_single_discount(plans).collect()}
    for pid, stock, base, cost, rate, margin in rows:
        best, best_p = 1.0, 0.0
        for d in PR.STAGGER_LADDER:
            price = base * d
            if (price - cost) / price < margin:
                continue
            sold = min(math.floor(min(rate / 60 * 120 / (d * d), stock)), stock)
            if sold * (price - cost) > best_p:
                best, best_p = d, sold * (price - cost)
        assert got[pid] == best


def test_on_track_score_rule(spark):
    upd = spark.createDataFrame([("s", "p", "2024-01-01", "2024-01-01 20:05:00", 1, 3.0, 20, 0),
                                 ("s", "p", "2024-01-01", "2024-01-01 20:25:00", 2, 1.0, 20, 0)],
                                "strategy_id string, plan_id string, sale_date string, ts string, event_id long, "
                                "quantity_sold double, initial_stock long, t int").withColumn("ts", F.to_timestamp("ts"))
    plan = spark.createDataFrame([("p", t, 0.8, 5) for t in range(4)], "plan_id string, t int, discount double, sold long")
    r = {x.t: x for x in MON.stage_performance(upd, plan).collect()}
    # stage 0: actual 4 of 5 expected, elapsed share 0.25 -> 0.5 + 0.5 * min(0.8 / 0.25, 2) = 1.5 -> clamped 1
    assert math.isclose(r[0].on_track_score, 1.0)
    assert math.isclose(r[0].deviation, -0.2) and math.isclose(r[0].sales_rate, 4 / (20 / 60))
    # stage 1 has no updates: deviation -1 and a needed adjustment
    assert r[1].deviation == -1.0 and r[1].needs_adjustment == 1
    assert r[3].remaining_stock == 16.0


def test_time_split_and_folds(spark):
    rows = [(f"p{i % 3}", f"2024-01-{1 + i // 3:02d}") for i in range(30)]
    df = spark.createDataFrame(rows, "product_code string, d string").select("product_code", F.to_date("d").alias("sale_date"))
    out = ML.fold_blocks(ML.time_split(ML.time_positions(df)), 5).orderBy("position").collect()
    assert [r.position for r in out] == list(range(1, 31))
    assert sum(r.is_train for r in out) == 24 and all(r.is_train for r in out[:24])
    assert [r.block for r in out] == [i // 6 for i in range(30)]
    assert [(r.sale_date, r.product_code) for r in out] == sorted((r.sale_date, r.product_code) for r in out)


def test_trend_is_pct_change_of_rolling_mean(spark):
    qty = [float(x) for x in [3, 5, 2, 8, 6, 4, 7, 9, 1, 5, 6, 2, 8, 3, 4, 6]]
    df = spark.createDataFrame([("p", f"2024-01-{i + 1:02d}", q) for i, q in enumerate(qty)], "product_code string, d string, qty double") \
              .select("product_code", F.to_date("d").alias("sale_date"), "qty")
    got = [r.qty_trend7 for r in FT.trend_features(df, ["product_code"], ["sale_date"]).orderBy("sale_date").collect()]
    ma = np.array([np.mean(qty[max(0, i - 6): i + 1]) for i in range(len(qty))])
    want = [0.0] * 7 + [ma[i] / ma[i - 7] - 1 for i in range(7, len(qty))]
    assert np.allclose(got, want)


def test_demand_follows_weather_and_calendar(spark):
    cases = [(26.0, 0, 0, 0, 0, 0, 1.0), (31.0, 0, 0, 0, 0, 0, 0.9), (22.0, 0, 0, 0, 0, 0, 1.1), (26.0, 1, 0, 0, 0, 0, 1.2),
             (26.0, 1, 1, 0, 0, 0, 0.8), (26.0, 0, 0, 1, 0, 0, 1.3), (26.0, 0, 0, 0, 1, 0, 1.2), (26.0, 0, 0, 0, 0, 1, 1.5),
             (31.0, 1, 0, 1, 1, 1, 0.9 * 1.2 * 1.3 * 1.2 * 1.5), (None, None, 0, None, None, None, 1.0)]
    df = spark.createDataFrame(cases, "temperature double, is_rainy int, is_fresh int, is_holiday int, is_weekend int, "
                                      "is_shopping_day int, factor double") \
              .select("*", F.lit(10.0).alias("hist_avg_sales"), F.lit(1.2).alias("price_elasticity"),
                      F.lit(1.0).alias("hist_promo_sales_ratio"), F.lit(0.0).alias("sales_trend"), F.lit(48).alias("shelf_life_hours"))
    args = F.lit(0.8), F.lit(1.0), F.lit(1000.0)
    got = df.select("factor", PR.heuristic_demand(*args, day=PR.PLAN_DAY).alias("d"), PR.heuristic_demand(*args).alias("plain")).collect()
    assert all(math.isclose(r.d, r.plain * r.factor, rel_tol=1e-12) for r in got)


def test_request_rules_name_every_reason(spark):
    rows = [("ok", 5, 10.0, None, "20:00", "22:00", 0.4, 0.9, 4, 0.1), ("hist", 5, None, None, "20:00", "22:00", 0.4, 0.9, 4, 0.1),
            ("wrap", 5, 10.0, 1.0, "23:00", "01:00", 0.4, 1.0, 1, 0.0), ("all", 0, None, 3.0, "20:00", "20:00", 0.9, 0.4, 0, 0.1),
            ("nulls", None, None, None, None, None, None, None, None, None), ("dear", 5, 10.0, 9.0, "20:00", "22:00", 0.4, 0.9, 4, 0.1),
            ("clock", 5, 10.0, 1.0, "8:00", "24:00", 0.4, 1.2, 4, 0.1), ("free", 5, -1.0, 1.0, "20:00", "22:00", 0.4, 0.9, 4, 0.1)]
    req = spark.createDataFrame(rows, "product_code string, initial_stock long, original_price double, cost_price double, promotion_start string, "
                                      "promotion_end string, min_discount double, max_discount double, time_segments int, min_gross_margin double")
    hist = spark.createDataFrame([("hist", 8.0), ("ok", 99.0)], "product_code string, hist_price double")
    valid, rejected = PR.validate_requests(req.withColumn("note", F.lit("kept")), hist)
    got = {r.product_code: r for r in valid.collect()}
    assert set(got) == {"ok", "hist", "wrap"} and got["hist"].original_price == 8.0 and got["ok"].original_price == 10.0
    assert math.isclose(got["hist"].cost_price, 5.6) and got["wrap"].cost_price == 1.0 and got["ok"].note == "kept"
    why = {r.product_code: list(r.reasons) for r in rejected.collect()}
    five = ["stock_must_be_positive", "no_price", "bad_window", "bad_discount_range", "no_segments"]
    assert why == {"all": five, "nulls": five, "dear": ["margin_out_of_reach"], "clock": ["bad_window", "bad_discount_range"], "free": ["no_price"]}


def test_point_in_time_never_looks_ahead(spark):
    spine = spark.createDataFrame([("a", "2024-01-02 10:00:00"), ("a", "2024-01-05 10:00:00"), ("b", "2024-01-01 00:00:00")], "k string, as_of string")
    price = spark.createDataFrame([("a", "2024-01-01 00:00:00", 1.0), ("a", "2024-01-02 10:00:00", 2.0), ("a", "2024-01-02 10:00:01", 3.0),
                                   ("b", "2024-01-02 00:00:00", 9.0)], "k string, at string, price double")
    stock = spark.createDataFrame([("a", "2023-01-01 00:00:00", 7, None), ("a", "2024-01-04 00:00:00", 8, "x")], "k string, at string, stock int, note string")
    got = {(r.k, r.as_of): (r.price, r.stock, r.note) for r in FT.point_in_time(spine, {"price": (price, "at"), "stock": (stock, "at")}, ["k"]).collect()}
    assert got == {("a", "2024-01-02 10:00:00"): (2.0, 7, None), ("a", "2024-01-05 10:00:00"): (3.0, 8, "x"), ("b", "2024-01-01 00:00:00"): (None, None, None)}


def test_align_columns(spark):
    from tillsight.operators.scenario import align_columns
    df = spark.createDataFrame([(1, "x", None)], "b int, extra string, c double")
    out = align_columns(df, [("a", "string", "none"), ("b", "double", 0), ("c", "double", 5.0)])
    assert out.dtypes == [("a", "string"), ("b", "double"), ("c", "double")] and [tuple(r) for r in out.collect()] == [("none", 1.0, None)]


def test_rule_discount_of_a_zero_price_or_stock(spark):
    import math
    from pyspark.sql import functions as F
    from tillsight.operators import pricing as PR
    rows = [(1, 10, 10, 0.0, 3.0), (2, 10, 10, 0.0, 0.0), (3, 0, 0, 2.0, 1.0), (4, 10, 10, 2.0, 1.8)]
    df = spark.createDataFrame(rows, "k int, initial long, remaining long, base double, cost double")
    got = {r.k: r.d for r in df.select("k", PR.rule_discount(F.lit(18), F.col("initial"), F.col("remaining"), F.col("base"), F.col("cost")).alias("d")).collect()}
    assert got[1] == math.inf and math.isnan(got[2]) and math.isnan(got[3]) and got[4] == 0.9
