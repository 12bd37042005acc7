"""Hand-worked fixtures for the pandas-specific semantics and the custom operators."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tillsight.functions.expr import rnd, time_slot
from tillsight.operators import evaluate as EV
from tillsight.operators import features as FT
from tillsight.operators import ml as ML
from tillsight.operators import patterns as PT
from tillsight.operators import pricing as PR
from tillsight.operators.clean import clock_in_range, filter_hours
from tillsight.streaming import monitor as MON


def test_round_half_up_is_tie_tolerant(spark):
    df = spark.createDataFrame([(0.00125,), (2.675,), (-0.00005,), (1.23456,)], "x double")
    got = [r[0] for r in df.select(rnd("x")).collect()]
    assert got == [0.0013, 2.675, -0.0, 1.2346] or got == [0.0013, 2.675, 0.0, 1.2346]


def test_time_slot_and_wrapping_filters(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00",), ("2024-01-01 23:59:00",), ("2024-01-01 22:30:00",),
                                ("2024-01-01 01:10:00",)], "s string").select(F.to_timestamp("s").alias("sale_ts"))
    assert [r[0] for r in df.select(time_slot("sale_ts", 30)).collect()] == [1, 48, 46, 3]
    assert filter_hours(df, 22, 2).count() == 4          # hours 0, 23, 22, 1 all lie in [22, 2]
    assert df.where(clock_in_range(F.col("sale_ts"), "22:00", "01:00")).count() == 3  # 00:00, 23:59, 22:30


def test_holiday_streak_islands(spark):
    flags = [0, 1, 1, 0, 1, 1, 1, 0]
    cal = spark.createDataFrame([(f"2024-01-0{i + 1}", f) for i, f in enumerate(flags)], "d string, is_holiday int") \
               .select(F.to_date("d").alias("date"), "is_holiday")
    got = [r.holiday_streak for r in FT.holiday_streak(cal).orderBy("date").collect()]
    assert got == [0, 2, 2, 0, 3, 3, 3, 0]


def test_elasticity_bins_drop_duplicate_edges(spark):
    # rates with many ties: quantile edges collapse, pandas qcut(duplicates='drop') semantics
    rates = [0.5] * 6 + [0.8] * 4 + [1.0] * 2
    qty = [10, 12, 9, 11, 10, 8, 5, 6, 4, 5, 2, 3]
    df = spark.createDataFrame([("s", "p", r, float(q)) for r, q in zip(rates, qty)],
                               "store_code string, product_code string, discount_rate double, qty double")
    got = PT.price_elasticity(df, bins=5, min_rows=10).first().price_elasticity
    s = pd.Series(rates)
    bins = pd.qcut(s, q=5, duplicates="drop")
    g = pd.DataFrame({"r": rates, "q": qty, "b": bins}).groupby("b", observed=True).agg(r=("r", "mean"), q=("q", "sum"))
    g = g.reset_index(drop=True)
    vals = []
    for i in range(1, len(g)):
        pc = (g.r[i] - g.r[i - 1]) / g.r[i - 1]
        qc = (g.q[i] - g.q[i - 1]) / max(g.q[i - 1], 1)
        if pc != 0:
            vals.append(abs(qc / pc))
    assert math.isclose(got, float(np.mean(vals)), rel_tol=1e-9)


def _brute_stagger(stock, base, cost, rate, margin, ladder, slots=4, w=0.3, slot_min=30.0):
    ok = [d for d in ladder if (base * d - cost) / (base * d) >= margin] or [1.0]
    best = None
    for path in itertools.product(ok, repeat=slots):
        s, prof, prev, steps = stock, 0.0, None, []
        for t, d in enumerate(path):
            sold = int(min(math.floor(rate / 60 * slot_min / (d * d)), s))
            seg = sold * (base * d - cost)
            if t > 0:
                seg -= w * abs(d - prev) * sold * base
            prof, s, prev = prof + seg, s - sold, d
            steps.append((t, d, sold))
        key = (prof, steps)
        if best is None or key > best:
            best = key
    return best


def test_staggered_dp_equals_brute_force(spark):
    rows = [("a", 12, 7.99, 2.5, 6.0, 0.1), ("b", 5, 5.99, 4.9, 3.0, 0.1), ("c", 30, 3.0, 0.5, 20.0, 0.2)]
    plans = spark.createDataFrame(rows, "plan_id string, initial_stock long, base_price double, cost_price double, "
                                        "sales_rate double, min_gross_margin double") \
                 .withColumn("promotion_start", F.lit("20:00")).withColumn("promotion_end", F.lit("22:00"))
    got = {r.plan_id: r for r in PR.staggered_plan(plans).where("t = 0").collect()}
    for pid, stock, base, cost, rate, margin in rows:
        prof, steps = _brute_stagger(stock, base, cost, rate, margin, PR.STAGGER_LADDER)
        assert math.isclose(got[pid].total_profit, prof, rel_tol=1e-12, abs_tol=1e-9)
        assert got[pid].discount == steps[0][1]


@pytest.mark.parametrize("block", [10_000, 3, 7])
def test_similar_products_equals_all_pairs(spark, block):
    rng = np.random.default_rng(7)
    # many price ties; a hot category, small ones and one of a single product
    prods = [(f"p{i:02d}", f"c{i % 3 if i % 7 else 0}", float(rng.integers(1, 6))) for i in range(50)] + [("lone", "c9", 2.0)]
    df = spark.createDataFrame(prods, "product_code string, category_code string, avg_price double")
    got = {(r.product_code, r.rank): r.other for r in PT.similar_products(df, k=3, block=block).collect()}
    assert "lone" not in {p for p, _ in got}
    pdf = pd.DataFrame(prods, columns=["p", "c", "x"]).sort_values(["c", "x", "p"])
    pdf["pos"] = pdf.groupby("c").cumcount()
    for _, a in pdf.iterrows():
        others = pdf[(pdf.c == a.c) & (pdf.p != a.p)].copy()
        others["d"] = (others.x - a.x).abs()
        others["dp"] = (others.pos - a.pos).abs()
        top = others.sort_values(["d", "dp", "p"]).head(3).p.tolist()
        assert [got[(a.p, k)] for k in range(1, len(top) + 1)] == top


def test_nearest_date_sample_matches_brute_force(spark):
    dates = pd.to_datetime("2024-01-01") + pd.to_timedelta(sorted(set(np.random.default_rng(3).integers(0, 400, 180))), "D")
    df = spark.createDataFrame([("k", d.date(), 1.0) for d in dates], "product_code string, sale_date date, v double")
    got = sorted(r.sale_date for r in EV.nearest_date_sample(df, ["product_code"], n=100).collect())
    s = pd.Series(dates)
    picks = set()
    days = (s - s.min()).dt.days
    for i in range(100):        # targets from the first to the last date
        picks.add((days * 99 - i * days.max()).abs().idxmin())
    assert got == sorted(d.date() for d in s.loc[sorted(picks)])


def test_lof_1d_matches_brute_force():
    x = np.array([1.0, 1.1, 1.2, 1.3, 5.0, 1.25, 0.9, 1.05, 1.15, 9.0])
    k = 3
    d = np.abs(x[:, None] - x[None, :])
    np.fill_diagonal(d, np.inf)
    nn = np.array([np.lexsort((np.arange(len(x)), row))[:k] for row in d])
    kd = np.array([d[i, nn[i]].max() for i in range(len(x))])
    reach = np.maximum(kd[nn], np.abs(x[nn] - x[:, None]))
    lrd = 1 / reach.mean(axis=1)
    lof = lrd[nn].mean(axis=1) / lrd
    assert np.allclose(ML._lof_1d(x, k), lof)


def test_progress_monitor_caps_adjustments(spark):
    rows = [("s", "p", "2024-01-01", f"2024-01-01 20:{m:02d}:00", i, 0.1, 1000, 0) for i, m in enumerate(range(0, 50, 5))]
    upd = spark.createDataFrame(rows, "strategy_id string, plan_id string, sale_date string, ts string, event_id long, "
                                      "quantity_sold double, initial_stock long, t int") \
               .withColumn("ts", F.to_timestamp("ts"))
    plan = spark.createDataFrame([("p", 0, 0.9)], "plan_id string, t int, discount double")
    m = MON.progress_monitor(upd, plan).orderBy("ts").collect()
    assert sum(r.adjustment_needed for r in m) == MON.MAX_ADJUSTMENTS
    assert m[-1].adjustment_type == "max_adjustments_reached"
    assert all(r.new_discount >= MON.EMERGENCY_FLOOR for r in m)


def test_discount_ladder_has_no_float_drift(spark):
    from tillsight.operators.scenario import discount_ladder
    got = spark.range(1).select(discount_ladder()).first()[0]
    assert got == [0.4, 0.5, 0.6, 0.7, 0.8, 0.9]


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert "qty_ma7" in df.columns


def test_sales_pattern_sums_in_one_aggregate(spark):
    """The parts that need only sums of a key's rows are one aggregate, not a join each, and equal the parts alone."""
    import datetime as dt
    from tillsight.operators import patterns as PT
    at = dt.datetime(2024, 3, 1)
    data = [("0", p, at + dt.timedelta(hours=5 * i + (p or 0)), (at + dt.timedelta(hours=5 * i + (p or 0))).date(), float(1 + i % 4), 3.0 * i, 2.0 + i % 3,
             (i % 5) / 10.0, i % 2, "01" if i % 3 else "07", 18 + i % 15, i % 7 == 0, i % 6 == 0) for p in (1, 2, None) for i in range(60)]
    rows = spark.createDataFrame([(*r[:11], int(r[11]), int(r[12])) for r in data], "store_code string, product_code int, sale_ts timestamp, "
                                 "sale_date date, qty double, gross_amount double, avg_price double, discount_rate double, is_promo int, "
                                 "code_day string, high int, holiday_legal int, weekend int")
    got = PT.sales_pattern(rows)
    kept = PT.lookback(rows)
    for part in (PT.promo_hours_performance(kept), PT.weather_impact(kept), PT.holiday_impact_ratios(kept)):
        assert sorted(map(str, part.collect())) == sorted(map(str, got.select(*part.columns).collect()))
    assert got.count() == 2
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter") <= 4
