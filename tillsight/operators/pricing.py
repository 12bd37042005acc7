"""Markdown pricing for every plan at once.

A *plan* is one row of a requests table (plan_id, product, stock, prices,
window, segments, margin). All operators are keyed by ``plan_id``:

* the demand grid plan x segment x discount is computed once (D4 / M16);
* stepped plans (D6, D7) are a dynamic program over a DataFrame frontier
  ``(plan_id, stock_left[, last_discount]) -> best (profit, path)``: each
  segment is one join with that segment's grid slice plus one grouped arg-max.
  Frontier and grid are hash-partitioned by ``plan_id`` once; the join and the
  aggregation (keyed by plan_id + state) reuse that partitioning, so the whole
  search has no cross-plan shuffle after the first. A plan holds at most
  (stock + 1) x |ladder| states, independent of the number of plans;
* plan metrics and reports are grouped aggregations by plan.

Demand is deterministic (the source system's random noise is omitted).
"""

from __future__ import annotations

import math
from typing import Collection, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import float_div
from ..session import cut_lineage

# Ladder and penalty of the staggered plan, feasibility limits.
STAGGER_LADDER = [1.0, 0.9, 0.8, 0.7, 0.6, 0.5]
PERCEPTION_WEIGHT = 0.3
MAX_DISCOUNT_CHANGE_PCT = 20.0
# Weather and calendar of a plan's day that demand reacts to (M16); absent ones are neutral.
PLAN_DAY = ("temperature", "is_rainy", "is_holiday", "is_weekend", "is_shopping_day")


# ---- D1 / D2 / D3 ---------------------------------------------------------------

def hhmm_minutes(c) -> F.Column:
    """'HH:MM' -> minutes of day."""
    parts = F.split(c, ":")
    return parts.getItem(0).cast("int") * 60 + parts.getItem(1).cast("int")


def minutes_hhmm(m) -> F.Column:
    """minutes (any) -> 'HH:MM' with wrap."""
    m = F.pmod(m.cast("int"), F.lit(1440))
    return F.format_string("%02d:%02d", (m / 60).cast("int"), m % 60)


def segment_frame(plans: DataFrame, segments_col: str = "time_segments") -> DataFrame:
    """Split each plan's window into segments of ``total // n`` minutes (ceil count),
    wrapping past midnight. Adds t, seg_minutes, start_time, end_time, time_remaining."""
    s, e = hhmm_minutes(F.col("promotion_start")), hhmm_minutes(F.col("promotion_end"))
    total = F.when(e <= s, e + 1440 - s).otherwise(e - s)
    p = plans.withColumn("_total", total).withColumn("seg_minutes", (F.col("_total") / F.col(segments_col)).cast("int"))
    n = (F.col("_total") / F.col("seg_minutes")).cast("int") + F.when(F.col("_total") % F.col("seg_minutes") != 0, 1).otherwise(0)
    p = p.withColumn("n_segments", n)
    p = p.select("*", F.explode(F.sequence(F.lit(0), F.col("n_segments") - 1)).alias("t"))
    st = s + F.col("t") * F.col("seg_minutes")
    return (p.withColumn("start_time", minutes_hhmm(st))
             .withColumn("end_time", minutes_hhmm(st + F.col("seg_minutes")))
             .withColumn("time_remaining", 1.0 - (F.col("t") * F.col("seg_minutes")) / F.col("_total")))


def ladder_linspace(lo: str = "min_discount", hi: str = "max_discount", n: int = 5) -> F.Column:
    """N evenly spaced levels lo..hi (numpy linspace arithmetic: lo + i*(hi-lo)/(n-1))."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)),
                       lambda i: F.col(lo) + i * ((F.col(hi) - F.col(lo)) / (n - 1)))


def min_price_from_margin(cost, min_margin) -> F.Column:
    """D3: the lowest price meeting a gross margin."""
    return cost / (1.0 - min_margin)


# ---- D4 / M16 / P31 ---------------------------------------------------------------

def stage_units(base_rate, price, p0, hours, epsilon: float = 1.0) -> F.Column:
    """``base * (price / p0) ** -epsilon * hours`` (0 for price <= 0). epsilon 1 and 2
    use plain division so the result is bit-identical across engines."""
    if epsilon == 1.0:
        f = p0 / price
    elif epsilon == 2.0:
        f = (p0 / price) * (p0 / price)
    else:
        f = F.pow(price / p0, -epsilon)
    return F.when(price > 0, F.greatest(F.lit(0.0), base_rate * f * hours)).otherwise(F.lit(0.0))


def discount_units(rate_per_hour, discount, minutes) -> F.Column:
    """D4 discount form: ``rate/60 * minutes * d**-2`` (elasticity 2)."""
    return rate_per_hour / 60 * minutes / (discount * discount)


def heuristic_demand(discount, tau, stock, hist_avg="hist_avg_sales", elasticity="price_elasticity",
                     promo_ratio="hist_promo_sales_ratio", trend="sales_trend", fresh="is_fresh",
                     shelf_life="shelf_life_hours", day: Collection[str] = ()) -> F.Column:
    """Multi-factor demand, clamped to [0.1, 0.8 * stock] (no random factor).

    price (1/d)^e, time e^{3(1-tau)}, stock 1 + 2/(1 + e^{-5(s - 0.5)}) with
    s = stock / max(3 * hist, 10), promo 1 + (r - 1)(1 - tau), weather (above 30
    degrees 0.9, 20 to 25: 1.1; rain 0.8 for fresh goods, else 1.2), calendar
    (holiday 1.3, weekend 1.2, shopping day 1.5), both from the PLAN_DAY columns
    named in ``day``; a column not named or null there is neutral, product
    (fresh: 1 + 2(1 - tau); shelf life < 24 h: x1.5), trend 1 + trend."""
    base = F.coalesce(F.col(hist_avg), F.lit(10.0))
    pf = F.pow(1.0 / discount, F.coalesce(F.col(elasticity), F.lit(1.2)))
    tf = F.exp(3 * (1.0 - tau))
    sr = stock / F.greatest(F.coalesce(F.col(hist_avg), F.lit(10.0)) * 3, F.lit(10.0))
    sf = 1.0 + 2.0 / (1.0 + F.exp(-5 * (sr - 0.5)))
    prf = 1.0 + (F.coalesce(F.col(promo_ratio), F.lit(1.2)) - 1.0) * (1.0 - tau)
    prod = (F.when(F.col(fresh) == 1, 1.0 + (1.0 - tau) * 2.0).otherwise(1.0)
            * F.when(F.col(shelf_life) < 24, 1.5).otherwise(1.0))
    tr = 1.0 + F.coalesce(F.col(trend), F.lit(0.0))

    def given(name):
        return F.col(name) if name in day else F.lit(None).cast("double")
    temp = given("temperature")
    weather = (F.when(temp > 30, 0.9).when((temp >= 20) & (temp <= 25), 1.1).otherwise(1.0)
               * F.when(given("is_rainy") == 1, F.when(F.col(fresh) == 1, 0.8).otherwise(1.2)).otherwise(1.0))
    calendar = (F.when(given("is_holiday") == 1, 1.3).otherwise(1.0) * F.when(given("is_weekend") == 1, 1.2).otherwise(1.0)
                * F.when(given("is_shopping_day") == 1, 1.5).otherwise(1.0))
    d = base * pf * tf * sf * prf * weather * calendar * prod * tr
    return F.greatest(F.lit(0.1), F.least(d, stock * 0.8))


def scenario_features(df: DataFrame, discount="discount", tau="time_remaining", stock="stock",
                      elasticity="price_elasticity", total_stock: float = 100.0) -> DataFrame:
    """Demand-scenario features of a (plan, segment, discount, stock) grid."""
    d, t, s = F.col(discount), F.col(tau), F.col(stock)
    return df.select("*", (s / total_stock).alias("stock_ratio"),
                     F.pow(1.0 / d, F.coalesce(F.col(elasticity), F.lit(1.2))).alias("price_elasticity_effect"),
                     (1.0 / (t + 0.1)).alias("urgency_factor"), (d < 0.7).cast("int").alias("is_high_discount"),
                     (d > 0.9).cast("int").alias("is_low_discount"), (d * t).alias("discount_time_interaction"),
                     (d * s).alias("discount_stock_interaction"), (t * s).alias("time_stock_interaction"))


# ---- D5 ---------------------------------------------------------------------------

def best_single_discount(plans: DataFrame, ladder: Sequence[float] = tuple(STAGGER_LADDER)) -> DataFrame:
    """One discount for the whole window: the ladder level with the largest
    ``floor(units) * (price - cost)`` among levels meeting the margin (higher
    price wins ties; 1.0 if no level makes a positive profit)."""
    s, e = hhmm_minutes(F.col("promotion_start")), hhmm_minutes(F.col("promotion_end"))
    minutes = F.pmod(e - s, F.lit(1440))
    g = plans.select("*", F.explode(F.array(*[F.lit(x) for x in ladder])).alias("discount"))
    g = g.withColumn("price", F.col("base_price") * F.col("discount"))
    g = g.where((F.col("price") > 0) & ((F.col("price") - F.col("cost_price")) / F.col("price") >= F.col("min_gross_margin")))
    units = F.least(F.floor(F.least(discount_units(F.col("sales_rate"), F.col("discount"), minutes),
                                    F.col("initial_stock"))), F.col("initial_stock"))
    g = g.withColumn("sold", units.cast("long")).withColumn("profit", F.col("sold") * (F.col("price") - F.col("cost_price")))
    best = g.where(F.col("profit") > 0).groupBy("plan_id").agg(F.max(F.struct("profit", "discount")).alias("_b"))
    out = plans.join(best, "plan_id", "left").withColumn("discount", F.coalesce("_b.discount", F.lit(1.0)))
    units = F.least(F.floor(F.least(discount_units(F.col("sales_rate"), F.col("discount"), minutes),
                                    F.col("initial_stock"))), F.col("initial_stock"))
    price = F.col("base_price") * F.col("discount")
    return out.select("plan_id", F.concat_ws("-", "promotion_start", "promotion_end").alias("time_slot"), "discount",
                      price.alias("price"), units.cast("long").alias("sold"),
                      (units * price).alias("revenue"), (units * (price - F.col("cost_price"))).alias("profit"))


def best_discount_with_leftover(plans: DataFrame, parts: int = 8, leftover_weight: float = 0.3) -> DataFrame:
    """D5, leftover variant: one discount for the whole window, of the whole percents from ``min_discount`` to 1.

    Each candidate sells through ``parts`` equal parts of the window: M16 demand for the time and stock then left, a part's
    share of it, whole units, at most the stock left. What stays unsold costs ``leftover_weight`` of its cost price.
    The largest profit wins, the higher price among equals. All levels are evaluated, where a bisection would
    trust the profit to have one peak."""
    day = [c for c in PLAN_DAY if c in plans.columns]
    percents = F.sequence(F.ceil(F.col("min_discount") * 100 - 1e-9).cast("int"), F.lit(100))
    g = plans.select("*", F.explode(percents).alias("_percent")).withColumn("discount", F.col("_percent") / F.lit(100.0))

    def sell(left, i):
        demand = heuristic_demand(F.col("discount"), 1.0 - i / parts, left, day=day)
        return left - F.least(F.floor(demand / parts), left).cast("long")

    left = F.aggregate(F.sequence(F.lit(0), F.lit(parts - 1)), F.col("initial_stock").cast("long"), sell)
    g = g.select("plan_id", "discount", "cost_price", (F.col("base_price") * F.col("discount")).alias("price"),
                 F.col("initial_stock").cast("long").alias("stock"), left.alias("leftover"))
    g = g.withColumn("sold", F.col("stock") - F.col("leftover")).withColumn("leftover_cost", F.col("leftover") * F.col("cost_price") * leftover_weight)
    g = g.withColumn("profit", (F.col("price") - F.col("cost_price")) * F.col("sold") - F.col("leftover_cost"))
    best = g.groupBy("plan_id").agg(F.max(F.struct("profit", "discount", "price", "sold", "leftover", "leftover_cost")).alias("_b"))
    return best.select("plan_id", "_b.*").withColumn("revenue", F.col("price") * F.col("sold"))


# ---- D6 / D7: frontier dynamic program ------------------------------------------------

def stepped_plan(plans: DataFrame, grid: DataFrame, n_steps: int, penalty_weight: float = 0.0,
                 units_expr=None, checkpoint_every: int = 4) -> DataFrame:
    """Best stepped plan per ``plan_id`` by dynamic programming over segments.

    plans: plan_id, initial_stock, base_price, cost_price (+ constant per-plan columns,
           carried along in the frontier so no step re-joins the plan table).
    grid:  plan_id, t, discount, units (+ columns ``units_expr`` reads) - one row per
           allowed (segment, discount); a plan without segment t stops there.
    units_expr(stock_left) -> expected units given the stock left (default: ``units``).
           Units sold = min(floor(units), stock left).
    penalty_weight: w in ``- w * |d_t - d_(t-1)| * sold * base`` for t >= 1 (D7); with
           0 (D6) the state is just the stock left.
    Ties keep the lexicographically greatest (profit, path).
    Returns plan_id, t, discount, sold, price, revenue, profit, total_profit.
    """
    keyed = penalty_weight != 0.0
    carry = [c for c in plans.columns if c not in ("plan_id", "initial_stock")]
    grid = grid.repartition("plan_id")
    path_t = "array<struct<t:int,discount:double,sold:bigint>>"
    frontier = (plans.select("plan_id", *carry, F.col("initial_stock").cast("long").alias("stock_left"),
                             F.lit(None).cast("double").alias("last_d"), F.lit(0.0).alias("profit"),
                             F.array().cast(path_t).alias("path"))
                .repartition("plan_id"))
    for t in range(n_steps):
        # left join: a plan whose segments are exhausted keeps its state unchanged
        x = frontier.join(grid.where(F.col("t") == t).drop("t"), "plan_id", "left")
        live = F.col("discount").isNotNull()
        units = F.col("units") if units_expr is None else units_expr(F.col("stock_left"))
        x = x.withColumn("sold", F.least(F.floor(units), F.col("stock_left")).cast("long"))
        price = F.col("base_price") * F.col("discount")
        seg = F.col("sold") * (price - F.col("cost_price"))
        if keyed and t > 0:
            seg = seg - F.lit(penalty_weight) * F.abs(F.col("discount") - F.col("last_d")) * F.col("sold") * F.col("base_price")
        step = F.array(F.struct(F.lit(t).alias("t"), F.col("discount").alias("discount"), F.col("sold").alias("sold")))
        x = x.select("plan_id", *carry,
                     F.when(live, F.col("stock_left") - F.col("sold")).otherwise(F.col("stock_left")).alias("stock_left"),
                     F.when(live, F.col("discount")).otherwise(F.col("last_d")).alias("last_d"),
                     F.when(live, F.col("profit") + seg).otherwise(F.col("profit")).alias("profit"),
                     F.when(live, F.concat("path", step)).otherwise(F.col("path")).alias("path"))
        key = ["plan_id", *carry, "stock_left"] + (["last_d"] if keyed else [])
        best = x.groupBy(*key).agg(F.max(F.struct("profit", "path", "last_d")).alias("_b"))
        frontier = best.select(*[c for c in key if c != "last_d"], "_b.last_d", "_b.profit", "_b.path")
        if checkpoint_every and (t + 1) % checkpoint_every == 0 and t + 1 < n_steps:
            frontier = cut_lineage(frontier)
    win = frontier.groupBy("plan_id", "base_price", "cost_price").agg(F.max(F.struct("profit", "path")).alias("_w"))
    rows = win.select("plan_id", "base_price", "cost_price", F.col("_w.profit").alias("total_profit"),
                      F.explode("_w.path").alias("_s"))
    price = F.col("base_price") * F.col("_s.discount")
    return rows.select("plan_id", F.col("_s.t").alias("t"), F.col("_s.discount").alias("discount"),
                       F.col("_s.sold").alias("sold"), price.alias("price"), (price * F.col("_s.sold")).alias("revenue"),
                       ((price - F.col("cost_price")) * F.col("_s.sold")).alias("profit"), "total_profit")


def staggered_grid(plans: DataFrame, ladder: Sequence[float] = tuple(STAGGER_LADDER), slots: int = 4) -> DataFrame:
    """D7 grid: ``slots`` equal slots, ladder levels meeting the margin (or full price only
    when none does), units = rate/60 * slot minutes * d**-2."""
    s, e = hhmm_minutes(F.col("promotion_start")), hhmm_minutes(F.col("promotion_end"))
    slot_min = F.pmod(e - s, F.lit(1440)) / slots
    g = plans.select("plan_id", "base_price", "cost_price", "min_gross_margin", "sales_rate", slot_min.alias("_sm"),
                     F.explode(F.array(*[F.lit(x) for x in ladder])).alias("discount"))
    price = F.col("base_price") * F.col("discount")
    ok = (price > 0) & ((price - F.col("cost_price")) / price >= F.col("min_gross_margin"))
    any_ok = F.max(ok.cast("int")).over(Window.partitionBy("plan_id"))
    g = g.withColumn("_ok", ok).withColumn("_any", any_ok)
    g = g.where(F.col("_ok") | ((F.col("_any") == 0) & (F.col("discount") == max(ladder))))
    g = g.select("plan_id", "discount", discount_units(F.col("sales_rate"), F.col("discount"), F.col("_sm")).alias("units"))
    return g.select("*", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("t"))


def staggered_plan(plans: DataFrame, slots: int = 4) -> DataFrame:
    """Stepped plan with margin floor and price-change penalty, plus slot labels."""
    pl = plans.select("plan_id", "initial_stock", "base_price", "cost_price")
    plan = stepped_plan(pl, staggered_grid(plans, slots=slots), slots, penalty_weight=PERCEPTION_WEIGHT)
    s = hhmm_minutes(F.col("promotion_start"))
    e = hhmm_minutes(F.col("promotion_end"))
    sm = F.pmod(e - s, F.lit(1440)) / slots
    lab = plans.select("plan_id", "promotion_start", "promotion_end")
    st = s + F.col("t") * sm
    return (plan.join(lab, "plan_id")
                .withColumn("time_slot", F.concat_ws("-", minutes_hhmm(st), minutes_hhmm(st + sm)))
                .withColumn("discount_percentage", F.round((1 - F.col("discount")) * 100, 1))
                .drop("promotion_start", "promotion_end"))


def staged_grid(plans: DataFrame, levels: int = 5) -> DataFrame:
    """D6 grid: segments (D1) x linspace ladder, stock-free part of the M16 demand."""
    seg = segment_frame(plans)
    return seg.select("plan_id", "t", "time_remaining", F.explode(ladder_linspace(n=levels)).alias("discount"),
                      F.lit(0.0).alias("units"))


def staged_plan(plans: DataFrame, levels: int = 5) -> DataFrame:
    """Max-profit stepped plan over the D1 segments with M16 demand (the stock term
    is applied inside the search, so demand follows the stock left)."""
    feats = ["hist_avg_sales", "price_elasticity", "hist_promo_sales_ratio", "sales_trend", "is_fresh", "shelf_life_hours"]
    day = [c for c in PLAN_DAY if c in plans.columns]
    grid = staged_grid(plans, levels).drop("units").join(plans.select("plan_id", *feats, *day), "plan_id")
    grid = grid.withColumn("units", F.lit(0.0))
    # loop bound: the largest segment count of any plan (a one-row aggregate)
    n = segment_frame(plans).agg(F.max("n_segments")).first()[0] or 0
    pl = plans.select("plan_id", "initial_stock", "base_price", "cost_price")
    plan = stepped_plan(pl, grid, n, units_expr=lambda stock: heuristic_demand(F.col("discount"), F.col("time_remaining"), stock, day=day))
    seg = segment_frame(plans).select("plan_id", "t", "start_time", "end_time")
    return plan.join(seg, ["plan_id", "t"], "left")


# ---- D8 -----------------------------------------------------------------------------

def greedy_clearing(plans: DataFrame, stages: int = 4, candidates: Sequence[float] = (0.1, 0.2, 0.3, 0.4, 0.5),
                    epsilon: float = 1.0) -> DataFrame:
    """Highest price first in every stage; if expected sales miss the stock, deepen
    the discount from the last stage backwards (first level that clears, else the
    deepest) until they do. Per plan the (stage x level) table is tiny, so the
    sequential rule runs as an ``aggregate`` over the reversed stage array.

    plans need stage base rates ``base_rates`` (array<double>, per stage), ``stage_hours``,
    ``base_price`` (p0), ``min_price``, ``initial_stock``."""
    cand = F.array(*[F.lit(c) for c in candidates])
    # table[k][j] = expected units of stage k at level j
    table = F.transform(F.sequence(F.lit(0), F.lit(stages - 1)), lambda k: F.transform(cand, lambda d: stage_units(
        F.element_at("base_rates", k + 1), F.greatest(F.col("base_price") * (1 - d), F.col("min_price")),
        F.col("base_price"), F.col("stage_hours"), epsilon)))
    p = plans.withColumn("_tab", table)
    init_cum = F.aggregate(F.transform("_tab", lambda row: F.element_at(row, 1)), F.lit(0.0), lambda a, x: a + x)
    start = F.struct(init_cum.alias("cum"), F.array_repeat(F.lit(0), stages).alias("choice"))

    def step(acc, k):
        row = F.element_at(F.col("_tab"), k + 1)
        cur = F.element_at(row, 1)
        hits = F.transform(F.sequence(F.lit(2), F.lit(len(candidates))),
                           lambda j: (acc["cum"] - cur + F.element_at(row, j)) >= F.col("initial_stock"))
        pos = F.array_position(hits, True)
        j = F.when(pos > 0, pos + 1).otherwise(F.lit(len(candidates))).cast("int")
        new_cum = acc["cum"] - cur + F.element_at(row, j)
        changed = F.struct(new_cum.alias("cum"),
                           F.transform(acc["choice"], lambda c, i: F.when(i == k, j - 1).otherwise(c)).alias("choice"))
        return F.when((acc["cum"] >= F.col("initial_stock")) | F.lit(len(candidates) < 2), acc).otherwise(changed)
    res = F.aggregate(F.reverse(F.sequence(F.lit(0), F.lit(stages - 1))), start, step)
    p = p.withColumn("_res", res)
    out = p.select("plan_id", "base_price", "min_price", "_tab", "_res.choice",
                   F.posexplode(F.col("_res.choice")).alias("stage", "_j"))
    d = F.element_at(cand, F.col("_j") + 1)
    return out.select("plan_id", "stage", d.alias("discount"),
                      F.greatest(F.col("base_price") * (1 - d), F.col("min_price")).alias("price"),
                      F.element_at(F.element_at("_tab", F.col("stage") + 1), F.col("_j") + 1).alias("expected_sales"))


# ---- D9 -----------------------------------------------------------------------------

def rule_discount(hour, initial, remaining, base_price, cost_price) -> F.Column:
    """0.95 - 1.2 (1 - sqrt((24 - h)/24)) - 0.8 remaining/initial, floored at
    cost/base and at 0.5. A base price or stock of 0 has no share: the result is infinite or NaN, as its floor is."""
    d = 0.95 - 1.2 * (1 - F.sqrt((24 - hour) / 24.0)) - 0.8 * float_div(remaining, initial)
    return F.greatest(F.greatest(d, float_div(cost_price, base_price)), F.lit(0.5))


# ---- D10 / D11 / D12 / D15 / D16 / D18 -------------------------------------------------

def plan_metrics(plan_rows: DataFrame, plans: DataFrame) -> DataFrame:
    """D10 + D12: totals, clearance, sales-weighted discount %, margin, leftover,
    feasibility flags and recommendation."""
    w = Window.partitionBy("plan_id").orderBy("t")
    r = plan_rows.withColumn("_chg", F.abs(F.col("discount_percentage") - F.lag("discount_percentage").over(w)))
    g = r.groupBy("plan_id").agg(
        F.sum("sold").alias("total_expected_sales"), F.sum("revenue").alias("total_expected_revenue"),
        F.sum("profit").alias("total_expected_profit"),
        F.sum(F.col("sold") * (1 - F.col("discount_percentage") / 100)).alias("_w"),
        F.max("_chg").alias("max_change"), F.count("*").alias("n_segments"))
    g = g.join(plans.select("plan_id", "initial_stock", "min_gross_margin"), "plan_id")
    clear = F.when(F.col("initial_stock") > 0, F.col("total_expected_sales") / F.col("initial_stock")).otherwise(0.0)
    wd = F.when(F.col("total_expected_sales") > 0, F.col("_w") / F.col("total_expected_sales")).otherwise(0.0)
    margin = F.when(F.col("total_expected_revenue") > 0,
                    F.col("total_expected_profit") / F.col("total_expected_revenue")).otherwise(0.0)
    g = (g.withColumn("clearance_rate", clear).withColumn("avg_discount", F.round((1 - wd) * 100, 2))
          .withColumn("avg_gross_margin", margin)
          .withColumn("remaining_inventory", F.greatest(F.lit(0), F.col("initial_stock") - F.col("total_expected_sales"))))
    can = F.col("clearance_rate") >= 0.95
    meets = F.col("avg_gross_margin") >= F.col("min_gross_margin")
    reasonable = F.when(F.col("n_segments") > 1, F.coalesce(F.col("max_change") <= MAX_DISCOUNT_CHANGE_PCT, F.lit(True))).otherwise(True)
    accept = F.col("avg_discount") <= 50
    rec = (F.when(~can, "increase_discount_or_extend_window").when(~meets, "margin_not_met")
            .when(~reasonable, "smooth_discount_steps").otherwise("feasible"))
    return g.select("plan_id", "total_expected_sales", "total_expected_revenue", "total_expected_profit",
                    "clearance_rate", "avg_discount", "avg_gross_margin", "remaining_inventory",
                    can.cast("int").alias("can_clear_inventory"), meets.cast("int").alias("meets_margin_requirement"),
                    reasonable.cast("int").alias("reasonable_pricing_strategy"),
                    accept.cast("int").alias("customer_acceptance_likely"), rec.alias("recommendation"))


def schedule_evaluation(schedule: DataFrame, plans: DataFrame) -> DataFrame:
    """Sell-out probability, margin, mean discount, clearance and label."""
    g = schedule.groupBy("plan_id").agg(F.sum("sold").alias("total_expected_sales"),
                                        F.sum("revenue").alias("total_revenue"), F.sum("profit").alias("total_profit"),
                                        F.avg("discount").alias("average_discount"))
    g = g.join(plans.select("plan_id", "initial_stock"), "plan_id")
    st = F.col("initial_stock")
    sell = F.when(st > 0, F.least(F.lit(1.0), F.col("total_expected_sales") / st)).otherwise(0.0)
    margin = F.when(F.col("total_revenue") > 0, F.col("total_profit") / F.col("total_revenue")).otherwise(0.0)
    g = g.withColumn("sell_out_probability", sell).withColumn("profit_margin", margin)
    label = (F.when(F.col("sell_out_probability") < 0.7,
                    F.when(F.col("profit_margin") < 0.1, "high_risk").otherwise("sell_out_risk"))
              .when(F.col("sell_out_probability") < 0.9,
                    F.when(F.col("profit_margin") > 0.2, "good_balance").otherwise("acceptable"))
              .otherwise(F.when(F.col("profit_margin") > 0.15, "excellent").otherwise("conservative")))
    return g.select("plan_id", "total_expected_sales", "total_revenue", "total_profit",
                    F.greatest(F.lit(0), st - F.col("total_expected_sales")).alias("remaining_stock"),
                    "sell_out_probability", "profit_margin", "average_discount",
                    F.when(st > 0, F.col("total_expected_sales") / st).otherwise(0.0).alias("stock_clearance_rate"),
                    label.alias("recommendation"))


def confidence_score(df: DataFrame, model_score=None) -> DataFrame:
    """0.25 data + 0.25 features + 0.30 model + 0.20 business, clipped to [0.1, 0.95].
    Needs total_transactions, recent_transaction_days, hist_avg_sales, hist_sales_std,
    price_elasticity, sell_out_probability; model score 0.5 when no model was fitted."""
    data = F.least(F.col("total_transactions") / 200, F.col("recent_transaction_days") / 30, F.lit(1.0))
    feats = (F.col("hist_avg_sales").isNotNull().cast("int") + F.col("hist_sales_std").isNotNull().cast("int")
             + F.col("price_elasticity").isNotNull().cast("int")) / 3
    model = F.lit(0.5) if model_score is None else F.coalesce(model_score, F.lit(0.7))
    business = F.greatest(1.0 - F.abs(F.col("sell_out_probability") - 0.8) * 2, F.lit(0.0))
    c = data * 0.25 + feats * 0.25 + model * 0.30 + business * 0.20
    return df.withColumn("confidence", F.least(F.greatest(c, F.lit(0.1)), F.lit(0.95)))


def strategy_advice(df: DataFrame) -> DataFrame:
    """Advice labels from sell-out probability and confidence."""
    s, c = F.col("sell_out_probability"), F.col("confidence")
    return (df.withColumn("sellout_advice", F.when(s > 0.9, "raise_price_or_stock").when(s > 0.7, "keep_pricing")
                          .otherwise("deepen_discount"))
              .withColumn("confidence_advice", F.when(c > 0.8, "execute").when(c > 0.6, "execute_and_monitor")
                          .otherwise("execute_with_fallback")))


def batch_report(metrics: DataFrame, plans: DataFrame) -> DataFrame:
    """Success rate (plans with a non-empty plan), total profit, mean clearance."""
    j = plans.select("plan_id").join(metrics, "plan_id", "left")
    return j.agg(F.count("*").alias("total_products"),
                 F.count("total_expected_sales").alias("successful"),
                 (F.count("total_expected_sales") / F.count("*")).alias("success_rate"),
                 F.coalesce(F.sum("total_expected_profit"), F.lit(0.0)).alias("total_expected_profit"),
                 F.avg("clearance_rate").alias("avg_clearance_rate"))


CLOCK = r"^([01][0-9]|2[0-3]):[0-5][0-9]$"


def request_rules() -> list[tuple[str, F.Column]]:
    """(reason, condition under which a request is refused), in the order of the reasons. Missing values refuse."""
    c = F.col
    bad = lambda ok: ~F.coalesce(ok, F.lit(False))
    window = c("promotion_start").rlike(CLOCK) & c("promotion_end").rlike(CLOCK) & (c("promotion_start") != c("promotion_end"))
    least = c("original_price") * c("max_discount") * (1 - c("min_gross_margin"))
    return [("stock_must_be_positive", bad(c("initial_stock") > 0)), ("no_price", bad(c("original_price") > 0)), ("bad_window", bad(window)),
            ("bad_discount_range", bad((c("min_discount") > 0) & (c("min_discount") <= c("max_discount")) & (c("max_discount") <= 1))),
            ("no_segments", bad(c("time_segments") >= 1)),
            # only a known price and range can be out of reach of the margin
            ("margin_out_of_reach", F.coalesce((c("original_price") > 0) & (c("max_discount") <= 1) & (c("cost_price") > least), F.lit(False)))]


def validate_requests(req: DataFrame, history_price: DataFrame | None = None, rules=None) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected). A missing price becomes the mean historical price (``history_price``: product_code,
    hist_price), a missing cost 70 % of the price; then every rule is evaluated in one pass and a rejected request keeps all its
    ``reasons``. Columns beyond those of the rules stay."""
    r = req
    if history_price is not None:
        r = r.join(history_price, "product_code", "left").withColumn(
            "original_price", F.coalesce("original_price", "hist_price")).drop("hist_price")
    r = r.withColumn("cost_price", F.coalesce("cost_price", F.col("original_price") * 0.7))
    r = r.withColumn("reasons", F.array_compact(F.array(*[F.when(refused, F.lit(n)) for n, refused in (rules or request_rules())])))
    return r.where(F.size("reasons") == 0).drop("reasons"), r.where(F.size("reasons") > 0)


__all__ = [n for n in dir() if not n.startswith("_")] + ["math"]
