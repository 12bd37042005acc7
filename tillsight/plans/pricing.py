"""Pricing queries (D1-D18, M16, P31) over plan requests derived from the hourly feed.

Oracles: the stepped plans (D6, D7) are checked against a brute-force
enumeration of every discount path in DuckDB; everything else is plain SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as FT
from ..operators import patterns as PT
from ..operators import pricing as PR
from ..schema import SHOPPING_DAYS, WEATHER_TYPE_CODES
from .features import SLOT_AGG_SQL, hourly_slots
from .patterns import _RAINY, ENRICHED_SQL, KEYS, elasticity_sql, enriched_hourly
from .registry import register
from ..session import cut_lineage
from .sqlparts import out_cols, out_sql, with_

WINDOW = ("20:00", "22:00")


def dbl(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def plan_requests(spark, d):
    """D13/D14 inputs: one markdown request per (store, product) of the hourly feed.

    stock = ceil(units per sale day); base price = latest list price; cost = A37;
    sales rate = A31 promo-hour mean; history = A28; elasticity = A29 (4 bins);
    weather and calendar of the day of the latest sale (M16)."""
    rows = enriched_hourly(spark, d)
    g = rows.groupBy(*KEYS).agg(
        F.max_by("list_price", F.struct("sale_ts", "order_id")).alias("base_price"),
        F.ceil(F.sum("qty") / F.count_distinct("sale_date")).cast("long").alias("initial_stock"),
        F.avg(F.col("list_price") * F.col("discount_rate")).alias("_m"),
        F.count("*").alias("total_transactions"), F.count_distinct("sale_date").alias("recent_transaction_days"),
        F.min("category_code").alias("category_code"),
        F.max_by(F.struct("sale_date", "high", "low", "code_day", "holiday_legal", "weekend"), "sale_ts").alias("day"))
    g = g.withColumn("cost_price", F.least(F.greatest(F.col("_m") * 0.3, F.col("_m") * 0.1), F.col("_m") * 0.9)).drop("_m")
    rate = PT.sales_rate_profile(hourly_slots(spark, d).withColumn("hour", F.col("slot") - 1), KEYS) \
             .select(*KEYS, F.col("avg_rate").alias("sales_rate"))
    hist = PT.asof_history(rows, PT.latest_asof(rows, KEYS), KEYS).drop("as_of", "last_week_sales", "recent_3h_sales")
    el = PT.price_elasticity(rows, KEYS, bins=4, min_rows=20)
    fresh = F.coalesce(F.col("category_code").startswith("20"), F.lit(False))
    rainy = F.lpad("day.code_day", 2, "0").isin(*WEATHER_TYPE_CODES["is_rainy"])
    req = (g.join(rate, KEYS, "left").join(hist, KEYS, "left").join(el, KEYS, "left")
             .select(F.concat_ws("-", *KEYS).alias("plan_id"), *KEYS, "initial_stock", "base_price", "cost_price",
                     F.coalesce("sales_rate", F.lit(5.0)).alias("sales_rate"), "total_transactions",
                     "recent_transaction_days", "hist_avg_sales", "hist_sales_std", "hist_promo_sales_ratio",
                     "sales_trend", F.coalesce("price_elasticity", F.lit(1.2)).alias("price_elasticity"),
                     fresh.cast("int").alias("is_fresh"), F.when(fresh, 24).otherwise(168).alias("shelf_life_hours"),
                     F.lit(WINDOW[0]).alias("promotion_start"), F.lit(WINDOW[1]).alias("promotion_end"),
                     F.lit(0.4).alias("min_discount"), F.lit(0.9).alias("max_discount"), F.lit(4).alias("time_segments"),
                     F.lit(0.1).alias("min_gross_margin"),
                     ((F.col("day.high") + F.col("day.low")) / 2).alias("temperature"),
                     F.coalesce(rainy, F.lit(False)).cast("int").alias("is_rainy"),
                     F.coalesce("day.holiday_legal", F.lit(0)).alias("is_holiday"),
                     F.coalesce("day.weekend", F.lit(0)).alias("is_weekend"),
                     FT.shopping_day(F.col("day.sale_date")).cast("int").alias("is_shopping_day")))
    # One row per plan, read by the grid, the search and the reports: materialised once in
    # the shared checkpoint folder instead of being re-derived from the fact rows by each.
    return cut_lineage(req.repartition("plan_id"))


_SHOP = " OR ".join(f"(month(sale_date) = {m} AND day(sale_date) = {x})" for m, x in SHOPPING_DAYS)
_PROMO = "hour(sale_ts) >= 20 AND hour(sale_ts) < 22"
PLANS_SQL = [*ENRICHED_SQL, SLOT_AGG_SQL, elasticity_sql("er", bins=4, min_rows=20, name="el4"), f"""
lastp AS (SELECT store_code, product_code, list_price AS base_price, CAST(high + low AS DOUBLE) / 2 AS temperature,
                 CAST(coalesce(lpad(code_day, 2, '0') IN {_RAINY}, false) AS INT) AS is_rainy,
                 coalesce(holiday_legal, 0) AS is_holiday, coalesce(weekend, 0) AS is_weekend,
                 CAST({_SHOP} AS INT) AS is_shopping_day FROM (
  SELECT *, row_number() OVER (PARTITION BY store_code, product_code ORDER BY sale_ts DESC, order_id DESC) AS rn FROM er)
  WHERE rn = 1),
pg AS (SELECT store_code, product_code, CAST(ceil(sum(qty) / count(DISTINCT sale_date)) AS BIGINT) AS initial_stock,
              avg(list_price * discount_rate) AS m, count(*) AS total_transactions,
              count(DISTINCT sale_date) AS recent_transaction_days, min(category_code) AS category_code
       FROM er GROUP BY ALL),
rate AS (SELECT store_code, product_code, coalesce(avg(qty) FILTER (WHERE slot - 1 >= 20 AND slot - 1 < 22), 5.0) AS sales_rate
         FROM slots GROUP BY ALL),
ao AS (SELECT store_code, product_code, max(sale_ts) AS as_of FROM er GROUP BY ALL),
hg AS (
  SELECT h.store_code, h.product_code,
    avg(qty) FILTER (WHERE sale_ts >= as_of - INTERVAL 30 DAY) AS rm,
    stddev_samp(qty) FILTER (WHERE sale_ts >= as_of - INTERVAL 30 DAY) AS rs,
    count(*) FILTER (WHERE sale_ts >= as_of - INTERVAL 30 DAY) AS rn, avg(qty) AS am, stddev_samp(qty) AS sa,
    avg(qty) FILTER (WHERE {_PROMO}) AS pm, avg(qty) FILTER (WHERE NOT ({_PROMO})) AS nm,
    sum(qty) FILTER (WHERE sale_ts >= as_of - INTERVAL 7 DAY AND sale_ts < as_of) AS w,
    sum(qty) FILTER (WHERE sale_ts >= as_of - INTERVAL 14 DAY AND sale_ts < as_of - INTERVAL 7 DAY) AS pw
  FROM (SELECT er.*, ao.as_of FROM er JOIN ao ON ao.store_code = er.store_code AND ao.product_code = er.product_code) h
  GROUP BY ALL),
hist AS (SELECT store_code, product_code, CASE WHEN rn > 0 THEN rm ELSE am END AS hist_avg_sales,
                CASE WHEN rn > 0 THEN rs ELSE sa END AS hist_sales_std,
                coalesce(pm / greatest(nm, 0.1), 1.2) AS hist_promo_sales_ratio,
                coalesce((w - pw) / greatest(pw, 1.0), 0.0) AS sales_trend FROM hg),
plans AS (
  SELECT pg.store_code || '-' || pg.product_code AS plan_id, pg.store_code, pg.product_code, initial_stock, base_price,
         least(greatest(m * 0.3, m * 0.1), m * 0.9) AS cost_price, coalesce(rate.sales_rate, 5.0) AS sales_rate,
         total_transactions, recent_transaction_days, hist_avg_sales, hist_sales_std, hist_promo_sales_ratio, sales_trend,
         coalesce(el4.price_elasticity, 1.2) AS price_elasticity,
         CAST(coalesce(starts_with(category_code, '20'), false) AS INT) AS is_fresh,
         CASE WHEN coalesce(starts_with(category_code, '20'), false) THEN 24 ELSE 168 END AS shelf_life_hours,
         {dbl(0.4)} AS min_discount, {dbl(0.9)} AS max_discount, 4 AS time_segments, {dbl(0.1)} AS min_gross_margin,
         lastp.temperature, lastp.is_rainy, lastp.is_holiday, lastp.is_weekend, lastp.is_shopping_day
  FROM pg JOIN lastp USING (store_code, product_code) LEFT JOIN rate USING (store_code, product_code)
  LEFT JOIN hist USING (store_code, product_code) LEFT JOIN el4 USING (store_code, product_code))"""]

REQ_SPEC = ("plan_id:s initial_stock:l base_price:f cost_price:f sales_rate:f total_transactions:l "
            "recent_transaction_days:l hist_avg_sales:f hist_sales_std:f hist_promo_sales_ratio:f sales_trend:f "
            "price_elasticity:f is_fresh:i shelf_life_hours:i temperature:f is_rainy:i is_holiday:i is_weekend:i "
            "is_shopping_day:i")


@register("plan_requests", "D13 D14 A31 A37 A28", sql=with_(*PLANS_SQL) + f"SELECT {out_sql(REQ_SPEC)} FROM plans")
def q_plan_requests(spark, d):
    return plan_requests(spark, d).select(*out_cols(REQ_SPEC))


# ---- D1 / D2 / D3 / D4 / P31 -------------------------------------------------------

SEG_SPEC = ("plan_id:s t:i start_time:s end_time:s time_remaining:f discount:f price:f min_price:f units:f "
            "stock_ratio:f price_elasticity_effect:f urgency_factor:f is_high_discount:i is_low_discount:i "
            "discount_time_interaction:f discount_stock_interaction:f time_stock_interaction:f")


@register("segment_ladder_grid", "D1 D2 D3 D4 P31", sql=with_(*PLANS_SQL) + f"""
, seg AS (SELECT plans.*, CAST(unnest(range(0, 4)) AS INT) AS t FROM plans),
lv AS (SELECT seg.*, min_discount + CAST(i AS INT) * ((max_discount - min_discount) / 4) AS discount
       FROM seg, (SELECT unnest(range(0, 5)) AS i) ii)
SELECT {out_sql(SEG_SPEC)} FROM (
  SELECT plan_id, t, strftime(TIMESTAMP '2000-01-01 20:00:00' + INTERVAL (t * 30) MINUTE, '%H:%M') AS start_time,
         strftime(TIMESTAMP '2000-01-01 20:00:00' + INTERVAL (t * 30 + 30) MINUTE, '%H:%M') AS end_time,
         1.0 - (t * 30) / 120 AS time_remaining, discount, base_price * discount AS price,
         cost_price / (1.0 - min_gross_margin) AS min_price,
         CASE WHEN base_price * discount > 0 THEN greatest(0.0, sales_rate * (base_price / (base_price * discount)) * 0.5) ELSE 0.0 END AS units,
         initial_stock / 100.0 AS stock_ratio, pow(1.0 / discount, price_elasticity) AS price_elasticity_effect,
         1.0 / ((1.0 - (t * 30) / 120) + 0.1) AS urgency_factor, CAST(discount < 0.7 AS INT) AS is_high_discount,
         CAST(discount > 0.9 AS INT) AS is_low_discount, discount * (1.0 - (t * 30) / 120) AS discount_time_interaction,
         discount * initial_stock AS discount_stock_interaction, (1.0 - (t * 30) / 120) * initial_stock AS time_stock_interaction
  FROM lv)
""")
def q_segment_ladder_grid(spark, d):
    plans = plan_requests(spark, d)
    g = PR.segment_frame(plans).select("*", F.explode(PR.ladder_linspace()).alias("discount"))
    g = g.withColumn("price", F.col("base_price") * F.col("discount")) \
         .withColumn("min_price", PR.min_price_from_margin(F.col("cost_price"), F.col("min_gross_margin"))) \
         .withColumn("units", PR.stage_units(F.col("sales_rate"), F.col("price"), F.col("base_price"),
                                             F.col("seg_minutes") / 60.0)) \
         .withColumn("stock", F.col("initial_stock"))
    return PR.scenario_features(g).select(*out_cols(SEG_SPEC))


# ---- D5 ---------------------------------------------------------------------------

LADDER_SQL = ", ".join(f"({dbl(x)})" for x in PR.STAGGER_LADDER)
SINGLE_SPEC = "plan_id:s time_slot:s discount:f price:f sold:l revenue:f profit:f"


@register("single_discount_plan", "D5 D3 D4", sql=with_(*PLANS_SQL) + f"""
, c AS (SELECT plan_id, base_price, cost_price, initial_stock, sales_rate, d AS discount, base_price * d AS price,
               CAST(least(floor(least(sales_rate / 60 * 120 / (d * d), initial_stock)), initial_stock) AS BIGINT) AS sold
        FROM plans, (VALUES {LADDER_SQL}) l(d)
        WHERE base_price * d > 0 AND (base_price * d - cost_price) / (base_price * d) >= min_gross_margin),
b AS (SELECT plan_id, arg_max(discount, (sold * (price - cost_price), discount)) AS discount
      FROM c WHERE sold * (price - cost_price) > 0 GROUP BY plan_id),
o AS (SELECT p.plan_id, p.cost_price, coalesce(b.discount, 1.0) AS discount, p.base_price, p.sales_rate, p.initial_stock
      FROM plans p LEFT JOIN b USING (plan_id))
SELECT {out_sql(SINGLE_SPEC)} FROM (
  SELECT plan_id, '20:00-22:00' AS time_slot, discount, base_price * discount AS price,
         CAST(least(floor(least(sales_rate / 60 * 120 / (discount * discount), initial_stock)), initial_stock) AS BIGINT) AS sold,
         least(floor(least(sales_rate / 60 * 120 / (discount * discount), initial_stock)), initial_stock) * (base_price * discount) AS revenue,
         least(floor(least(sales_rate / 60 * 120 / (discount * discount), initial_stock)), initial_stock) * (base_price * discount - cost_price) AS profit
  FROM o)
""")
def q_single_discount_plan(spark, d):
    return PR.best_single_discount(plan_requests(spark, d)).select(*out_cols(SINGLE_SPEC))


LEFTOVER_SPEC = "plan_id:s discount:f price:f sold:l leftover:l leftover_cost:f revenue:f profit:f"


def _leftover_sql(parts: int = 8) -> str:
    """Every whole percent of every plan, sold part by part."""
    ctes = ["lf0 AS (SELECT plans.*, u.pct / CAST(100 AS DOUBLE) AS d, initial_stock AS k0 FROM plans, (SELECT unnest(range(0, 101)) AS pct) u "
            "WHERE u.pct >= ceil(min_discount * 100 - 1e-9))"]
    for t in range(parts):
        demand = _demand_sql("d", f"(1.0 - {t} / {parts})", f"k{t}")
        ctes.append(f"lf{t + 1} AS (SELECT *, k{t} - CAST(least(floor({demand} / {parts}), k{t}) AS BIGINT) AS k{t + 1} FROM lf{t})")
    return ",\n".join(ctes) + f""",
lfp AS (SELECT plan_id, d AS discount, base_price * d AS price, initial_stock - k{parts} AS sold, k{parts} AS leftover,
               k{parts} * cost_price * {dbl(0.3)} AS leftover_cost,
               (base_price * d - cost_price) * (initial_stock - k{parts}) - k{parts} * cost_price * {dbl(0.3)} AS profit FROM lf{parts})"""


def q_leftover_discount_plan(spark, d):
    return PR.best_discount_with_leftover(plan_requests(spark, d)).select(*out_cols(LEFTOVER_SPEC))


# ---- D7 (brute force oracle) ----------------------------------------------------------

def _stagger_paths_sql(slots: int = 4) -> str:
    """Every discount path of the staggered plan, evaluated step by step."""
    ctes = [f"""lad AS (
  SELECT p.plan_id, l.d, p.sales_rate / 60 * (120 / {slots}) / (l.d * l.d) AS units
  FROM plans p, (VALUES {LADDER_SQL}) l(d)
  WHERE (p.base_price * l.d > 0 AND (p.base_price * l.d - p.cost_price) / (p.base_price * l.d) >= p.min_gross_margin)
     OR (l.d = 1.0 AND NOT EXISTS (SELECT 1 FROM (VALUES {LADDER_SQL}) l2(d)
          WHERE p.base_price * l2.d > 0 AND (p.base_price * l2.d - p.cost_price) / (p.base_price * l2.d) >= p.min_gross_margin)))""",
            """sg0 AS (
  SELECT p.plan_id, p.base_price, p.cost_price, l.d AS d0,
         CAST(least(floor(l.units), p.initial_stock) AS BIGINT) AS x0,
         p.initial_stock - CAST(least(floor(l.units), p.initial_stock) AS BIGINT) AS k0,
         0.0 + CAST(least(floor(l.units), p.initial_stock) AS BIGINT) * (p.base_price * l.d - p.cost_price) AS pr0
  FROM plans p JOIN lad l ON l.plan_id = p.plan_id)"""]
    for t in range(1, slots):
        x = f"CAST(least(floor(l.units), s.k{t - 1}) AS BIGINT)"
        ctes.append(f"""sg{t} AS (
  SELECT s.*, l.d AS d{t}, {x} AS x{t}, s.k{t - 1} - {x} AS k{t},
         s.pr{t - 1} + ({x} * (s.base_price * l.d - s.cost_price)
                        - {dbl(PR.PERCEPTION_WEIGHT)} * abs(l.d - s.d{t - 1}) * {x} * s.base_price) AS pr{t}
  FROM sg{t - 1} s JOIN lad l ON l.plan_id = s.plan_id)""")
    last = slots - 1
    order = ", ".join(f"d{t} DESC, x{t} DESC" for t in range(slots))
    ctes.append(f"""best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY pr{last} DESC, {order}) AS rk FROM sg{last})
  WHERE rk = 1)""")
    union = " UNION ALL ".join(f"SELECT plan_id, base_price, cost_price, {t} AS t, d{t} AS discount, x{t} AS sold, "
                               f"pr{last} AS total_profit FROM best" for t in range(slots))
    ctes.append(f"stag AS MATERIALIZED ({union})")
    return ",\n".join(ctes)


STAG_SPEC = ("plan_id:s t:i time_slot:s discount:f discount_percentage:f sold:l price:f revenue:f profit:f "
             "total_profit:f")


@register("staggered_discount_plan", "D7 D3 D4 D2", sql=with_(*PLANS_SQL, _stagger_paths_sql()) + f"""
SELECT {out_sql(STAG_SPEC)} FROM (
  SELECT plan_id, t, strftime(TIMESTAMP '2000-01-01 20:00:00' + INTERVAL (t * 30) MINUTE, '%H:%M') || '-' ||
         strftime(TIMESTAMP '2000-01-01 20:00:00' + INTERVAL (t * 30 + 30) MINUTE, '%H:%M') AS time_slot,
         discount, round((1 - discount) * 100, 1) AS discount_percentage, sold, base_price * discount AS price,
         base_price * discount * sold AS revenue, (base_price * discount - cost_price) * sold AS profit, total_profit
  FROM stag)
""")
def q_staggered_discount_plan(spark, d):
    return PR.staggered_plan(plan_requests(spark, d)).select(*out_cols(STAG_SPEC))


# ---- D6 (brute force oracle) ----------------------------------------------------------

def _demand_sql(d: str, tau: str, stock: str) -> str:
    """M16 heuristic as SQL text, same operation order as the Spark expression."""
    base = "coalesce(hist_avg_sales, 10.0)"
    pf = f"pow(1.0 / {d}, coalesce(price_elasticity, 1.2))"
    tf = f"exp(3 * (1.0 - {tau}))"
    sr = f"({stock} / greatest(coalesce(hist_avg_sales, 10.0) * 3, 10.0))"
    sf = f"(1.0 + 2.0 / (1.0 + exp(-5 * ({sr} - 0.5))))"
    prf = f"(1.0 + (coalesce(hist_promo_sales_ratio, 1.2) - 1.0) * (1.0 - {tau}))"
    prod = (f"((CASE WHEN is_fresh = 1 THEN 1.0 + (1.0 - {tau}) * 2.0 ELSE 1.0 END) * "
            f"(CASE WHEN shelf_life_hours < 24 THEN 1.5 ELSE 1.0 END))")
    tr = "(1.0 + coalesce(sales_trend, 0.0))"
    one = dbl(1.0)
    wf = (f"((CASE WHEN temperature > 30 THEN {dbl(0.9)} WHEN temperature BETWEEN 20 AND 25 THEN {dbl(1.1)} ELSE {one} END) * "
          f"(CASE WHEN is_rainy = 1 THEN CASE WHEN is_fresh = 1 THEN {dbl(0.8)} ELSE {dbl(1.2)} END ELSE {one} END))")
    cf = (f"((CASE WHEN is_holiday = 1 THEN {dbl(1.3)} ELSE {one} END) * (CASE WHEN is_weekend = 1 THEN {dbl(1.2)} ELSE {one} END)"
          f" * (CASE WHEN is_shopping_day = 1 THEN {dbl(1.5)} ELSE {one} END))")
    dem = f"{base} * {pf} * {tf} * {sf} * {prf} * {wf} * {cf} * {prod} * {tr}"
    return f"greatest({dbl(0.1)}, least({dem}, {stock} * {dbl(0.8)}))"


def _staged_paths_sql(segs: int = 4, levels: int = 5, px: str = "sd") -> str:
    """Every discount path of the staged plan (segments of 120 // segs minutes); final CTE ``{px}staged``."""
    seg = 120 // segs
    n = 120 // seg + (1 if 120 % seg else 0)
    ctes = [f"""{px}lv AS (SELECT p.*, min_discount + CAST(i AS INT) * ((max_discount - min_discount) / {levels - 1}) AS lvl
            FROM plans p, (SELECT unnest(range(0, {levels})) AS i) ii)"""]
    for t in range(n):
        tau = f"(1.0 - ({t} * {seg}) / 120)"
        stock = "p.initial_stock" if t == 0 else f"s.k{t - 1}"
        src = f"{px}lv p" if t == 0 else f"{px}{t - 1} s JOIN {px}lv p ON p.plan_id = s.plan_id"
        x = f"CAST(least(floor({_demand_sql('p.lvl', tau, stock)}), {stock}) AS BIGINT)"
        keep = "p.plan_id, p.base_price, p.cost_price" if t == 0 else "s.*"
        prof = f"{x} * (p.base_price * p.lvl - p.cost_price)"
        acc = f"0.0 + {prof}" if t == 0 else f"s.pr{t - 1} + {prof}"
        ctes.append(f"""{px}{t} AS (SELECT {keep}, p.lvl AS d{t}, {x} AS x{t}, {stock} - {x} AS k{t}, {acc} AS pr{t} FROM {src})""")
    last = n - 1
    order = ", ".join(f"d{t} DESC, x{t} DESC" for t in range(n))
    ctes.append(f"""{px}best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY pr{last} DESC, {order}) AS rk FROM {px}{last})
  WHERE rk = 1)""")
    union = " UNION ALL ".join(f"SELECT plan_id, base_price, cost_price, {t} AS t, d{t} AS discount, x{t} AS sold, "
                               f"pr{last} AS total_profit FROM {px}best" for t in range(n))
    ctes.append(f"{px}staged AS ({union})")
    return ",\n".join(ctes)


register("leftover_discount_plan", "D5 M16", sql=with_(*PLANS_SQL, _leftover_sql()) + f"""
SELECT {out_sql(LEFTOVER_SPEC)} FROM (
  SELECT *, price * sold AS revenue, row_number() OVER (PARTITION BY plan_id ORDER BY profit DESC, discount DESC) AS rk FROM lfp) WHERE rk = 1
""")(q_leftover_discount_plan)


STAGED_SPEC = "plan_id:s t:i start_time:s end_time:s discount:f sold:l price:f revenue:f profit:f total_profit:f"


@register("staged_pricing_plan", "D6 D1 D2 M16", sql=with_(*PLANS_SQL, _staged_paths_sql()) + f"""
SELECT {out_sql(STAGED_SPEC)} FROM (
  SELECT plan_id, t, strftime(TIMESTAMP '2000-01-01 20:00:00' + INTERVAL (t * 30) MINUTE, '%H:%M') AS start_time,
         strftime(TIMESTAMP '2000-01-01 20:00:00' + INTERVAL (t * 30 + 30) MINUTE, '%H:%M') AS end_time,
         discount, sold, base_price * discount AS price, base_price * discount * sold AS revenue,
         (base_price * discount - cost_price) * sold AS profit, total_profit
  FROM sdstaged)
""")
def q_staged_pricing_plan(spark, d):
    return PR.staged_plan(plan_requests(spark, d)).select(*out_cols(STAGED_SPEC))


# ---- D8 ------------------------------------------------------------------------------

GREEDY_CANDS = (0.1, 0.2, 0.3, 0.4, 0.5)
GREEDY_SPEC = "plan_id:s stage:i discount:f price:f expected_sales:f"


def greedy_inputs(spark, d):
    """Plans + per-stage base rates (A32 on the product) + D3 price floor."""
    plans = plan_requests(spark, d)
    from ..sources.starschema import hourly_transactions
    rates = PT.stage_baseline(hourly_transactions(spark, d), ["store_code", "product_code"])
    arr = rates.groupBy("store_code", "product_code").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("stage", "base_rate"))), lambda x: x["base_rate"]).alias("base_rates"))
    return (plans.join(arr, ["store_code", "product_code"], "left")
                 .withColumn("min_price", PR.min_price_from_margin(F.col("cost_price"), F.col("min_gross_margin")))
                 .withColumn("stage_hours", F.lit(0.5)))


def _greedy_sql():
    e = lambda k, j: f"e{k}[{j}]"
    n = len(GREEDY_CANDS)
    cands = ", ".join(dbl(c) for c in GREEDY_CANDS)
    parts = [f"""sh(stage, hour, n_hours) AS (VALUES (0, 20, 1), (1, 20, 2), (1, 21, 2), (2, 21, 1), (3, 21, 2), (3, 22, 2)),
span AS (SELECT date_diff('day', min(sale_date), max(sale_date)) + 1 AS days FROM hx),
gq AS (SELECT store_code, product_code, stage, sum(qty) AS q FROM hx JOIN sh ON sh.hour = hour(hx.sale_ts) GROUP BY ALL),
nh AS (SELECT DISTINCT stage, n_hours FROM sh),
sp AS (SELECT p.store_code, p.product_code, s.stage FROM (SELECT DISTINCT store_code, product_code FROM hx) p,
       (SELECT DISTINCT stage FROM sh) s),
br AS (SELECT sp.store_code, sp.product_code, sp.stage,
              CASE WHEN coalesce(gq.q, 0.0) / span.days / nh.n_hours > 0 THEN coalesce(gq.q, 0.0) / span.days / nh.n_hours
                   ELSE 0.5 END AS base_rate
       FROM sp LEFT JOIN gq ON gq.store_code = sp.store_code AND gq.product_code = sp.product_code AND gq.stage = sp.stage
       JOIN nh ON nh.stage = sp.stage, span),
gp AS (SELECT p.plan_id, CAST(p.initial_stock AS DOUBLE) AS stock, p.base_price AS p0, p.cost_price / (1.0 - p.min_gross_margin) AS minp,
              b.stage, b.base_rate FROM plans p JOIN br b ON b.store_code = p.store_code AND b.product_code = p.product_code),
ge AS (SELECT plan_id, stock, p0, minp, stage,
              list_transform([{cands}], lambda c: CASE WHEN greatest(p0 * (1 - c), minp) > 0
                   THEN greatest(0.0, base_rate * (p0 / greatest(p0 * (1 - c), minp)) * 0.5) ELSE 0.0 END) AS e
       FROM gp),
g0 AS (SELECT plan_id, stock, p0, minp, {", ".join(f"max(e) FILTER (WHERE stage = {k}) AS e{k}" for k in range(4))}
       FROM ge GROUP BY ALL),
gs4 AS (SELECT *, 0.0 + {" + ".join(e(k, 1) for k in range(4))} AS cum, 1 AS c0, 1 AS c1, 1 AS c2, 1 AS c3 FROM g0)"""]
    prev = "gs4"
    for k in (3, 2, 1, 0):
        pos = (f"coalesce(list_position(list_transform(range(2, {n + 1}), lambda j: cum - {e(k, 1)} + e{k}[j] >= stock), true), 0)")
        j = f"CASE WHEN {pos} > 0 THEN {pos} + 1 ELSE {n} END"
        parts.append(f"""gs{k} AS (SELECT * REPLACE (
    CASE WHEN cum >= stock THEN cum ELSE cum - {e(k, 1)} + e{k}[{j}] END AS cum,
    CASE WHEN cum >= stock THEN c{k} ELSE {j} END AS c{k}) FROM {prev})""")
        prev = f"gs{k}"
    union = " UNION ALL ".join(
        f"SELECT plan_id, {k} AS stage, [{cands}][c{k}] AS discount, greatest(p0 * (1 - [{cands}][c{k}]), minp) AS price, "
        f"e{k}[c{k}] AS expected_sales FROM gs0" for k in range(4))
    parts.append(f"greedy AS ({union})")
    return ",\n".join(parts)


@register("greedy_clearing_plan", "D8 D3 D4 A32", sql=with_(*PLANS_SQL, _greedy_sql()) + f"SELECT {out_sql(GREEDY_SPEC)} FROM greedy")
def q_greedy_clearing_plan(spark, d):
    return PR.greedy_clearing(greedy_inputs(spark, d), stages=4, candidates=GREEDY_CANDS).select(*out_cols(GREEDY_SPEC))


# ---- D9 ------------------------------------------------------------------------------

RULE_SPEC = "plan_id:s hour:i remaining:l discount:f2"


@register("rule_discount_grid", "D9", sql=with_(*PLANS_SQL) + f"""
SELECT {out_sql(RULE_SPEC)} FROM (
  SELECT plan_id, h AS hour, r AS remaining,
         greatest(greatest(0.95 - 1.2 * (1 - sqrt((24 - h) / 24.0)) - 0.8 * (r / initial_stock), cost_price / base_price), 0.5) AS discount
  FROM plans, (SELECT unnest(range(18, 24)) AS h) hh,
       (SELECT 1 AS part) x, LATERAL (SELECT unnest([initial_stock, CAST(ceil(initial_stock / 2) AS BIGINT)]) AS r) rr)
""")
def q_rule_discount_grid(spark, d):
    p = plan_requests(spark, d)
    g = p.select("plan_id", "initial_stock", "base_price", "cost_price",
                 F.explode(F.sequence(F.lit(18), F.lit(23))).alias("hour"))
    g = g.select("*", F.explode(F.array(F.col("initial_stock"), F.ceil(F.col("initial_stock") / 2).cast("long"))).alias("remaining"))
    g = g.withColumn("discount", PR.rule_discount(F.col("hour"), F.col("initial_stock"), F.col("remaining"),
                                                  F.col("base_price"), F.col("cost_price")))
    raw = F.col("discount")                 # rounding keeps to finite numbers
    odd = F.isnan(raw) | (F.abs(raw) == float("inf"))
    *rest, rounded = out_cols(RULE_SPEC)
    return g.select(*rest, F.when(odd, raw).otherwise(rounded).alias("discount"))


# ---- D10 / D12 / D16 -------------------------------------------------------------------

MET_SPEC = ("plan_id:s total_expected_sales:l total_expected_revenue:f total_expected_profit:f clearance_rate:f "
            "avg_discount:f avg_gross_margin:f remaining_inventory:l can_clear_inventory:i meets_margin_requirement:i "
            "reasonable_pricing_strategy:i customer_acceptance_likely:i recommendation:s")

METRICS_SQL = f"""sr AS (SELECT plan_id, t, discount, round((1 - discount) * 100, 1) AS discount_percentage, sold,
                 base_price * discount * sold AS revenue, (base_price * discount - cost_price) * sold AS profit FROM stag),
sc AS (SELECT *, abs(discount_percentage - lag(discount_percentage) OVER (PARTITION BY plan_id ORDER BY t)) AS chg FROM sr),
sm AS (SELECT plan_id, sum(sold) AS tes, sum(revenue) AS ter, sum(profit) AS tep,
              sum(sold * (1 - discount_percentage / 100)) AS w, max(chg) AS max_change, count(*) AS nseg FROM sc GROUP BY ALL),
met AS (
  SELECT sm.plan_id, tes AS total_expected_sales, ter AS total_expected_revenue, tep AS total_expected_profit,
         CASE WHEN p.initial_stock > 0 THEN tes / p.initial_stock ELSE 0.0 END AS clearance_rate,
         round((1 - CASE WHEN tes > 0 THEN w / tes ELSE 0.0 END) * 100, 2) AS avg_discount,
         CASE WHEN ter > 0 THEN tep / ter ELSE 0.0 END AS avg_gross_margin,
         greatest(0, p.initial_stock - tes) AS remaining_inventory,
         CASE WHEN nseg > 1 THEN coalesce(max_change <= 20.0, true) ELSE true END AS reasonable, p.min_gross_margin
  FROM sm JOIN plans p ON p.plan_id = sm.plan_id),
metf AS (
  SELECT *, CAST(clearance_rate >= 0.95 AS INT) AS can_clear_inventory,
         CAST(avg_gross_margin >= min_gross_margin AS INT) AS meets_margin_requirement,
         CAST(reasonable AS INT) AS reasonable_pricing_strategy, CAST(avg_discount <= 50 AS INT) AS customer_acceptance_likely,
         CASE WHEN NOT clearance_rate >= 0.95 THEN 'increase_discount_or_extend_window'
              WHEN NOT avg_gross_margin >= min_gross_margin THEN 'margin_not_met'
              WHEN NOT reasonable THEN 'smooth_discount_steps' ELSE 'feasible' END AS recommendation FROM met)"""


def staggered_metrics(spark, d):
    plans = plan_requests(spark, d)
    return PR.plan_metrics(PR.staggered_plan(plans), plans), plans


@register("plan_metrics_feasibility", "D10 D12", sql=with_(*PLANS_SQL, _stagger_paths_sql(), METRICS_SQL) +
          f"SELECT {out_sql(MET_SPEC)} FROM metf")
def q_plan_metrics_feasibility(spark, d):
    m, _ = staggered_metrics(spark, d)
    return m.select(*out_cols(MET_SPEC))


BATCH_SPEC = "total_products:l successful:l success_rate:f total_expected_profit:f avg_clearance_rate:f"


@register("batch_plan_report", "D16", sql=with_(*PLANS_SQL, _stagger_paths_sql(), METRICS_SQL) + f"""
SELECT {out_sql(BATCH_SPEC)} FROM (
  SELECT count(*) AS total_products, count(m.total_expected_sales) AS successful,
         count(m.total_expected_sales) / count(*) AS success_rate,
         coalesce(sum(m.total_expected_profit), 0.0) AS total_expected_profit, avg(m.clearance_rate) AS avg_clearance_rate
  FROM plans p LEFT JOIN metf m ON m.plan_id = p.plan_id)
""")
def q_batch_plan_report(spark, d):
    m, plans = staggered_metrics(spark, d)
    return PR.batch_report(m, plans).select(*out_cols(BATCH_SPEC))


# ---- D11 / D15 / D18 ---------------------------------------------------------------------

EVAL_SPEC = ("plan_id:s total_expected_sales:l total_revenue:f total_profit:f remaining_stock:l sell_out_probability:f "
             "profit_margin:f average_discount:f stock_clearance_rate:f recommendation:s confidence:f "
             "sellout_advice:s confidence_advice:s")


def _eval_sql(src: str = "sdstaged", name: str = "ev") -> str:
    return f"""{name}0 AS (SELECT plan_id, sum(sold) AS tes, sum(base_price * discount * sold) AS tr,
                  sum((base_price * discount - cost_price) * sold) AS tp, avg(discount) AS average_discount
           FROM {src} GROUP BY plan_id),
{name} AS (
  SELECT e.plan_id, tes AS total_expected_sales, tr AS total_revenue, tp AS total_profit,
         greatest(0, p.initial_stock - tes) AS remaining_stock,
         CASE WHEN p.initial_stock > 0 THEN least(1.0, tes / p.initial_stock) ELSE 0.0 END AS sell_out_probability,
         CASE WHEN tr > 0 THEN tp / tr ELSE 0.0 END AS profit_margin, average_discount,
         CASE WHEN p.initial_stock > 0 THEN tes / p.initial_stock ELSE 0.0 END AS stock_clearance_rate,
         p.total_transactions, p.recent_transaction_days, p.hist_avg_sales, p.hist_sales_std, p.price_elasticity
  FROM {name}0 e JOIN plans p ON p.plan_id = e.plan_id)"""


@register("schedule_evaluation_confidence", "D11 D15 D18 D14", sql=with_(*PLANS_SQL, _staged_paths_sql(), _eval_sql()) + f"""
, c AS (
  SELECT *, CASE WHEN sell_out_probability < 0.7 THEN CASE WHEN profit_margin < 0.1 THEN 'high_risk' ELSE 'sell_out_risk' END
                 WHEN sell_out_probability < 0.9 THEN CASE WHEN profit_margin > 0.2 THEN 'good_balance' ELSE 'acceptable' END
                 ELSE CASE WHEN profit_margin > 0.15 THEN 'excellent' ELSE 'conservative' END END AS recommendation,
         least(greatest(least(total_transactions / 200, recent_transaction_days / 30, 1.0) * 0.25
              + (CAST(hist_avg_sales IS NOT NULL AS INT) + CAST(hist_sales_std IS NOT NULL AS INT)
                 + CAST(price_elasticity IS NOT NULL AS INT)) / 3 * 0.25
              + 0.5 * 0.30 + greatest(1.0 - abs(sell_out_probability - 0.8) * 2, 0.0) * 0.20, 0.1), 0.95) AS confidence
  FROM ev)
SELECT {out_sql(EVAL_SPEC)} FROM (
  SELECT *, CASE WHEN sell_out_probability > 0.9 THEN 'raise_price_or_stock' WHEN sell_out_probability > 0.7
                 THEN 'keep_pricing' ELSE 'deepen_discount' END AS sellout_advice,
            CASE WHEN confidence > 0.8 THEN 'execute' WHEN confidence > 0.6 THEN 'execute_and_monitor'
                 ELSE 'execute_with_fallback' END AS confidence_advice FROM c)
""")
def q_schedule_evaluation_confidence(spark, d):
    plans = plan_requests(spark, d)
    ev = PR.schedule_evaluation(PR.staged_plan(plans), plans)
    ev = ev.join(plans.select("plan_id", "total_transactions", "recent_transaction_days", "hist_avg_sales",
                              "hist_sales_std", "price_elasticity"), "plan_id")
    return PR.strategy_advice(PR.confidence_score(ev)).select(*out_cols(EVAL_SPEC))


# ---- D17 --------------------------------------------------------------------------------

ALT_SPEC = "plan_id:s time_segments:i total_profit:f sell_out_probability:f rank:i"


def alternatives(spark, d, options=(4, 6, 2)):
    """The staged plan with 4 / 6 / 2 segments for every request, compared by profit."""
    plans = plan_requests(spark, d)
    alt = (plans.drop("time_segments").select("*", F.explode(F.array(*[F.lit(n) for n in options])).alias("time_segments"))
                .withColumnRenamed("plan_id", "base_plan_id")
                .withColumn("plan_id", F.concat_ws("#", "base_plan_id", F.col("time_segments").cast("string"))))
    ev = PR.schedule_evaluation(PR.staged_plan(alt.drop("base_plan_id")), alt)
    ev = ev.join(alt.select("plan_id", "base_plan_id", "time_segments"), "plan_id")
    from pyspark.sql import Window
    # profits equal up to float noise of the summation order tie -> fewer segments first
    from ..functions.expr import rnd
    w = Window.partitionBy("base_plan_id").orderBy(F.desc(rnd("total_profit", 6)), F.asc("time_segments"))
    return ev.select(F.col("base_plan_id").alias("plan_id"), "time_segments", "total_profit", "sell_out_probability",
                     F.row_number().over(w).alias("rank"))


@register("alternative_strategies", "D17 D6 D11", sql=with_(
        *PLANS_SQL, _staged_paths_sql(4, px="a4"), _staged_paths_sql(6, px="a6"), _staged_paths_sql(2, px="a2"),
        _eval_sql("a4staged", "e4"), _eval_sql("a6staged", "e6"), _eval_sql("a2staged", "e2")) + f"""
, u AS (SELECT plan_id, 4 AS time_segments, total_profit, sell_out_probability FROM e4
        UNION ALL SELECT plan_id, 6, total_profit, sell_out_probability FROM e6
        UNION ALL SELECT plan_id, 2, total_profit, sell_out_probability FROM e2)
SELECT {out_sql(ALT_SPEC)} FROM (
  SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY floor(total_profit * 1000000 + 0.500001) / 1000000 DESC,
                                time_segments) AS rank FROM u)
""")
def q_alternative_strategies(spark, d):
    return alternatives(spark, d).select(*out_cols(ALT_SPEC))
