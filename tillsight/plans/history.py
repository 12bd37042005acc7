"""As-of history, price/store features, baselines, product master, cold start,
future regressors and prediction input (A28-A32, A37-A41, F13, J5, J6, W16, P35, U1, M14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import patterns as PT
from ..operators import scenario as SC
from ..operators.clean import base_fields
from ..schema import NO_DISCOUNT
from ..sources.starschema import hourly_transactions, transactions
from .features import SLOT_AGG_SQL, hourly_slots
from .patterns import ENRICHED_SQL, KEYS, KS, elasticity_sql, enriched_hourly
from .registry import register
from .sales import DAILY_SQL, daily_product_sales
from .sqlparts import hx_cte, out_cols, out_sql, tx_cte, with_

ASOF_SPEC = KS + ("as_of:t hist_avg_sales:f hist_sales_std:f hist_promo_sales_ratio:f sales_trend:f "
                  "last_week_sales:f recent_3h_sales:f")
_PROMO = "hour(sale_ts) >= 20 AND hour(sale_ts) < 22"


@register("asof_history_features", "A28 F12 F13", sql=with_(*ENRICHED_SQL) + f"""
, ao AS (SELECT store_code, product_code, max(sale_ts) AS as_of FROM er GROUP BY ALL),
h AS (SELECT er.*, ao.as_of FROM er JOIN ao ON ao.store_code = er.store_code AND ao.product_code = er.product_code),
g AS (
  SELECT store_code, product_code, as_of,
    avg(qty) FILTER (WHERE sale_ts >= as_of - INTERVAL 30 DAY) AS rm,
    stddev_samp(qty) FILTER (WHERE sale_ts >= as_of - INTERVAL 30 DAY) AS rs,
    count(*) FILTER (WHERE sale_ts >= as_of - INTERVAL 30 DAY) AS rn, avg(qty) AS am, stddev_samp(qty) AS sa,
    avg(qty) FILTER (WHERE {_PROMO}) AS pm, avg(qty) FILTER (WHERE NOT ({_PROMO})) AS nm,
    sum(qty) FILTER (WHERE sale_ts >= as_of - INTERVAL 7 DAY AND sale_ts < as_of) AS w,
    sum(qty) FILTER (WHERE sale_ts >= as_of - INTERVAL 14 DAY AND sale_ts < as_of - INTERVAL 7 DAY) AS pw,
    coalesce(sum(qty) FILTER (WHERE sale_ts >= as_of - INTERVAL 8 DAY AND sale_ts < as_of - INTERVAL 7 DAY), 0.0) AS last_week_sales,
    coalesce(sum(qty) FILTER (WHERE sale_ts >= as_of - INTERVAL 3 HOUR), 0.0) AS recent_3h_sales
  FROM h GROUP BY ALL)
SELECT {out_sql(ASOF_SPEC)} FROM (
  SELECT store_code, product_code, as_of, CASE WHEN rn > 0 THEN rm ELSE am END AS hist_avg_sales,
         CASE WHEN rn > 0 THEN rs ELSE sa END AS hist_sales_std,
         coalesce(pm / greatest(nm, 0.1), 1.2) AS hist_promo_sales_ratio,
         coalesce((w - pw) / greatest(pw, 1.0), 0.0) AS sales_trend, last_week_sales, recent_3h_sales FROM g)
""")
def q_asof_history_features(spark, d):
    rows = enriched_hourly(spark, d)
    return PT.asof_history(rows, PT.latest_asof(rows, KEYS), KEYS).select(*out_cols(ASOF_SPEC))


PF_SPEC = KS + ("avg_price:f price_std:f min_price:f max_price:f median_price:f avg_discount:f discount_std:f "
                "min_discount:f max_discount:f discount_frequency:f price_elasticity:f")


@register("price_features", "A29 A22", sql=with_(*ENRICHED_SQL, elasticity_sql("er", bins=4, min_rows=20, name="el4")) + f"""
SELECT {out_sql(PF_SPEC)} FROM (
  SELECT g.*, coalesce(el4.price_elasticity, 1.2) AS price_elasticity FROM (
    SELECT store_code, product_code, avg(list_price) AS avg_price, stddev_samp(list_price) AS price_std,
           min(list_price) AS min_price, max(list_price) AS max_price, median(list_price) AS median_price,
           avg(discount_rate) AS avg_discount, stddev_samp(discount_rate) AS discount_std,
           min(discount_rate) AS min_discount, max(discount_rate) AS max_discount, avg(is_promo) AS discount_frequency
    FROM er GROUP BY ALL) g LEFT JOIN el4 USING (store_code, product_code))
""")
def q_price_features(spark, d):
    return PT.price_features(enriched_hourly(spark, d), KEYS).select(*out_cols(PF_SPEC))


SF_SPEC = KS + "store_sales_rank:f store_traffic_index:f store_conversion_rate:f store_avg_transaction:f"


@register("store_features", "A30", sql=with_(tx_cte()) + f"""
, g AS (SELECT store_code, product_code, sum(qty) AS q, count(*) AS n, avg(gross_amount) AS store_avg_transaction
        FROM tx GROUP BY ALL)
SELECT {out_sql(SF_SPEC)} FROM (
  SELECT store_code, product_code,
         (rank() OVER (PARTITION BY product_code ORDER BY q DESC) - 1) / count(*) OVER (PARTITION BY product_code) AS store_sales_rank,
         least(n / 100, 2.0) AS store_traffic_index, least(n / 500, 1.0) AS store_conversion_rate, store_avg_transaction
  FROM g)
""")
def q_store_features(spark, d):
    return PT.store_features(transactions(spark, d)).select(*out_cols(SF_SPEC))


SR_SPEC = KS + "avg_rate:f peak_rate:f low_rate:f confidence:f"


@register("sales_rate_profile", "A31 F12", sql=with_(hx_cte(), SLOT_AGG_SQL) + f"""
SELECT {out_sql(SR_SPEC)} FROM (
  SELECT store_code, product_code,
         coalesce(avg(qty) FILTER (WHERE slot - 1 >= 20 AND slot - 1 < 22), 5.0) AS avg_rate,
         coalesce(max(qty) FILTER (WHERE slot - 1 >= 20 AND slot - 1 < 22), 10.0) AS peak_rate,
         coalesce(min(qty) FILTER (WHERE slot - 1 >= 20 AND slot - 1 < 22), 2.0) AS low_rate,
         least(0.9, count(*) FILTER (WHERE slot - 1 >= 20 AND slot - 1 < 22) / 100) AS confidence
  FROM slots GROUP BY ALL)
""")
def q_sales_rate_profile(spark, d):
    s = hourly_slots(spark, d).withColumn("hour", F.col("slot") - 1)
    return PT.sales_rate_profile(s, KEYS).select(*out_cols(SR_SPEC))


SB_SPEC = "product_code:s stage:i base_rate:f"


def _stage_values(start="20:00", end="22:00", segs=4):
    s, e = int(start.split(":")[0]), int(end.split(":")[0])
    total = (e - s) if e > s else (24 - s + e)
    h = total / segs
    return ", ".join(f"({i}, {hr}, {int(s + (i + 1) * h) - int(s + i * h) + 1})"
                     for i in range(segs) for hr in range(int(s + i * h), int(s + (i + 1) * h) + 1))


@register("stage_baseline_rates", "A32", sql=with_(hx_cte()) + f"""
, sh(stage, hour, n_hours) AS (VALUES {_stage_values()}),
span AS (SELECT date_diff('day', min(sale_date), max(sale_date)) + 1 AS days FROM hx),
g AS (SELECT product_code, stage, sum(qty) AS q FROM hx JOIN sh ON sh.hour = hour(hx.sale_ts) GROUP BY ALL),
nh AS (SELECT DISTINCT stage, n_hours FROM sh),
sp AS (SELECT p.product_code, s.stage FROM (SELECT DISTINCT product_code FROM hx) p, (SELECT DISTINCT stage FROM sh) s)
SELECT {out_sql(SB_SPEC)} FROM (
  SELECT sp.product_code, sp.stage,
         CASE WHEN coalesce(g.q, 0.0) / span.days / nh.n_hours > 0 THEN coalesce(g.q, 0.0) / span.days / nh.n_hours
              ELSE 0.5 END AS base_rate
  FROM sp LEFT JOIN g ON g.product_code = sp.product_code AND g.stage = sp.stage JOIN nh ON nh.stage = sp.stage, span)
""")
def q_stage_baseline_rates(spark, d):
    return PT.stage_baseline(hourly_transactions(spark, d)).select(*out_cols(SB_SPEC))


TXR = f"""txr AS (SELECT *, CASE WHEN gross_amount > 0 THEN 1 - discount_amount / gross_amount END AS discount_rate FROM tx)"""


@register("cost_estimate", "A37 P4", sql=with_(tx_cte(), TXR) + f"""
SELECT product_code, {out_sql('cost_price:f')} FROM (
  SELECT product_code, least(greatest(m * 0.3, m * 0.1), m * 0.9) AS cost_price
  FROM (SELECT product_code, avg(list_price * discount_rate) AS m FROM txr GROUP BY product_code))
""")
def q_cost_estimate(spark, d):
    return PT.cost_estimate(base_fields(transactions(spark, d), with_slot=False)).select("product_code", *out_cols("cost_price:f"))


ANY_COST_SPEC = "product_code:s sale_date:d cost_price:f cost_method:s"
_SHARE_SQL = "CASE " + " ".join(f"WHEN starts_with(c, '{k}') THEN CAST({v} AS DOUBLE)" for k, v in PT.CATEGORY_COST_RATES.items()) + f" ELSE CAST({PT.OTHER_COST_RATE} AS DOUBLE) END"


@register("cost_estimate_by_day", "A37", sql=with_(hx_cte()) + f"""
, g AS (SELECT product_code, sale_date, avg(list_price * CASE WHEN gross_amount > 0 THEN 1 - discount_amount / gross_amount END) AS m,
               avg(list_price) AS p, max(CAST(discount_type <> '{NO_DISCOUNT}' AS INT)) AS promo, min(category_code) AS c FROM hx GROUP BY ALL)
SELECT {out_sql(ANY_COST_SPEC)} FROM (
  SELECT product_code, sale_date,
         CASE WHEN promo = 1 AND m IS NOT NULL THEN least(greatest(m * 0.3, m * 0.1), m * 0.9)
              WHEN c IS NOT NULL AND p IS NOT NULL THEN p * ({_SHARE_SQL}) ELSE 0.0 END AS cost_price,
         CASE WHEN promo = 1 AND m IS NOT NULL THEN 'discounted_price' WHEN c IS NOT NULL AND p IS NOT NULL THEN 'category_rate' ELSE 'none' END AS cost_method
  FROM g)
""")
def q_cost_estimate_by_day(spark, d):
    """Costs from one day's sales of a product: days without a discounted sale take the category's share."""
    return PT.cost_estimate_any(base_fields(hourly_transactions(spark, d)), ["product_code", "sale_date"]).select(*out_cols(ANY_COST_SPEC))


PM_SPEC = ("product_code:s base_price:f category_code:s product_name:s n_rows:l n_days:l avg_qty:f is_fresh:i "
           "shelf_life_hours:i cost_price:f price_elasticity:f")


@register("product_master", "A38 W14 A37 P29 P30", sql=with_(
    tx_cte(part=True), TXR, "txs AS (SELECT *, '*' AS store_code2 FROM txr)",
    elasticity_sql("(SELECT * EXCLUDE (store_code) REPLACE (product_code AS product_code), store_code2 AS store_code FROM txs)",
                   bins=4, min_rows=20, name="pel")) + f"""
, l AS (SELECT product_code, arg_max(list_price, (sale_date, order_id, line_no)) AS base_price,
               arg_max(category_code, (sale_date, order_id, line_no)) AS category_code,
               arg_max(product_name, (sale_date, order_id, line_no)) AS product_name, count(*) AS n_rows,
               count(DISTINCT sale_date) AS n_days, avg(qty) AS avg_qty,
               least(greatest(avg(list_price * discount_rate) * 0.3, avg(list_price * discount_rate) * 0.1),
                     avg(list_price * discount_rate) * 0.9) AS cost_price
        FROM txr GROUP BY product_code),
a AS (SELECT *, coalesce(product_name, '') AS nm FROM l),
b AS (SELECT *, ({' OR '.join(f"contains(nm, '{w}')" for w in __import__('tillsight.schema', fromlist=['x']).FRESH_KEYWORDS)}
                 OR coalesce(starts_with(category_code, '20'), false)) AS fresh,
              ({' OR '.join(f"contains(nm, '{w}')" for w in __import__('tillsight.schema', fromlist=['x']).DAIRY_KEYWORDS)}) AS dairy FROM a)
SELECT {out_sql(PM_SPEC)} FROM (
  SELECT b.product_code, base_price, category_code, product_name, n_rows, n_days, avg_qty, CAST(fresh AS INT) AS is_fresh,
         CASE WHEN fresh AND dairy THEN 48 WHEN fresh THEN 24 ELSE 168 END AS shelf_life_hours, cost_price,
         pel.price_elasticity
  FROM b LEFT JOIN pel ON pel.product_code = b.product_code)
""")
def q_product_master(spark, d):
    rows = base_fields(transactions(spark, d, part=True), with_slot=False)
    return PT.product_master(rows).select(*out_cols(PM_SPEC))


def product_profile(spark, d):
    """Per product: category, mean list price, mean daily quantity (inputs of A39/A40)."""
    tx = transactions(spark, d, part=True)
    return tx.groupBy("product_code").agg(
        F.min("category_code").alias("category_code"), F.avg("list_price").alias("avg_price"),
        (F.sum("qty") / F.count_distinct("sale_date")).alias("avg_daily_qty"))


PROFILE_SQL = """pp AS (SELECT product_code, min(category_code) AS category_code, avg(list_price) AS avg_price,
                  sum(qty) / count(DISTINCT sale_date) AS avg_daily_qty FROM tx GROUP BY product_code),
pos AS (SELECT *, row_number() OVER (PARTITION BY category_code ORDER BY avg_price, product_code) AS p FROM pp),
pairs AS (SELECT a.product_code, a.category_code, b.product_code AS other, abs(b.avg_price - a.avg_price) AS distance,
                 abs(b.p - a.p) AS pos
          FROM pos a JOIN pos b ON a.category_code = b.category_code AND a.product_code <> b.product_code),
sim AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_code ORDER BY distance, pos, other) AS rank
                       FROM pairs) WHERE rank <= 3)"""
SIM_SPEC = "product_code:s category_code:s other:s distance:f rank:i"


@register("similar_products", "A40", sql=with_(tx_cte(part=True), PROFILE_SQL) + f"SELECT {out_sql(SIM_SPEC)} FROM sim")
def q_similar_products(spark, d):
    return PT.similar_products(product_profile(spark, d)).select(*out_cols(SIM_SPEC))


CS_SPEC = "product_code:s category_code:s category_forecast:f adjustment:f forecast:f"


@register("cold_start_forecast", "A39 A40", sql=with_(tx_cte(part=True), PROFILE_SQL) + f"""
, cat AS (SELECT category_code, avg(avg_daily_qty) AS category_forecast FROM pp GROUP BY ALL),
adj AS (SELECT s.product_code, avg(o.avg_daily_qty / nullif(c.category_forecast, 0)) AS adjustment
        FROM sim s JOIN pp o ON o.product_code = s.other JOIN cat c ON c.category_code = s.category_code GROUP BY ALL)
SELECT {out_sql(CS_SPEC)} FROM (
  SELECT pp.product_code, pp.category_code, cat.category_forecast, adj.adjustment,
         cat.category_forecast * coalesce(adj.adjustment, 1.0) AS forecast
  FROM pp JOIN cat USING (category_code) LEFT JOIN adj USING (product_code))
""")
def q_cold_start_forecast(spark, d):
    prof = product_profile(spark, d)
    return PT.cold_start_forecast(prof, PT.similar_products(prof)).select(*out_cols(CS_SPEC))


FR_SPEC = "product_code:s ds:d list_price:f"


@register("future_regressors", "A41 M14 W15", sql=with_(tx_cte(), DAILY_SQL) + f"""
, d AS (SELECT *, row_number() OVER (PARTITION BY product_code ORDER BY sale_date DESC) AS rn FROM daily),
base AS (SELECT product_code, avg(list_price) FILTER (WHERE rn <= 7) AS recent_avg, count(*) AS n,
                max(sale_date) AS last FROM d GROUP BY ALL),
wd AS (SELECT product_code, isodow(sale_date) - 1 AS weekday, avg(list_price) AS wm FROM d GROUP BY ALL),
pat AS (SELECT product_code, stddev_samp(wm) AS ws, avg(wm) AS wa FROM wd GROUP BY ALL),
fut AS (SELECT b.product_code, recent_avg, (n >= 14 AND ws > wa * 0.3) AS use_wd,
               CAST(unnest(generate_series(CAST(last + 1 AS DATE), CAST(last + 7 AS DATE), INTERVAL 1 DAY)) AS DATE) AS ds
        FROM base b LEFT JOIN pat ON pat.product_code = b.product_code)
SELECT {out_sql(FR_SPEC)} FROM (
  SELECT fut.product_code, ds,
         coalesce(CASE WHEN use_wd THEN coalesce(wd.wm, recent_avg) ELSE recent_avg END, 0.0) AS list_price
  FROM fut LEFT JOIN wd ON wd.product_code = fut.product_code AND wd.weekday = isodow(fut.ds) - 1)
""")
def q_future_regressors(spark, d):
    return PT.future_regressor(daily_product_sales(spark, d)).select(*out_cols(FR_SPEC))


PRED_SLOTS = (19, 20, 21, 22)
PI_SPEC = KS + ("predict_date:d slot:i discount_rate:f avg_price:f list_price:f is_promo:i weekday:i month:i year:i "
                "is_weekend:i is_month_end:i quarter:i day_index:i season_code:i qty_lag1:f qty_lag3:f qty_lag7:f "
                "qty_lag14:f qty_lag30:f qty_mean7:f qty_std7:f qty_trend7:f qty_mean30:f qty_std30:f qty_last_week:f")


def _lag_aggs():
    out = []
    for k in SC.LAGS:
        lag = f"CAST(predict_date - {k} AS DATE)"
        out.append(f"avg(qty) FILTER (WHERE sale_date = {lag}) AS x{k}")
        out.append(f"avg(qty) FILTER (WHERE sale_date >= CAST(predict_date - {k + 3} AS DATE) AND sale_date <= {lag}) AS r{k}")
    return ",\n    ".join(out)


@register("prediction_input", "J5 J6 W16 D2 P35 U1 P17", sql=with_(hx_cte(), SLOT_AGG_SQL) + f"""
, lp AS (SELECT store_code, product_code, list_price FROM (
          SELECT *, row_number() OVER (PARTITION BY store_code, product_code ORDER BY sale_date DESC, slot DESC) AS rn
          FROM slots) WHERE rn = 1),
b AS (SELECT store_code, product_code, max(sale_date) AS l, min(sale_date) AS first_date FROM slots GROUP BY ALL),
req AS (SELECT b.store_code, b.product_code, b.first_date, lp.list_price,
               CAST(unnest(generate_series(CAST(l + 1 AS DATE), CAST(l + 2 AS DATE), INTERVAL 1 DAY)) AS DATE) AS predict_date
        FROM b JOIN lp ON lp.store_code = b.store_code AND lp.product_code = b.product_code),
grid AS (SELECT req.*, s.slot, dl.discount_rate
         FROM req, (SELECT unnest([{", ".join(str(s) for s in PRED_SLOTS)}]) AS slot) s,
              (SELECT unnest(range(40, 91, 10)) / 100.0 AS discount_rate) dl),
h AS (SELECT s.*, r.predict_date FROM slots s
      JOIN (SELECT DISTINCT store_code, product_code, predict_date FROM req) r
        ON r.store_code = s.store_code AND r.product_code = s.product_code
      WHERE s.slot IN ({", ".join(str(s) for s in PRED_SLOTS)})),
g AS (
  SELECT store_code, product_code, slot, predict_date, avg(qty) AS sm, count(*) AS n,
    {_lag_aggs()},
    avg(qty) FILTER (WHERE sale_date >= CAST(predict_date - 7 AS DATE)) AS m7,
    stddev_samp(qty) FILTER (WHERE sale_date >= CAST(predict_date - 7 AS DATE)) AS s7,
    regr_slope(qty, CAST(date_diff('day', predict_date, sale_date) AS DOUBLE)) FILTER (WHERE sale_date >= CAST(predict_date - 7 AS DATE)) AS t7,
    avg(qty) FILTER (WHERE sale_date >= CAST(predict_date - 30 AS DATE)) AS m30,
    stddev_samp(qty) FILTER (WHERE sale_date >= CAST(predict_date - 30 AS DATE)) AS s30,
    avg(qty) FILTER (WHERE sale_date = CAST(predict_date - 7 AS DATE)) AS lw
  FROM h GROUP BY ALL),
f AS (SELECT store_code, product_code, slot, predict_date,
             {", ".join(f"coalesce(x{k}, r{k}, sm, 0.0) AS qty_lag{k}" for k in SC.LAGS)},
             coalesce(CASE WHEN n >= 7 THEN m7 END, 0.0) AS qty_mean7, coalesce(CASE WHEN n >= 7 THEN s7 END, 0.0) AS qty_std7,
             coalesce(CASE WHEN n >= 7 AND NOT isnan(t7) THEN t7 END, 0.0) AS qty_trend7, coalesce(CASE WHEN n >= 30 THEN m30 END, 0.0) AS qty_mean30,
             coalesce(CASE WHEN n >= 30 THEN s30 END, 0.0) AS qty_std30, coalesce(lw, 0.0) AS qty_last_week FROM g)
SELECT {out_sql(PI_SPEC.replace('qty_lag1:f qty_lag3:f qty_lag7:f qty_lag14:f qty_lag30:f qty_mean7:f qty_std7:f qty_trend7:f qty_mean30:f qty_std30:f qty_last_week:f', ''), 'grid.')},
       {", ".join(f"{__import__('tillsight.plans.sqlparts', fromlist=['r']).r(f'coalesce(f.{c}, 0.0)')} AS {c}" for c in [f"qty_lag{k}" for k in SC.LAGS] + ["qty_mean7", "qty_std7", "qty_trend7", "qty_mean30", "qty_std30", "qty_last_week"])}
FROM (SELECT *, list_price * discount_rate AS avg_price, 1 AS is_promo, isodow(predict_date) AS weekday,
             month(predict_date) AS month, year(predict_date) AS year, CAST(isodow(predict_date) >= 6 AS INT) AS is_weekend,
             CAST(day(predict_date) >= 25 AS INT) AS is_month_end, quarter(predict_date) AS quarter,
             date_diff('day', first_date, predict_date) + 1 AS day_index,
             CASE WHEN month(predict_date) IN (3, 4, 5) THEN 1 WHEN month(predict_date) IN (6, 7, 8) THEN 2
                  WHEN month(predict_date) IN (9, 10, 11) THEN 3 ELSE 4 END AS season_code FROM grid) grid
LEFT JOIN f ON f.store_code = grid.store_code AND f.product_code = grid.product_code AND f.slot = grid.slot
           AND f.predict_date = grid.predict_date
""")
def q_prediction_input(spark, d):
    return SC.prediction_input(hourly_slots(spark, d), KEYS, PRED_SLOTS, days=2).select(*out_cols(PI_SPEC))
