"""Feature-table queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import features as FT
from ..operators.aggregate import daily_from_slots, half_hour_buckets, slot_aggregate, slot_grid
from ..operators.clean import base_fields, day_index
from ..schema import (DAIRY_KEYWORDS, FRESH_CATEGORY_PREFIX, FRESH_KEYWORDS, NO_DISCOUNT, PACK_SIZE_PATTERNS)
from ..sources.starschema import hourly_transactions, transactions
from .calendar import CAL_FEATURE_SQL, WEATHER_CLEAN_SQL, calendar_features_for, clean_weather_for
from .registry import register
from .reports import DENSE_SQL, dense_daily
from .sales import DAILY_SQL, daily_product_sales
from .sqlparts import calendar_cte, hx_cte, out_cols, out_sql, r, tx_cte, weather_cte, with_

K, O = ["product_code"], ["sale_date"]
W = "PARTITION BY product_code ORDER BY sale_date"
TP = FT.TWO_PI


def rows(n_back: int, n_fwd: int = 0) -> str:
    fwd = "CURRENT ROW" if n_fwd == 0 else f"{n_fwd} FOLLOWING"
    back = "CURRENT ROW" if n_back == 0 else (f"{n_back} PRECEDING" if n_back > 0 else f"{-n_back} FOLLOWING")
    return f"ROWS BETWEEN {back} AND {fwd}"


# ---- daily feature table ----------------------------------------------------------

def daily_features(spark, d):
    """Training feature table at day grain (section 3.1 step 5), all products at once:
    A3 -> P3/P11/P17 -> W1 lags -> W2 rolling -> W4 trend -> J1 weather (P18/P21)
    -> J2 calendar (P22/W5/W6) -> P25 interactions."""
    daily = daily_product_sales(spark, d)
    daily = daily.withColumn("discount_rate", F.coalesce(
        F.when(F.col("gross_amount") > 0, 1 - F.col("discount_amount") / F.col("gross_amount")), F.lit(1.0)))
    daily = FT.daily_time_features(day_index(daily, K, aggregated=True))
    daily = FT.lag_features(daily, K, O)
    daily = FT.rolling_features(daily, K, O)
    daily = FT.trend_features(daily, K, O)
    dates = daily.select(F.col("sale_date").alias("date")).distinct()
    weather = clean_weather_for(dates).select("date", "temperature", "temp_high", "temp_low", "rainfall",
                                              "weather_severity", "temp_band", "range_band", "bad_weather")
    f = FT.join_calendar(FT.join_weather(daily, weather), calendar_features_for(dates))
    return FT.interaction_features(f)


FEAT_SPEC = ("product_code:s sale_date:d qty:f gross_amount:f avg_price:f discount_rate:f promo_count:l is_promo:i "
             "day_index:i weekday:i month:i is_weekend:i is_month_end:i quarter:i year:i season:s season_code:i "
             "qty_lag1:f qty_lag3:f qty_lag7:f qty_lag14:f qty_lag30:f qty_mean7:f qty_std7:f qty_mean14:f "
             "qty_std14:f qty_mean30:f qty_std30:f qty_trend7:f qty_last_week:f temperature:f temp_high:f "
             "temp_low:f rainfall:f weather_severity:i temp_band:s range_band:s bad_weather:i is_holiday:i "
             "holiday_kind:s prev_day_holiday:i next_day_holiday:i holiday_streak:l promo_weekend:f "
             "promo_month_end:f weather_promo:f")

SEASON_SQL = ("CASE WHEN month(sale_date) IN (12, 1, 2) THEN 'winter' WHEN month(sale_date) IN (3, 4, 5) THEN 'spring' "
              "WHEN month(sale_date) IN (6, 7, 8) THEN 'summer' ELSE 'autumn' END")
SEASON_CODE_SQL = ("CASE WHEN month(sale_date) IN (3, 4, 5) THEN 1 WHEN month(sale_date) IN (6, 7, 8) THEN 2 "
                   "WHEN month(sale_date) IN (9, 10, 11) THEN 3 ELSE 4 END")

FEATURE_SQL = with_(tx_cte(), DAILY_SQL, "dates AS (SELECT DISTINCT sale_date AS date FROM daily)", weather_cte(),
                    WEATHER_CLEAN_SQL, calendar_cte(), CAL_FEATURE_SQL) + f"""
, f0 AS (
  SELECT product_code, sale_date, qty, gross_amount, promo_count, CAST(promo_count > 0 AS INT) AS is_promo,
         CASE WHEN qty > 0 THEN (gross_amount - discount_amount) / qty END AS avg_price,
         coalesce(CASE WHEN gross_amount > 0 THEN 1 - discount_amount / gross_amount END, 1.0) AS discount_rate,
         date_diff('day', min(sale_date) OVER (PARTITION BY product_code), sale_date) + 1 AS day_index,
         isodow(sale_date) - 1 AS weekday, month(sale_date) AS month, CAST(isodow(sale_date) >= 6 AS INT) AS is_weekend,
         CAST(day(sale_date) >= 25 AS INT) AS is_month_end, quarter(sale_date) AS quarter, year(sale_date) AS year,
         {SEASON_SQL} AS season, {SEASON_CODE_SQL} AS season_code,
         {", ".join(f"coalesce(lag(qty, {k}) OVER ({W}), 0.0) AS qty_lag{k}" for k in (1, 3, 7, 14, 30))},
         {", ".join(f"avg(qty) OVER ({W} {rows(n - 1)}) AS qty_mean{n}, stddev_samp(qty) OVER ({W} {rows(n - 1)}) AS qty_std{n}" for n in (7, 14, 30))},
         coalesce(lag(qty, 7) OVER ({W}), 0.0) AS qty_last_week
  FROM daily),
f1 AS (SELECT *, coalesce(qty_mean7 / nullif(lag(qty_mean7, 7) OVER ({W}), 0) - 1, 0.0) AS qty_trend7 FROM f0),
f2 AS (
  SELECT f1.*, wb.temperature, wb.temp_high, wb.temp_low, wb.rainfall, wb.weather_severity, wb.temp_band,
         wb.range_band, wb.bad_weather, cs.is_holiday, cs.holiday_kind, cs.prev_day_holiday, cs.next_day_holiday,
         cs.holiday_streak,
         CASE WHEN discount_rate <> 0 THEN is_weekend * qty / discount_rate ELSE 0.0 END AS promo_weekend,
         CASE WHEN discount_rate <> 0 THEN is_month_end * qty / discount_rate ELSE 0.0 END AS promo_month_end,
         CASE WHEN discount_rate <> 0 THEN wb.bad_weather * qty / discount_rate ELSE 0.0 END AS weather_promo
  FROM f1 LEFT JOIN wb ON wb.date = f1.sale_date LEFT JOIN cs ON cs.date = f1.sale_date)
SELECT {out_sql(FEAT_SPEC)} FROM f2
"""


@register("daily_feature_table", "P3 P11 P17 W1 W2 W4 J1 J2 P18 P21 P22 W5 W6 J10 P25", sql=FEATURE_SQL)
def q_daily_feature_table(spark, d):
    return daily_features(spark, d).select(*out_cols(FEAT_SPEC))


ROLL_SPEC = "product_code:s sale_date:d " + " ".join(f"qty_{s}{n}:f" for n in (7, 14, 30) for s in ("mean", "std", "max", "min"))


@register("daily_rolling_filled", "W3", sql=with_(tx_cte(), DAILY_SQL) + f"""
SELECT {out_sql(ROLL_SPEC)} FROM (
  SELECT product_code, sale_date,
  {", ".join(f"coalesce({fn}(qty) OVER ({W} {rows(n - 1)}), 0.0) AS qty_{s}{n}" for n in (7, 14, 30) for s, fn in (("mean", "avg"), ("std", "stddev_samp"), ("max", "max"), ("min", "min")))}
  FROM daily)
""")
def q_daily_rolling_filled(spark, d):
    g = FT.rolling_features(daily_product_sales(spark, d), K, O, stats=("mean", "std", "max", "min"), fill_zero=True)
    return g.select(*out_cols(ROLL_SPEC))


DLAG_SPEC = "product_code:s sale_date:d qty:f qty_lag1:f qty_dlag1:f qty_lag7:f qty_dlag7:f"


@register("daily_date_lags", "W1", sql=with_(tx_cte(), DAILY_SQL) + f"""
SELECT {out_sql(DLAG_SPEC, 'a.')} FROM (
  SELECT a.*, coalesce(lag(a.qty, 1) OVER ({W.replace('product_code', 'a.product_code').replace('sale_date', 'a.sale_date')}), 0.0) AS qty_lag1,
         coalesce(lag(a.qty, 7) OVER ({W.replace('product_code', 'a.product_code').replace('sale_date', 'a.sale_date')}), 0.0) AS qty_lag7,
         coalesce(b.qty, 0.0) AS qty_dlag1, coalesce(c.qty, 0.0) AS qty_dlag7
  FROM daily a
  LEFT JOIN daily b ON b.product_code = a.product_code AND CAST(b.sale_date + 1 AS DATE) = a.sale_date
  LEFT JOIN daily c ON c.product_code = a.product_code AND CAST(c.sale_date + 7 AS DATE) = a.sale_date) a
""")
def q_daily_date_lags(spark, d):
    daily = daily_product_sales(spark, d).select("product_code", "sale_date", "qty")
    g = FT.lag_features(daily, K, O, lags=(1, 7))
    g = FT.date_lag_features(g, K, lags=(1, 7))
    return g.select(*out_cols(DLAG_SPEC))


CMA_SPEC = "product_code:s sale_date:d qty:f qty_cma:f qty_cum:f"


@register("centred_ma_cumulative", "W9 W10 J4", sql=with_(tx_cte(), DAILY_SQL, DENSE_SQL) + f"""
, c AS (SELECT *, least(7, count(*) OVER (PARTITION BY product_code) // 4) AS win,
        {", ".join(f"avg(qty) OVER ({W} {rows((w - 1) // 2 if w % 2 else w // 2, (w - 1) // 2 if w % 2 else w // 2 - 1)}) AS c{w}" for w in range(2, 8))},
        sum(qty) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS qty_cum
        FROM dense)
SELECT {out_sql(CMA_SPEC)} FROM (
  SELECT *, CASE win {" ".join(f"WHEN {w} THEN c{w}" for w in range(2, 8))} END AS qty_cma FROM c)
""")
def q_centred_ma_cumulative(spark, d):
    runs = dense_daily(spark, d, runs=True).select("product_code", "sale_date", "qty", "run_days")
    # a running total does not change on empty days
    return FT.centred_over_runs(FT.cumulative(runs, K, O), K, O).select(*out_cols(CMA_SPEC))


# ---- hour grain (events) ------------------------------------------------------------

TT_SPEC = ("order_id:s sale_ts:t year:i month:i day:i hour:i minute:i weekday:i is_weekend:i day_part:s "
           "is_promo_hour:i quarter:i is_month_end:i is_month_start:i hour_sin:f hour_cos:f day_sin:f day_cos:f "
           "month_sin:f month_cos:f is_business_hour:i is_peak_hour:i local_ts:t")


def _cyc(x, p, name):
    k = repr(TP / p)
    return f"sin({x} * {k}) AS {name}_sin, cos({x} * {k}) AS {name}_cos"


@register("transaction_time_features", "P9 P10 P14 P36 P38", sql=with_(hx_cte()) + f"""
, t AS (
  SELECT order_id, sale_ts, year(sale_ts) AS year, month(sale_ts) AS month, day(sale_ts) AS day, hour(sale_ts) AS hour,
         minute(sale_ts) AS minute, isodow(sale_ts) - 1 AS weekday, CAST(isodow(sale_ts) >= 6 AS INT) AS is_weekend,
         CASE WHEN hour(sale_ts) < 6 THEN '深夜' WHEN hour(sale_ts) < 9 THEN '早高峰' WHEN hour(sale_ts) < 11 THEN '上午'
              WHEN hour(sale_ts) < 14 THEN '中午' WHEN hour(sale_ts) < 17 THEN '下午' WHEN hour(sale_ts) < 20 THEN '晚高峰'
              ELSE '晚间' END AS day_part,
         CAST(hour(sale_ts) >= 20 AND hour(sale_ts) < 22 AS INT) AS is_promo_hour, quarter(sale_ts) AS quarter,
         CAST(day(sale_ts) >= 26 AS INT) AS is_month_end, CAST(day(sale_ts) <= 5 AS INT) AS is_month_start,
         {_cyc('hour(sale_ts)', 24, 'hour')}, {_cyc('(isodow(sale_ts) - 1)', 7, 'day')}, {_cyc('month(sale_ts)', 12, 'month')},
         CAST(strftime(sale_ts, '%H:%M') >= '08:00' AND strftime(sale_ts, '%H:%M') < '22:00' AS INT) AS is_business_hour,
         CAST((strftime(sale_ts, '%H:%M') >= '08:00' AND strftime(sale_ts, '%H:%M') < '10:00')
              OR (strftime(sale_ts, '%H:%M') >= '12:00' AND strftime(sale_ts, '%H:%M') < '14:00')
              OR (strftime(sale_ts, '%H:%M') >= '17:00' AND strftime(sale_ts, '%H:%M') < '19:00')
              OR (strftime(sale_ts, '%H:%M') >= '20:00' AND strftime(sale_ts, '%H:%M') < '22:00') AS INT) AS is_peak_hour,
         sale_ts + INTERVAL 8 HOUR AS local_ts
  FROM hx)
SELECT {out_sql(TT_SPEC)} FROM t
""")
def q_transaction_time_features(spark, d):
    hx = hourly_transactions(spark, d).select("order_id", "sale_ts")
    g = FT.transaction_time_features(hx)
    g = FT.cyclic_features(g)
    g = FT.business_hour_labels(g)
    g = FT.timezone_shift(g)
    return g.select(*out_cols(TT_SPEC))


ASOF_SPEC = ("order_id:s year:i hour_of_day:i minute_of_hour:i day_of_week:i day_of_month:i month:i weekend:i quarter:i "
             "time_to_promo_start:i time_to_promo_end:i in_promotion_time:i promo_duration_hours:i hour_sin:f hour_cos:f "
             "day_sin:f day_cos:f is_morning_rush:i is_lunch_time:i is_evening_rush:i is_night:i is_month_end:i "
             "is_month_start:i dayofyear:i weekofyear:i month_start:i month_end:i quarter_start:i quarter_end:i "
             "year_start:i year_end:i hours_to_close:f decay:f is_clearance_time:i")


@register("asof_base_features", "P12 P13 P14 P15 P37", sql=with_(hx_cte()) + f"""
, t AS (
  SELECT order_id, sale_ts AS a, CAST(sale_ts AS DATE) AS x FROM hx),
u AS (
  SELECT *, year(a) AS year, hour(a) AS hour_of_day, minute(a) AS minute_of_hour, isodow(a) - 1 AS day_of_week,
         day(a) AS day_of_month, month(a) AS month, CAST(isodow(a) >= 6 AS INT) AS weekend, quarter(a) AS quarter,
         (((20 - hour(a)) % 24) + 24) % 24 AS time_to_promo_start, (((22 - hour(a)) % 24) + 24) % 24 AS time_to_promo_end,
         CAST(hour(a) >= 20 AND hour(a) < 22 AS INT) AS in_promotion_time, 2 AS promo_duration_hours,
         {_cyc('hour(a)', 24, 'hour')}, {_cyc('(isodow(a) - 1)', 7, 'day')},
         CAST(hour(a) >= 7 AND hour(a) < 9 AS INT) AS is_morning_rush, CAST(hour(a) >= 11 AND hour(a) < 13 AS INT) AS is_lunch_time,
         CAST(hour(a) >= 17 AND hour(a) < 19 AS INT) AS is_evening_rush, CAST(hour(a) >= 22 OR hour(a) < 6 AS INT) AS is_night,
         CAST(day(a) >= 25 AS INT) AS is_month_end, CAST(day(a) <= 5 AS INT) AS is_month_start,
         dayofyear(x) AS dayofyear, weekofyear(x) AS weekofyear, CAST(day(x) = 1 AS INT) AS month_start,
         CAST(x = last_day(x) AS INT) AS month_end,
         CAST(x = make_date(year(x), (quarter(x) - 1) * 3 + 1, 1) AS INT) AS quarter_start,
         CAST(x = CAST(make_date(year(x), (quarter(x) - 1) * 3 + 1, 1) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS INT) AS quarter_end,
         CAST(month(x) = 1 AND day(x) = 1 AS INT) AS year_start, CAST(month(x) = 12 AND day(x) = 31 AS INT) AS year_end,
         ((((22 * 60) - (hour(a) * 60 + minute(a) + second(a) / 60.0)) % 1440 + 1440) % 1440) / 60.0 AS hours_to_close,
         CAST(hour(a) >= 20 AND hour(a) < 22 AS INT) AS is_clearance_time
  FROM t)
SELECT {out_sql(ASOF_SPEC.replace(' decay:f', ''))}, {r('1 + pow(1 - hours_to_close / 2.0, 2.0)')} AS decay FROM u
""")
def q_asof_base_features(spark, d):
    hx = hourly_transactions(spark, d).select("order_id", F.col("sale_ts").alias("as_of"))
    g = FT.asof_base_features(hx)
    g = FT.date_flags(g.withColumn("_d", F.to_date("as_of")), "_d")
    g = (g.withColumn("hours_to_close", FT.time_to_close_hours(F.col("as_of"), "22:00"))
          .withColumn("decay", FT.decay_factor(F.col("as_of"), "20:00", "22:00"))
          .withColumn("is_clearance_time", ((F.hour("as_of") >= 20) & (F.hour("as_of") < 22)).cast("int")))
    return g.select(*out_cols(ASOF_SPEC))


SLOT_SPEC = ("product_code:s sale_date:d slot:i store_code:s qty:f gross_amount:f list_price:f avg_price:f "
             "promo_share:f discount_rate:f")


def hourly_slots(spark, d, gap=60):
    """P7 + A1 + A4: slot rows of the hourly feed (all keys)."""
    return slot_aggregate(base_fields(hourly_transactions(spark, d), gap_minutes=gap))


SLOT_AGG_SQL = f"""s0 AS (
  SELECT store_code, product_code, sale_date, CAST((hour(sale_ts) * 60 + minute(sale_ts)) // 60 AS INT) + 1 AS slot,
         sum(qty) AS qty, sum(gross_amount) AS gross_amount, avg(list_price) AS list_price,
         avg(CAST(discount_type <> '{NO_DISCOUNT}' AS INT)) AS promo_share, sum(discount_amount) AS discount_amount
  FROM hx GROUP BY ALL),
slots AS (
  SELECT *, coalesce(CASE WHEN qty > 0 THEN (gross_amount - discount_amount) / qty END, list_price) AS avg_price,
         coalesce(CASE WHEN gross_amount > 0 THEN 1 - discount_amount / gross_amount END, 1.0) AS discount_rate
  FROM s0)"""


@register("hourly_slot_grid", "P7 A1 A4 J3 W7 W8", sql=with_(hx_cte(), SLOT_AGG_SQL) + f"""
, b AS (SELECT min(slot) AS s0, max(slot) AS s1 FROM slots),
grid AS (SELECT p.product_code, d.sale_date, CAST(unnest(range(b.s0, b.s1 + 1)) AS INT) AS slot
         FROM (SELECT DISTINCT product_code FROM slots) p, (SELECT DISTINCT sale_date FROM slots) d, b),
j AS (SELECT g.product_code, g.sale_date, g.slot, s.store_code, s.qty, s.gross_amount, s.list_price, s.avg_price,
             s.promo_share, s.discount_rate
      FROM grid g LEFT JOIN slots s ON s.product_code = g.product_code AND s.sale_date = g.sale_date AND s.slot = g.slot),
f AS (SELECT product_code, sale_date, slot, qty, gross_amount,
      {", ".join(f"coalesce(last_value({c} IGNORE NULLS) OVER (PARTITION BY product_code, sale_date ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value({c} IGNORE NULLS) OVER (PARTITION BY product_code, sale_date ORDER BY slot ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {c}" for c in ("list_price", "avg_price", "promo_share", "discount_rate", "store_code"))}
      FROM j),
m AS (SELECT *, avg(list_price) OVER (PARTITION BY product_code) AS m_lp, avg(avg_price) OVER (PARTITION BY product_code) AS m_ap FROM f)
SELECT {out_sql(SLOT_SPEC.replace('qty:f gross_amount:f list_price:f avg_price:f promo_share:f', ''))},
       {r('coalesce(qty, 0.0)')} AS qty, {r('coalesce(gross_amount, 0.0)')} AS gross_amount,
       {r('coalesce(list_price, m_lp)')} AS list_price, {r('coalesce(avg_price, m_ap)')} AS avg_price,
       {r('coalesce(promo_share, 0.0)')} AS promo_share
FROM m
""")
def q_hourly_slot_grid(spark, d):
    return slot_grid(hourly_slots(spark, d)).select(*out_cols(SLOT_SPEC))


D2_SPEC = ("store_code:s product_code:s sale_date:d qty:f gross_amount:f list_price:f promo_share:f mean_slot:f "
           "discount_amount:f avg_price:f discount_rate:f")


@register("daily_from_slots", "A2 A4 P7", sql=with_(hx_cte()) + f"""
, a AS (SELECT store_code, product_code, sale_date, sum(qty) AS qty, sum(gross_amount) AS gross_amount,
               avg(list_price) AS list_price, avg(CAST(discount_type <> '{NO_DISCOUNT}' AS INT)) AS promo_share,
               avg(CAST((hour(sale_ts) * 60 + minute(sale_ts)) // 60 AS INT) + 1) AS mean_slot,
               sum(discount_amount) AS discount_amount FROM hx GROUP BY ALL)
SELECT {out_sql(D2_SPEC.replace(' avg_price:f discount_rate:f', ''))},
       {r('coalesce(CASE WHEN qty > 0 THEN (gross_amount - discount_amount) / qty END, list_price)')} AS avg_price,
       {r('coalesce(CASE WHEN gross_amount > 0 THEN 1 - discount_amount / gross_amount END, 1.0)')} AS discount_rate
FROM a
""")
def q_daily_from_slots(spark, d):
    g = daily_from_slots(base_fields(hourly_transactions(spark, d)))
    return g.select(*out_cols(D2_SPEC))


HH_SPEC = "store_code:s product_code:s bucket_start:t qty:f list_price:f discount_rate:f discounted_price:f"


@register("half_hour_buckets", "A5 P4", sql=with_(hx_cte()) + f"""
, h AS (SELECT *, CASE WHEN gross_amount > 0 THEN 1 - discount_amount / gross_amount END AS discount_rate FROM hx)
SELECT {out_sql(HH_SPEC)} FROM (
  SELECT store_code, product_code, time_bucket(INTERVAL 30 MINUTE, sale_ts) AS bucket_start, sum(qty) AS qty,
         avg(list_price) AS list_price, avg(discount_rate) AS discount_rate,
         avg(list_price * discount_rate) AS discounted_price
  FROM h GROUP BY ALL)
""")
def q_half_hour_buckets(spark, d):
    return half_hour_buckets(base_fields(hourly_transactions(spark, d))).select(*out_cols(HH_SPEC))


# ---- product attributes / latest rows ------------------------------------------------

PA_SPEC = ("product_code:s category_code:s product_name:s main_category:s sub_category:s pack_size:s pack_size_num:f "
           "name_length:i is_fresh:i shelf_life_hours:i")


def latest_per_product(tx, cols):
    """The latest row's values per product (date, order, line break ties): a max_by aggregate."""
    order = F.struct("sale_date", "order_id", "line_no")
    return tx.groupBy("product_code").agg(*[F.max_by(c, order).alias(c) for c in cols])


def _pack_sql(name):
    e = "''"
    for p in reversed(PACK_SIZE_PATTERNS):
        e = f"CASE WHEN regexp_extract({name}, '{p}', 1) <> '' THEN regexp_extract({name}, '{p}', 1) ELSE {e} END"
    return e


def _any_contains(name, words):
    return "(" + " OR ".join(f"contains({name}, '{w}')" for w in words) + ")"


@register("product_attributes", "P26 P27 P28 P29 P30 W14", sql=with_(tx_cte(part=True)) + f"""
, l AS (SELECT product_code, category_code, product_name FROM (
          SELECT *, row_number() OVER (PARTITION BY product_code ORDER BY sale_date DESC, order_id DESC, line_no DESC) AS rn
          FROM tx) WHERE rn = 1),
a AS (SELECT *, coalesce(product_name, '') AS nm FROM l),
b AS (SELECT *, {_pack_sql('nm')} AS pack_size,
             ({_any_contains('nm', FRESH_KEYWORDS)} OR coalesce(starts_with(category_code, '{FRESH_CATEGORY_PREFIX}'), false)) AS fresh,
             {_any_contains('nm', DAIRY_KEYWORDS)} AS dairy FROM a)
SELECT {out_sql(PA_SPEC)} FROM (
  SELECT product_code, category_code, product_name, coalesce(substring(category_code, 1, 2), '00') AS main_category,
         coalesce(substring(category_code, 1, 4), '0000') AS sub_category, pack_size,
         coalesce(CASE WHEN pack_size <> '' THEN CAST(pack_size AS DOUBLE) END, 0.0) AS pack_size_num,
         length(nm) AS name_length, CAST(fresh AS INT) AS is_fresh,
         CASE WHEN fresh AND dairy THEN 48 WHEN fresh THEN 24 ELSE 168 END AS shelf_life_hours FROM b)
""")
def q_product_attributes(spark, d):
    latest = latest_per_product(transactions(spark, d, part=True), ["category_code", "product_name"])
    return FT.product_attributes(latest).select(*out_cols(PA_SPEC))


LN_SPEC = "product_code:s last7_mean:f last30_mean:f last_date:d"


@register("recent_window_means", "W15 W14", sql=with_(tx_cte(), DAILY_SQL) + f"""
SELECT {out_sql(LN_SPEC)} FROM (
  SELECT product_code, avg(qty) FILTER (WHERE rn <= 7) AS last7_mean, avg(qty) FILTER (WHERE rn <= 30) AS last30_mean,
         max(sale_date) AS last_date
  FROM (SELECT *, row_number() OVER (PARTITION BY product_code ORDER BY sale_date DESC) AS rn FROM daily)
  GROUP BY product_code)
""")
def q_recent_window_means(spark, d):
    daily = daily_product_sales(spark, d)
    rn = F.row_number().over(Window.partitionBy("product_code").orderBy(F.desc("sale_date")))
    g = daily.withColumn("rn", rn).groupBy("product_code").agg(
        F.avg(F.when(F.col("rn") <= 7, F.col("qty"))).alias("last7_mean"),
        F.avg(F.when(F.col("rn") <= 30, F.col("qty"))).alias("last30_mean"),
        F.max("sale_date").alias("last_date"))
    return g.select(*out_cols(LN_SPEC))


SFV_SPEC = ("store_code:s product_code:s bucket_start:t qty:f year:i hour:i minute:i day_of_week:i month:i "
            "day_of_month:i weekend:i in_promotion:i time_to_promo_end:f hour_sin:f hour_cos:f day_sin:f day_cos:f "
            "is_morning_rush:i is_lunch_time:i is_evening_rush:i is_night:i price:f rate:f has_discount:i price_ratio:f")


@register("slot_feature_vector", "P16 A5", sql=with_(hx_cte()) + f"""
, h AS (SELECT *, CASE WHEN gross_amount > 0 THEN 1 - discount_amount / gross_amount END AS discount_rate FROM hx),
b AS (SELECT store_code, product_code, time_bucket(INTERVAL 30 MINUTE, sale_ts) AS bucket_start, sum(qty) AS qty,
             avg(discount_rate) AS discount_rate, avg(list_price * discount_rate) AS discounted_price FROM h GROUP BY ALL),
v AS (SELECT *, coalesce(discount_rate, 1.0) AS d FROM b)
SELECT {out_sql(SFV_SPEC)} FROM (
  SELECT store_code, product_code, bucket_start, qty, year(bucket_start) AS year, hour(bucket_start) AS hour,
         minute(bucket_start) AS minute, isodow(bucket_start) - 1 AS day_of_week, month(bucket_start) AS month,
         day(bucket_start) AS day_of_month, CAST(isodow(bucket_start) >= 6 AS INT) AS weekend,
         CAST(hour(bucket_start) >= 20 AND hour(bucket_start) < 22 AS INT) AS in_promotion,
         greatest(0.0, 22 - hour(bucket_start) - minute(bucket_start) / 60.0) AS time_to_promo_end,
         {_cyc('hour(bucket_start)', 24, 'hour')}, {_cyc('(isodow(bucket_start) - 1)', 7, 'day')},
         CAST(hour(bucket_start) >= 7 AND hour(bucket_start) < 9 AS INT) AS is_morning_rush,
         CAST(hour(bucket_start) >= 11 AND hour(bucket_start) < 13 AS INT) AS is_lunch_time,
         CAST(hour(bucket_start) >= 17 AND hour(bucket_start) < 19 AS INT) AS is_evening_rush,
         CAST(hour(bucket_start) >= 22 OR hour(bucket_start) < 6 AS INT) AS is_night,
         coalesce(discounted_price, 100.0) AS price, d AS rate, CAST(d < 1 AS INT) AS has_discount,
         CASE WHEN d > 0 THEN 1.0 / d ELSE 1.0 END AS price_ratio FROM v)
""")
def q_slot_feature_vector(spark, d):
    b = half_hour_buckets(base_fields(hourly_transactions(spark, d)))
    return FT.slot_feature_vector(b).select(*out_cols(SFV_SPEC))
