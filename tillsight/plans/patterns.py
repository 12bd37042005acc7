"""Sales-pattern queries over the enriched hourly feed."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as FT
from ..operators import patterns as PT
from ..operators.clean import base_fields
from ..schema import NO_DISCOUNT, WEATHER_TYPE_CODES
from ..sources.dims import calendar_from_dates, weather_from_dates
from ..sources.starschema import hourly_transactions
from .registry import register
from .sqlparts import calendar_cte, hx_cte, out_cols, out_sql, r, weather_cte, with_

KEYS = ["store_code", "product_code"]
KS = "store_code:s product_code:s "


def enriched_hourly(spark, d):
    """Section 3.2 step 2: till rows + P4/P5/P8 fields + weather (J1) + calendar."""
    hx = base_fields(hourly_transactions(spark, d))
    dates = hx.select(F.col("sale_date").alias("date")).distinct()
    w = weather_from_dates(dates).select("date", "code_day", "high", "low")
    c = calendar_from_dates(dates).select("date", "holiday_legal", "weekend")
    return FT.join_calendar(FT.join_weather(hx, w), c)


_RAINY = "('" + "', '".join(WEATHER_TYPE_CODES["is_rainy"]) + "')"
ENRICHED_SQL = [hx_cte(), "dates AS (SELECT DISTINCT sale_date AS date FROM hx)", weather_cte(), calendar_cte(),
                f"""er AS (
  SELECT hx.*, CASE WHEN gross_amount > 0 THEN 1 - discount_amount / gross_amount END AS discount_rate,
         net_amount / nullif(qty, 0) AS avg_price, CAST(discount_type <> '{NO_DISCOUNT}' AS INT) AS is_promo,
         weather.code_day, weather.high, weather.low, cal.holiday_legal, cal.weekend
  FROM hx LEFT JOIN weather ON weather.date = hx.sale_date LEFT JOIN cal ON cal.date = hx.sale_date),
lb AS (
  SELECT er.* FROM er JOIN (SELECT store_code, product_code, max(sale_ts) AS lt FROM er GROUP BY ALL) m
    ON m.store_code = er.store_code AND m.product_code = er.product_code
  WHERE er.sale_ts >= m.lt - INTERVAL 90 DAY)"""]

HOUR_SPEC = KS + "hour:i avg_sales:f total_sales:f transactions:l avg_discount:f"


@register("hourly_sales_profile", "F8 A19", sql=with_(*ENRICHED_SQL) + f"""
SELECT {out_sql(HOUR_SPEC)} FROM (
  SELECT store_code, product_code, hour(sale_ts) AS hour, avg(qty) AS avg_sales, sum(qty) AS total_sales,
         count(*) AS transactions, avg(discount_rate) AS avg_discount FROM lb GROUP BY ALL)
""")
def q_hourly_sales_profile(spark, d):
    return PT.hourly_profile(PT.lookback(enriched_hourly(spark, d), KEYS)).select(*out_cols(HOUR_SPEC))


WD_SPEC = KS + "weekday:i avg_sales:f total_sales:f transactions:l"


@register("weekday_sales_profile", "F8 A20", sql=with_(*ENRICHED_SQL) + f"""
SELECT {out_sql(WD_SPEC)} FROM (
  SELECT store_code, product_code, isodow(sale_ts) - 1 AS weekday, avg(qty) AS avg_sales, sum(qty) AS total_sales,
         count(*) AS transactions FROM lb GROUP BY ALL)
""")
def q_weekday_sales_profile(spark, d):
    return PT.weekday_profile(PT.lookback(enriched_hourly(spark, d), KEYS)).select(*out_cols(WD_SPEC))


PROMO_SQL = """ph AS (
  SELECT store_code, product_code,
         avg(qty) FILTER (WHERE hour(sale_ts) >= 20 AND hour(sale_ts) < 22) AS pa,
         avg(qty) FILTER (WHERE NOT (hour(sale_ts) >= 20 AND hour(sale_ts) < 22)) AS na,
         sum(qty) FILTER (WHERE hour(sale_ts) >= 20 AND hour(sale_ts) < 22) AS ps,
         sum(qty) FILTER (WHERE NOT (hour(sale_ts) >= 20 AND hour(sale_ts) < 22)) AS ns,
         count(*) FILTER (WHERE hour(sale_ts) >= 20 AND hour(sale_ts) < 22) AS pc,
         count(*) FILTER (WHERE NOT (hour(sale_ts) >= 20 AND hour(sale_ts) < 22)) AS nc
  FROM lb GROUP BY ALL),
promo AS (
  SELECT store_code, product_code, CASE WHEN pc > 0 AND nc > 0 THEN pa END AS promo_avg_sales,
         CASE WHEN pc > 0 AND nc > 0 THEN na END AS non_promo_avg_sales,
         CASE WHEN pc > 0 AND nc > 0 THEN CASE WHEN ns > 0 THEN ps / ns ELSE 1.0 END END AS promo_ratio FROM ph)"""
PROMO_SPEC = KS + "promo_avg_sales:f non_promo_avg_sales:f promo_ratio:f"


@register("promo_hours_performance", "F8 F12 A21", sql=with_(*ENRICHED_SQL, PROMO_SQL) +
          f"SELECT {out_sql(PROMO_SPEC)} FROM promo")
def q_promo_hours_performance(spark, d):
    return PT.promo_hours_performance(PT.lookback(enriched_hourly(spark, d), KEYS)).select(*out_cols(PROMO_SPEC))


def elasticity_sql(src: str, bins: int = 5, min_rows: int = 10, name: str = "el") -> str:
    probs = ", ".join(f"{i / bins}" for i in range(bins + 1))
    return f"""{name}_d AS (SELECT * REPLACE ({r('discount_rate', 6)} AS discount_rate) FROM {src} WHERE discount_rate IS NOT NULL),
{name}_e AS (SELECT store_code, product_code, list_sort(list_distinct(quantile_cont(discount_rate, [{probs}]))) AS edges,
             count(*) AS n FROM {name}_d GROUP BY ALL),
{name}_j AS (SELECT d.store_code, d.product_code, d.discount_rate, d.qty,
             len(list_filter(e.edges[2:len(e.edges) - 1], lambda x: x < d.discount_rate)) AS bin
             FROM {name}_d d JOIN {name}_e e ON e.store_code = d.store_code AND e.product_code = d.product_code
             WHERE len(e.edges) >= 2),
{name}_b AS (SELECT store_code, product_code, bin, avg(discount_rate) AS r, sum(qty) AS q FROM {name}_j GROUP BY ALL),
{name}_c AS (SELECT *, (r - lag(r) OVER w) / nullif(lag(r) OVER w, 0) AS pc,
                    (q - lag(q) OVER w) / greatest(lag(q) OVER w, 1.0) AS qc
             FROM {name}_b WINDOW w AS (PARTITION BY store_code, product_code ORDER BY bin)),
{name}_v AS (SELECT store_code, product_code, avg(abs(qc / pc)) AS e FROM {name}_c
             WHERE pc IS NOT NULL AND pc <> 0 GROUP BY ALL),
{name} AS (SELECT e.store_code, e.product_code,
                  CASE WHEN n >= {min_rows} THEN coalesce(v.e, 1.2) ELSE 1.2 END AS price_elasticity
           FROM {name}_e e LEFT JOIN {name}_v v ON v.store_code = e.store_code AND v.product_code = e.product_code)"""


EL_SPEC = KS + "price_elasticity:f"


@register("price_elasticity_bins", "F8 A22 W17", sql=with_(*ENRICHED_SQL, elasticity_sql("lb")) +
          f"SELECT {out_sql(EL_SPEC)} FROM el")
def q_price_elasticity_bins(spark, d):
    return PT.price_elasticity(PT.lookback(enriched_hourly(spark, d), KEYS)).select(*out_cols(EL_SPEC))


IMPACT_SQL = f"""wi AS (
  SELECT store_code, product_code,
    coalesce(CASE WHEN avg(qty) FILTER (WHERE lpad(code_day, 2, '0') = '01') > 0
             THEN avg(qty) FILTER (WHERE lpad(code_day, 2, '0') IN {_RAINY}) / avg(qty) FILTER (WHERE lpad(code_day, 2, '0') = '01') END, 1.0) AS rain_impact,
    coalesce(CASE WHEN avg(qty) FILTER (WHERE high >= 20 AND high < 30) > 0
             THEN avg(qty) FILTER (WHERE high >= 30) / avg(qty) FILTER (WHERE high >= 20 AND high < 30) END, 1.0) AS hot_impact,
    1.0 AS cold_impact,
    coalesce(CASE WHEN avg(qty) FILTER (WHERE NOT (holiday_legal = 1)) > 0
             THEN avg(qty) FILTER (WHERE holiday_legal = 1) / avg(qty) FILTER (WHERE NOT (holiday_legal = 1)) END, 1.0) AS holiday_boost,
    coalesce(CASE WHEN avg(qty) FILTER (WHERE NOT (weekend = 1)) > 0
             THEN avg(qty) FILTER (WHERE weekend = 1) / avg(qty) FILTER (WHERE NOT (weekend = 1)) END, 1.0) AS weekend_boost
  FROM lb GROUP BY ALL)"""
IMPACT_SPEC = KS + "rain_impact:f hot_impact:f cold_impact:f holiday_boost:f weekend_boost:f"


@register("weather_holiday_impact", "F8 A23 A24", sql=with_(*ENRICHED_SQL, IMPACT_SQL) + f"SELECT {out_sql(IMPACT_SPEC)} FROM wi")
def q_weather_holiday_impact(spark, d):
    r = PT.lookback(enriched_hourly(spark, d), KEYS)
    return PT.weather_impact(r, KEYS).join(PT.holiday_impact_ratios(r, KEYS), KEYS).select(*out_cols(IMPACT_SPEC))


def trend_sql(src: str, name: str = "tr") -> str:
    return f"""{name}_d AS (SELECT store_code, product_code, sale_date, sum(qty) AS q, count(*) AS c FROM {src} GROUP BY ALL),
{name} AS (
  SELECT store_code, product_code,
    CASE WHEN sum(c) >= 14 AND count(*) >= 14 AND sum(q) FILTER (WHERE rn > 7 AND rn <= 14) > 0
         THEN (sum(q) FILTER (WHERE rn <= 7) - sum(q) FILTER (WHERE rn > 7 AND rn <= 14)) / sum(q) FILTER (WHERE rn > 7 AND rn <= 14)
         ELSE 0.0 END AS sales_trend
  FROM (SELECT *, row_number() OVER (PARTITION BY store_code, product_code ORDER BY sale_date DESC) AS rn FROM {name}_d)
  GROUP BY ALL)"""


TREND_SPEC = KS + "sales_trend:f"


@register("sales_trend_14d", "F8 A25", sql=with_(*ENRICHED_SQL, trend_sql("lb")) + f"SELECT {out_sql(TREND_SPEC)} FROM tr")
def q_sales_trend_14d(spark, d):
    return PT.sales_trend(PT.lookback(enriched_hourly(spark, d), KEYS), KEYS).select(*out_cols(TREND_SPEC))


BW_SQL = """hp AS (SELECT store_code, product_code, hour(sale_ts) AS hour, avg(qty) AS avg_sales FROM lb GROUP BY ALL),
hr AS (SELECT *, row_number() OVER (PARTITION BY store_code, product_code ORDER BY avg_sales DESC, hour) AS b,
              row_number() OVER (PARTITION BY store_code, product_code ORDER BY avg_sales, hour) AS w FROM hp),
bw AS (SELECT store_code, product_code,
              string_agg(CAST(hour AS VARCHAR), ',' ORDER BY b) FILTER (WHERE b <= 3) AS best_hours,
              string_agg(CAST(hour AS VARCHAR), ',' ORDER BY w) FILTER (WHERE w <= 3) AS worst_hours
       FROM hr GROUP BY ALL)"""
BW_SPEC = KS + "best_hours:s worst_hours:s"


@register("best_worst_hours", "F8 T4", sql=with_(*ENRICHED_SQL, BW_SQL) + f"SELECT {out_sql(BW_SPEC)} FROM bw")
def q_best_worst_hours(spark, d):
    r = PT.lookback(enriched_hourly(spark, d), KEYS)
    return PT.best_worst_hours(PT.hourly_profile(r, KEYS), KEYS).select(*out_cols(BW_SPEC))


PATTERN_SPEC = KS + ("total_sales:f total_revenue:f avg_price:f avg_discount:f discount_frequency:f promo_avg_sales:f "
                     "non_promo_avg_sales:f promo_ratio:f price_elasticity:f rain_impact:f hot_impact:f cold_impact:f "
                     "holiday_boost:f weekend_boost:f sales_trend:f best_hours:s worst_hours:s")
PATTERN_SQL = [*ENRICHED_SQL, PROMO_SQL, elasticity_sql("lb"), IMPACT_SQL, trend_sql("lb"), BW_SQL, """pat AS (
  SELECT b.store_code, b.product_code, b.total_sales, b.total_revenue, b.avg_price, b.avg_discount, b.discount_frequency,
         promo.promo_avg_sales, promo.non_promo_avg_sales, promo.promo_ratio,
         coalesce(el.price_elasticity, 1.2) AS price_elasticity, wi.rain_impact, wi.hot_impact, wi.cold_impact,
         wi.holiday_boost, wi.weekend_boost, tr.sales_trend,
         coalesce(bw.best_hours, '20,21') AS best_hours, coalesce(bw.worst_hours, '2,3,4') AS worst_hours
  FROM (SELECT store_code, product_code, sum(qty) AS total_sales, sum(gross_amount) AS total_revenue,
               avg(avg_price) AS avg_price, avg(discount_rate) AS avg_discount, avg(is_promo) AS discount_frequency
        FROM lb GROUP BY ALL) b
  LEFT JOIN promo USING (store_code, product_code) LEFT JOIN el USING (store_code, product_code)
  LEFT JOIN wi USING (store_code, product_code) LEFT JOIN tr USING (store_code, product_code)
  LEFT JOIN bw USING (store_code, product_code))"""]


@register("sales_pattern", "F8 A26", sql=with_(*PATTERN_SQL) + f"SELECT {out_sql(PATTERN_SPEC)} FROM pat")
def q_sales_pattern(spark, d):
    return PT.sales_pattern(enriched_hourly(spark, d), KEYS).select(*out_cols(PATTERN_SPEC))


NESTED_SPEC = KS + "hours:s weekdays:s promo_ratio:f hot_impact:f weekend_boost:f price_elasticity:f best_hours:s"


def _slots_text(map_col, fields):
    """A map of profiles as text, slots ascending: ``slot=field|field;...``, numbers in ten-thousandths."""
    num = lambda x: F.coalesce(F.floor(x.cast("double") * 1e4 + 0.500001).cast("long").cast("string"), F.lit("-"))
    one = lambda e: F.concat(e["key"].cast("string"), F.lit("="), F.concat_ws("|", *[num(e["value"][f]) for f in fields]))
    return F.array_join(F.transform(F.array_sort(F.map_entries(map_col)), one), ";")


def _slots_sql(slot: str, aggs: str) -> str:
    num = lambda x: f"coalesce(CAST(CAST(floor(CAST({x} AS DOUBLE) * 1e4 + 0.500001) AS BIGINT) AS VARCHAR), '-')"
    text = " || '|' || ".join(num(x) for x in aggs.split(", "))
    return (f"SELECT store_code, product_code, string_agg(t, ';' ORDER BY slot) AS txt FROM (SELECT store_code, product_code, {slot} AS slot, "
            f"CAST({slot} AS VARCHAR) || '=' || {text} AS t FROM lb GROUP BY store_code, product_code, {slot}) GROUP BY ALL")


@register("nested_sales_pattern", "F8 A19 A20 A26", sql=with_(*PATTERN_SQL, f"nh AS ({_slots_sql('hour(sale_ts)', 'avg(qty), sum(qty), count(*), avg(discount_rate)')})",
                                                             f"nw AS ({_slots_sql('((dayofweek(sale_ts) + 6) % 7)', 'avg(qty), sum(qty), count(*)')})") + f"""
SELECT {out_sql(NESTED_SPEC)} FROM (
  SELECT pat.*, nh.txt AS hours, nw.txt AS weekdays FROM pat LEFT JOIN nh USING (store_code, product_code) LEFT JOIN nw USING (store_code, product_code))
""")
def q_nested_sales_pattern(spark, d):
    """The nested record of each product; its maps are rendered as text to be compared."""
    p = PT.nested_sales_pattern(enriched_hourly(spark, d), KEYS)
    return p.select(*KEYS, _slots_text("hourly_pattern", ["avg_sales", "total_sales", "transactions", "avg_discount"]).alias("hours"),
                    _slots_text("weekday_pattern", ["avg_sales", "total_sales", "transactions"]).alias("weekdays"),
                    "promo_performance.promo_ratio", "weather_impact.hot_impact", "holiday_impact.weekend_boost",
                    "price_elasticity", "best_hours").select(*out_cols(NESTED_SPEC))


SUMMARY_SPEC = KS + ("total_qty:f total_revenue:f avg_price:f avg_discount:f discount_std:f sales_trend:f "
                     "discount_frequency:f price_elasticity:f promo_sensitivity:f best_hours:s worst_hours:s "
                     "rain_impact:f hot_impact:f holiday_boost:f weekend_boost:f")


@register("product_summary", "A27", sql=with_(*PATTERN_SQL, trend_sql("er", "tra")) + f"""
, tot AS (SELECT store_code, product_code, sum(qty) AS total_qty, sum(gross_amount) AS total_revenue,
                 CASE WHEN sum(net_amount) <> 0 AND sum(qty) <> 0 THEN sum(net_amount) / sum(qty) ELSE 0.0 END AS avg_price,
                 avg(discount_rate) AS avg_discount, stddev_samp(discount_rate) AS discount_std FROM er GROUP BY ALL)
SELECT {out_sql(SUMMARY_SPEC)} FROM (
  SELECT tot.*, tra.sales_trend, pat.discount_frequency, pat.price_elasticity,
         coalesce(pat.promo_ratio, 1.2) AS promo_sensitivity, pat.best_hours, pat.worst_hours, pat.rain_impact,
         pat.hot_impact, pat.holiday_boost, pat.weekend_boost
  FROM tot LEFT JOIN tra USING (store_code, product_code) LEFT JOIN pat USING (store_code, product_code))
""")
def q_product_summary(spark, d):
    return PT.product_summary(enriched_hourly(spark, d), KEYS).select(*out_cols(SUMMARY_SPEC))
