"""Calendar and weather dimension queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as FT
from ..sources.dims import calendar_from_dates, calendar_years_from, calendar_years_sql, weather_from_dates, severity_sql
from ..sources.starschema import hourly_transactions, transactions
from .registry import REGISTRY, register
from .sqlparts import calendar_cte, dates_cte, hx_cte, out_cols, out_sql, tx_cte, weather_cte, with_


def fact_dates(spark, d):
    """Distinct business dates of the fact table (bounded by days)."""
    return transactions(spark, d).select(F.col("sale_date").alias("date")).distinct()


CAL_SPEC = ("date:d year:i month:i yearweek:i yearday:i week:i weekend:i workday:i holiday_type:s "
            "is_legal_workday:i holiday_legal:i holiday_recess:i holiday_name:s")


@register("calendar_from_dates", "S4 U3", sql=with_(tx_cte(), dates_cte(), calendar_cte()) +
          f"SELECT {out_sql(CAL_SPEC)} FROM cal")
def q_calendar_from_dates(spark, d):
    return calendar_from_dates(fact_dates(spark, d)).select(*out_cols(CAL_SPEC))


YEARS_SPEC = ("date_int:i ds:d year:i month:i yearweek:i yearday:i week:i weekend:i workday:i "
              "holiday_legal:i holiday_recess:i holiday_type:s holiday_name:s")


def year_range_dates(spark, d):
    """Every day of the fact's year range: [Jan 1 of first year, Dec 31 of last year]."""
    return year_span(transactions(spark, d))


def year_span(rows):
    y = rows.agg(F.min(F.year("sale_date")).alias("y0"), F.max(F.year("sale_date")).alias("y1"))
    return y.select(F.explode(F.sequence(F.make_date("y0", F.lit(1), F.lit(1)),
                                         F.make_date("y1", F.lit(12), F.lit(31)))).alias("date"))


def _years_sql(rel: str) -> str:
    """CTE ``days``: every day of the years that ``rel``'s sale dates span."""
    return f"""yr AS (SELECT min(year(sale_date)) AS y0, max(year(sale_date)) AS y1 FROM {rel}),
days AS (SELECT CAST(unnest(generate_series(make_date(CAST(y0 AS INT), 1, 1), make_date(CAST(y1 AS INT), 12, 31),
                                     INTERVAL 1 DAY)) AS DATE) AS date FROM yr)"""


@register("calendar_year_range", "S5 J11", sql=with_(tx_cte(), _years_sql("tx"), calendar_years_sql("days"))
          + f"SELECT {out_sql(YEARS_SPEC)} FROM cyears")
def q_calendar_year_range(spark, d):
    return calendar_years_from(year_range_dates(spark, d)).select(*out_cols(YEARS_SPEC))


IMPACT_SPEC = "ds:d holiday_impact:i is_holiday:i holiday_kind:s"


def _impact_sql(source: str, rel: str) -> str:
    return with_(source, _years_sql(rel), calendar_years_sql("days")) + f"""
, s AS (
  SELECT ds,
         CASE WHEN holiday_name IS NULL OR holiday_name = '' THEN 0 WHEN holiday_type = 'holiday' THEN 4
              WHEN holiday_type = 'recess' THEN 3
              WHEN (month(ds) = 6 AND day(ds) = 18) OR (month(ds) = 11 AND day(ds) = 11)
                   OR (month(ds) = 12 AND day(ds) = 12) THEN 2 ELSE 1 END AS holiday_impact,
         coalesce(holiday_legal, 0) AS is_holiday,
         CASE WHEN coalesce(holiday_legal, 0) = 1 THEN '法定节假日' ELSE '普通日' END AS holiday_kind
  FROM cyears)
SELECT {out_sql(IMPACT_SPEC)} FROM s
"""


def _impact(dates):
    cal = calendar_years_from(dates)
    scored = FT.holiday_impact(cal, "ds")
    cleaned = FT.clean_calendar(cal.withColumnRenamed("ds", "date")).withColumnRenamed("date", "ds")
    return scored.join(cleaned, "ds").select(*out_cols(IMPACT_SPEC))


@register("holiday_impact_scores", "P22 P23", sql=_impact_sql(tx_cte(), "tx"))
def q_holiday_impact_scores(spark, d):
    return _impact(year_range_dates(spark, d))


@register("holiday_impact_hourly_feed", "P22 P23 S5", sql=_impact_sql(hx_cte(), "hx"))
def q_holiday_impact_hourly_feed(spark, d):
    """The same for the years of the hourly feed, for which swap days are known."""
    return _impact(year_span(hourly_transactions(spark, d)))


WEATHER_SPEC = ("date:d temperature:f temp_high:f temp_low:f temp_range:f rainfall:f weather_severity:i "
                "temp_band:s range_band:s bad_weather:i is_sunny:i is_cloudy:i is_rainy:i is_snowy:i is_foggy:i is_haze:i")

WEATHER_CLEAN_SQL = f"""wc AS (
  SELECT date, CAST(high AS DOUBLE) AS temp_high, CAST(low AS DOUBLE) AS temp_low,
         coalesce(CAST(rainfall AS DOUBLE), 0.0) AS rainfall, code_day,
         {severity_sql('code_day')} AS weather_severity FROM weather),
wf AS (
  SELECT *, (temp_high + temp_low) / 2 AS temperature, temp_high - temp_low AS temp_range FROM wc),
wb AS (
  SELECT *,
    CASE WHEN temperature <= 0 THEN 'severe_cold' WHEN temperature <= 10 THEN 'cold' WHEN temperature <= 20 THEN 'cool'
         WHEN temperature <= 30 THEN 'warm' WHEN temperature IS NOT NULL THEN 'hot' END AS temp_band,
    CASE WHEN temp_range > -1 AND temp_range <= 5 THEN 'small' WHEN temp_range <= 10 THEN 'medium'
         WHEN temp_range <= 15 THEN 'large' WHEN temp_range > 15 THEN 'extreme' END AS range_band,
    coalesce(CAST(temperature < 10 OR temperature > 35 OR rainfall > 25 AS INT), 0) AS bad_weather
  FROM wf)"""


def clean_weather_for(dates):
    return FT.weather_bands(FT.clean_weather(weather_from_dates(dates)))


@register("weather_daily_features", "S2 P18 P19 P20 P21 W7", sql=with_(
    tx_cte(), dates_cte(), weather_cte(), WEATHER_CLEAN_SQL) + f"""
SELECT {out_sql(WEATHER_SPEC)} FROM (
  SELECT *, CAST(lpad(code_day, 2, '0') IN ('01') AS INT) AS is_sunny, CAST(lpad(code_day, 2, '0') IN ('02') AS INT) AS is_cloudy,
         CAST(lpad(code_day, 2, '0') IN ('04', '07', '08', '09', '10') AS INT) AS is_rainy,
         CAST(lpad(code_day, 2, '0') IN ('13', '14', '15', '16') AS INT) AS is_snowy,
         CAST(lpad(code_day, 2, '0') IN ('18') AS INT) AS is_foggy, CAST(lpad(code_day, 2, '0') IN ('53') AS INT) AS is_haze
  FROM wb)
""")
def q_weather_daily_features(spark, d):
    w = FT.weather_type_flags(clean_weather_for(fact_dates(spark, d)))
    return w.select(*out_cols(WEATHER_SPEC))


GAP_SPEC = "date:d was_high:i was_low:i temp_high:f temp_low:f temperature:f temp_range:f temp_band:s"
_FILL = ("coalesce(last_value({c} IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
         "first_value({c} IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))")
# a station that is silent on the first day and on two days in seven for the high, three in eleven for the low
_NO_HIGH, _NO_LOW = "date = first_day OR dayofyear(date) % 7 < 2", "date = first_day OR dayofyear(date) % 11 < 3"


@register("weather_gap_fill", "S2 P18 P21 W7", sql=with_(tx_cte(), dates_cte(), weather_cte()) + f"""
, gaps AS (SELECT date, CASE WHEN {_NO_HIGH} THEN '--' ELSE CAST(high AS VARCHAR) END AS high,
                  CASE WHEN {_NO_LOW} THEN NULL ELSE CAST(low AS VARCHAR) END AS low
           FROM weather, (SELECT min(date) AS first_day FROM weather)),
num AS (SELECT date, TRY_CAST(high AS DOUBLE) AS h, TRY_CAST(low AS DOUBLE) AS l FROM gaps),
fill AS (SELECT date, h, l, {_FILL.format(c='h')} AS temp_high, {_FILL.format(c='l')} AS temp_low FROM num)
SELECT {out_sql(GAP_SPEC)} FROM (
  SELECT *, CAST(h IS NOT NULL AS INT) AS was_high, CAST(l IS NOT NULL AS INT) AS was_low,
         CASE WHEN temperature <= 0 THEN 'severe_cold' WHEN temperature <= 10 THEN 'cold' WHEN temperature <= 20 THEN 'cool'
              WHEN temperature <= 30 THEN 'warm' WHEN temperature IS NOT NULL THEN 'hot' END AS temp_band
  FROM (SELECT *, (temp_high + temp_low) / 2 AS temperature, temp_high - temp_low AS temp_range FROM fill))
""")
def q_weather_gap_fill(spark, d):
    """Weather with silent days, unreadable and missing: filled from the day before, the first days from the next."""
    w = weather_from_dates(fact_dates(spark, d))
    gaps = w.join(F.broadcast(w.agg(F.min("date").alias("first_day"))), how="inner").select(
        "date", "code_day", "rainfall", F.expr(f"CASE WHEN {_NO_HIGH} THEN '--' ELSE CAST(high AS STRING) END").alias("high"),
        F.expr(f"CASE WHEN {_NO_LOW} THEN NULL ELSE CAST(low AS STRING) END").alias("low"))
    was = gaps.select("date", F.expr("CAST(try_cast(high AS DOUBLE) IS NOT NULL AS INT)").alias("was_high"),
                      F.col("low").isNotNull().cast("int").alias("was_low"))
    return FT.weather_bands(FT.clean_weather(gaps)).join(was, "date").select(*out_cols(GAP_SPEC))


_WEATHER_BODY = REGISTRY["weather_daily_features"].sql


@register("weather_hourly_feed", "P18 P19 P21", sql=_WEATHER_BODY.replace(dates_cte(), "dates AS (SELECT DISTINCT sale_date AS date FROM hx)").replace(tx_cte(), hx_cte()))
def q_weather_hourly_feed(spark, d):
    """The weather features of the hourly feed's days."""
    return FT.weather_type_flags(clean_weather_for(hourly_dates(spark, d))).select(*out_cols(WEATHER_SPEC))


def hourly_dates(spark, d):
    return hourly_transactions(spark, d).select(F.col("sale_date").alias("date")).distinct()


NEIGH_SPEC = "date:d is_holiday:i holiday_kind:s prev_day_holiday:i next_day_holiday:i holiday_streak:l"

CAL_FEATURE_SQL = """cc AS (SELECT date, coalesce(holiday_legal, 0) AS is_holiday,
                   CASE WHEN coalesce(holiday_legal, 0) = 1 THEN '法定节假日' ELSE '普通日' END AS holiday_kind FROM cal),
cn AS (SELECT *, coalesce(lag(is_holiday) OVER (ORDER BY date), 0) AS prev_day_holiday,
              coalesce(lead(is_holiday) OVER (ORDER BY date), 0) AS next_day_holiday,
              CASE WHEN lag(is_holiday) OVER (ORDER BY date) IS NULL
                     OR lag(is_holiday) OVER (ORDER BY date) <> is_holiday THEN 1 ELSE 0 END AS chg FROM cc),
ci AS (SELECT *, sum(chg) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM cn),
cs AS (SELECT date, is_holiday, holiday_kind, prev_day_holiday, next_day_holiday,
              CASE WHEN is_holiday = 1 THEN count(*) OVER (PARTITION BY island) ELSE 0 END AS holiday_streak FROM ci)"""


def calendar_features_for(dates):
    return FT.holiday_streak(FT.neighbour_holidays(FT.clean_calendar(calendar_from_dates(dates))))


@register("holiday_neighbours_streaks", "P22 W5 W6 J10", sql=with_(
    tx_cte(), dates_cte(), calendar_cte(), CAL_FEATURE_SQL) + f"SELECT {out_sql(NEIGH_SPEC)} FROM cs")
def q_holiday_neighbours_streaks(spark, d):
    return calendar_features_for(fact_dates(spark, d)).select(*out_cols(NEIGH_SPEC))


@register("holidays_hourly_feed", "P22 W5 W6", sql=with_(
    hx_cte(), "dates AS (SELECT DISTINCT sale_date AS date FROM hx)", calendar_cte(), CAL_FEATURE_SQL) + f"SELECT {out_sql(NEIGH_SPEC)} FROM cs")
def q_holidays_hourly_feed(spark, d):
    """Holiday flags and runs of the hourly feed's days."""
    return calendar_features_for(hourly_dates(spark, d)).select(*out_cols(NEIGH_SPEC))
