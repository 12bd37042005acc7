"""Feature engineering.

All window features share one ``WindowSpec`` per (key, order) so Spark plans a
single exchange + sort for every lag / rolling / trend column, and they run on
aggregated daily/slot rows (bounded by days x slots per key), never raw lines.
Weather and calendar are day-grain dimensions (bounded by distinct days) and
are broadcast to the fact rows.
"""

from __future__ import annotations

import math
from typing import Iterable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import col, season_code, season_label
from ..schema import (DAIRY_KEYWORDS, FRESH_CATEGORY_PREFIX, FRESH_KEYWORDS, PACK_SIZE_PATTERNS, PAYDAYS,
                      SHELF_LIFE_DAIRY, SHELF_LIFE_FRESH, SHELF_LIFE_OTHER, SHOPPING_DAYS, WEATHER_TYPE_CODES)
from ..sources.dims import severity_sql

TWO_PI = 2 * math.pi

# ---- time features ------------------------------------------------------------


def transaction_time_features(df: DataFrame, ts: str = "sale_ts", promo_start: int = 20,
                              promo_end: int = 22, month_end_day: int = 26) -> DataFrame:
    """P9 + P10: calendar parts of a till timestamp, day part, promo-hour flag,
    month end (day >= 26) / month start (day <= 5)."""
    t = F.col(ts)
    h = F.hour(t)
    return df.select(
        "*",
        F.year(t).alias("year"), F.month(t).alias("month"), F.dayofmonth(t).alias("day"),
        h.alias("hour"), F.minute(t).alias("minute"), F.weekday(t).alias("weekday"),
        (F.weekday(t) >= 5).cast("int").alias("is_weekend"),
        day_part_label(h).alias("day_part"),
        ((h >= promo_start) & (h < promo_end)).cast("int").alias("is_promo_hour"),
        F.quarter(t).alias("quarter"),
        (F.dayofmonth(t) >= month_end_day).cast("int").alias("is_month_end"),
        (F.dayofmonth(t) <= 5).cast("int").alias("is_month_start"),
    )


# Day-part labels for the bands [0,6) [6,9) [9,11) [11,14) [14,17) [17,20) [20,24).
DAY_PARTS = ["深夜", "早高峰", "上午", "中午", "下午", "晚高峰", "晚间"]
DAY_PART_EDGES = [6, 9, 11, 14, 17, 20]


def day_part_label(hour) -> F.Column:
    h = col(hour)
    e = F.when(h < DAY_PART_EDGES[0], DAY_PARTS[0])
    for edge, label in zip(DAY_PART_EDGES[1:], DAY_PARTS[1:-1]):
        e = e.when(h < edge, label)
    return e.otherwise(DAY_PARTS[-1])


def daily_time_features(df: DataFrame, date_col: str = "sale_date", month_end_day: int = 25) -> DataFrame:
    """P11 + P17: weekday (Mon=0), month, weekend, month end (>= 25), quarter, year, season."""
    d = F.col(date_col)
    return df.select(
        "*", F.weekday(d).alias("weekday"), F.month(d).alias("month"),
        (F.weekday(d) >= 5).cast("int").alias("is_weekend"),
        (F.dayofmonth(d) >= month_end_day).cast("int").alias("is_month_end"),
        F.quarter(d).alias("quarter"), F.year(d).alias("year"),
        season_label(F.month(d)).alias("season"), season_code(F.month(d)).alias("season_code"),
    )


def generic_time_features(df: DataFrame, ts: str = "sale_ts") -> DataFrame:
    """Year ... quarter plus the 20:00-22:00 clearance flag."""
    t = F.col(ts)
    return df.select("*", F.year(t).alias("year"), F.month(t).alias("month"), F.dayofmonth(t).alias("day"),
                     F.hour(t).alias("hour"), F.minute(t).alias("minute"), F.weekday(t).alias("day_of_week"),
                     (F.weekday(t) >= 5).cast("int").alias("is_weekend"), F.quarter(t).alias("quarter"),
                     ((F.hour(t) >= 20) & (F.hour(t) < 22)).cast("int").alias("is_clearance_time"))


def asof_base_features(df: DataFrame, ts: str = "as_of", promo_start: int = 20, promo_end: int = 22) -> DataFrame:
    """P13 + P14: base features at an as-of time: rush flags, month flags, hours to the
    promo start / end (forward, wrapping midnight), in-promo flag, duration, cyclic hour/day."""
    t = F.col(ts)
    h = F.hour(t)
    dow = F.weekday(t)
    return df.select(
        "*", F.year(t).alias("year"), h.alias("hour_of_day"), F.minute(t).alias("minute_of_hour"),
        dow.alias("day_of_week"), F.dayofmonth(t).alias("day_of_month"), F.month(t).alias("month"),
        (dow >= 5).cast("int").alias("weekend"), F.quarter(t).alias("quarter"),
        F.pmod(F.lit(promo_start) - h, F.lit(24)).alias("time_to_promo_start"),
        F.pmod(F.lit(promo_end) - h, F.lit(24)).alias("time_to_promo_end"),
        ((h >= promo_start) & (h < promo_end)).cast("int").alias("in_promotion_time"),
        F.lit((promo_end - promo_start) % 24).alias("promo_duration_hours"),
        F.sin(h * (TWO_PI / 24)).alias("hour_sin"), F.cos(h * (TWO_PI / 24)).alias("hour_cos"),
        F.sin(dow * (TWO_PI / 7)).alias("day_sin"), F.cos(dow * (TWO_PI / 7)).alias("day_cos"),
        ((h >= 7) & (h < 9)).cast("int").alias("is_morning_rush"),
        ((h >= 11) & (h < 13)).cast("int").alias("is_lunch_time"),
        ((h >= 17) & (h < 19)).cast("int").alias("is_evening_rush"),
        ((h >= 22) | (h < 6)).cast("int").alias("is_night"),
        (F.dayofmonth(t) >= 25).cast("int").alias("is_month_end"),
        (F.dayofmonth(t) <= 5).cast("int").alias("is_month_start"),
    )


def cyclic_features(df: DataFrame, ts: str = "sale_ts") -> DataFrame:
    """hour/24, weekday/7, month/12 sine and cosine."""
    t = F.col(ts)
    out = df
    for name, x, p in (("hour", F.hour(t), 24), ("day", F.weekday(t), 7), ("month", F.month(t), 12)):
        out = out.withColumn(f"{name}_sin", F.sin(x * (TWO_PI / p))).withColumn(f"{name}_cos", F.cos(x * (TWO_PI / p)))
    return out


def date_flags(df: DataFrame, d: str = "sale_date") -> DataFrame:
    """Month / quarter / year start and end flags, day of year, ISO week."""
    x = F.col(d)
    q_start = F.make_date(F.year(x), (F.quarter(x) - 1) * 3 + 1, F.lit(1))
    return df.select(
        "*", F.dayofyear(x).alias("dayofyear"), F.weekofyear(x).alias("weekofyear"),
        (F.dayofmonth(x) == 1).cast("int").alias("month_start"),
        (x == F.last_day(x)).cast("int").alias("month_end"),
        (x == q_start).cast("int").alias("quarter_start"),
        (x == F.date_sub(F.add_months(q_start, 3), 1)).cast("int").alias("quarter_end"),
        ((F.month(x) == 1) & (F.dayofmonth(x) == 1)).cast("int").alias("year_start"),
        ((F.month(x) == 12) & (F.dayofmonth(x) == 31)).cast("int").alias("year_end"),
    )


def timezone_shift(df: DataFrame, ts: str = "sale_ts", hours: int = 8, out: str = "local_ts") -> DataFrame:
    """Fixed-offset shift."""
    return df.withColumn(out, F.col(ts) + F.make_interval(hours=F.lit(hours)))


def time_to_close_hours(ts, close_hhmm: str) -> F.Column:
    """Hours from ts to the next occurrence of clock time ``close`` (>= 0)."""
    h, m = (int(x) for x in close_hhmm.split(":"))
    now_min = F.hour(ts) * 60 + F.minute(ts) + F.second(ts) / 60.0
    return F.pmod(F.lit(h * 60 + m) - now_min, F.lit(1440)) / 60.0


def duration_hours(start_hhmm: str, end_hhmm: str) -> float:
    """Window length in hours, wrapping midnight (equal ends = 24 h)."""
    sh, sm = (int(x) for x in start_hhmm.split(":"))
    eh, em = (int(x) for x in end_hhmm.split(":"))
    d = (eh * 60 + em) - (sh * 60 + sm)
    return (d if d > 0 else d + 1440) / 60.0


def decay_factor(ts, start_hhmm: str, end_hhmm: str, rate: float = 2.0) -> F.Column:
    """``1 + (1 - time_to_close / window_length) ** rate``."""
    total = duration_hours(start_hhmm, end_hhmm)
    return 1 + F.pow(1 - time_to_close_hours(ts, end_hhmm) / total, F.lit(rate))


# Store-type business hours (weekday, weekend, holiday) and peak windows.
BUSINESS_HOURS = {
    "supermarket": {"weekday": ("08:00", "22:00"), "weekend": ("08:00", "22:00"), "holiday": ("09:00", "21:00")},
    "convenience": {"weekday": ("07:00", "23:00"), "weekend": ("07:00", "23:00"), "holiday": ("08:00", "22:00")},
    "mall": {"weekday": ("10:00", "22:00"), "weekend": ("10:00", "22:00"), "holiday": ("10:00", "22:00")},
}
PEAK_HOURS = {
    "supermarket": [("08:00", "10:00"), ("12:00", "14:00"), ("17:00", "19:00"), ("20:00", "22:00")],
    "convenience": [("07:00", "09:00"), ("11:00", "13:00"), ("17:00", "19:00"), ("21:00", "23:00")],
}


def business_hour_labels(df: DataFrame, ts: str = "sale_ts", store_type: str = "supermarket",
                         holiday_col: str | None = None) -> DataFrame:
    """Open-hours and peak-hour flags for a store type (start <= hh:mm < end)."""
    hm = F.date_format(ts, "HH:mm")
    pat = BUSINESS_HOURS.get(store_type, BUSINESS_HOURS["supermarket"])
    weekend = F.weekday(ts) >= 5
    day_kind = F.when(weekend, "weekend").otherwise("weekday")
    if holiday_col:
        day_kind = F.when(F.col(holiday_col) == 1, "holiday").otherwise(day_kind)
    open_ = F.lit(False)
    for kind, (s, e) in pat.items():
        open_ = open_ | ((day_kind == kind) & (hm >= s) & (hm < e))
    peaks = PEAK_HOURS.get(store_type, PEAK_HOURS["supermarket"])
    peak = F.lit(False)
    for s, e in peaks:
        peak = peak | ((hm >= s) & (hm < e))
    return df.withColumn("is_business_hour", open_.cast("int")).withColumn("is_peak_hour", peak.cast("int"))


# ---- weather --------------------------------------------------------------------

def clean_weather(weather: DataFrame) -> DataFrame:
    """P18 + P19 + W7: coerce, mean temperature, range, severity; forward/backward fill.

    Weather is one row per day, so the fill window spans the dimension (bounded
    by the number of days), not fact rows.
    """
    w = weather.select(
        F.col("date"),
        F.expr("try_cast(high AS DOUBLE)").alias("temp_high"),
        F.expr("try_cast(low AS DOUBLE)").alias("temp_low"),
        F.expr("try_cast(rainfall AS DOUBLE)").alias("rainfall"),
        F.col("code_day"),
        F.expr(severity_sql("code_day")).alias("weather_severity"),
    )
    o = Window.orderBy("date")
    fwd, bwd = o.rowsBetween(Window.unboundedPreceding, 0), o.rowsBetween(0, Window.unboundedFollowing)
    for c in ("temp_high", "temp_low"):
        w = w.withColumn(c, F.coalesce(F.last(c, True).over(fwd), F.first(c, True).over(bwd)))
    return (w.withColumn("temperature", (F.col("temp_high") + F.col("temp_low")) / 2)
             .withColumn("temp_range", F.col("temp_high") - F.col("temp_low"))
             .withColumn("rainfall", F.coalesce("rainfall", F.lit(0.0))))


def weather_type_flags(df: DataFrame, code: str = "code_day") -> DataFrame:
    """P20: weather-type flags from the padded 2-digit code; missing weather -> defaults 0."""
    c = F.lpad(F.col(code), 2, "0")
    out = df
    for name, codes in WEATHER_TYPE_CODES.items():
        out = out.withColumn(name, F.coalesce(c.isin(*codes).cast("int"), F.lit(0)))
    return out


def weather_bands(df: DataFrame) -> DataFrame:
    """Temperature band (5, right-closed), range band (4), bad-weather flag."""
    t, r = F.col("temperature"), F.col("temp_range")
    tband = (F.when(t <= 0, "severe_cold").when(t <= 10, "cold").when(t <= 20, "cool")
             .when(t <= 30, "warm").when(t.isNotNull(), "hot"))
    rband = (F.when((r > -1) & (r <= 5), "small").when(r <= 10, "medium").when(r <= 15, "large")
             .when(r > 15, "extreme"))
    bad = ((t < 10) | (t > 35) | (F.col("rainfall") > 25)).cast("int")
    return df.withColumn("temp_band", tband).withColumn("range_band", rband) \
             .withColumn("bad_weather", F.coalesce(bad, F.lit(0)))


def join_weather(facts: DataFrame, weather: DataFrame, date_col: str = "sale_date",
                 columns: Sequence[str] | None = None) -> DataFrame:
    """Facts LEFT JOIN weather on date (broadcast: one row per day)."""
    w = weather.withColumnRenamed("date", date_col)
    if columns:
        w = w.select(date_col, *columns)
    return facts.join(F.broadcast(w), date_col, "left")


# ---- calendar -------------------------------------------------------------------

def clean_calendar(cal: DataFrame) -> DataFrame:
    """Holiday flag 0/1 (null -> 0) and type label."""
    h = F.coalesce(F.col("holiday_legal"), F.lit(0)).cast("int")
    return cal.select("date", h.alias("is_holiday"),
                      F.when(h == 1, "法定节假日").otherwise("普通日").alias("holiday_kind"))


def shopping_day(d) -> F.Column:
    """True on the fixed shopping festivals."""
    shop = F.lit(False)
    for m, day in SHOPPING_DAYS:
        shop = shop | ((F.month(d) == m) & (F.dayofmonth(d) == day))
    return shop


def holiday_impact(cal: DataFrame, date_col: str = "date") -> DataFrame:
    """0 no name; 4 type holiday; 3 recess; 2 shopping festival; else 1."""
    shop = shopping_day(F.col(date_col))
    name = F.col("holiday_name")
    score = (F.when(name.isNull() | (name == ""), 0).when(F.col("holiday_type") == "holiday", 4)
             .when(F.col("holiday_type") == "recess", 3).when(shop, 2).otherwise(1))
    return cal.withColumn("holiday_impact", score)


def calendar_features(df: DataFrame, date_col: str = "sale_date") -> DataFrame:
    """Shopping-day, payday flags, ISO week (holiday fields come from J2)."""
    d = F.col(date_col)
    return df.select("*", shopping_day(d).cast("int").alias("is_shopping_day"),
                     F.dayofmonth(d).isin(*PAYDAYS).cast("int").alias("is_payday"),
                     F.weekofyear(d).alias("week_of_year"))


def neighbour_holidays(cal: DataFrame, flag: str = "is_holiday") -> DataFrame:
    """Previous / next calendar day's holiday flag, on the distinct-date calendar."""
    o = Window.orderBy("date")
    return (cal.withColumn("prev_day_holiday", F.coalesce(F.lag(flag).over(o), F.lit(0)))
               .withColumn("next_day_holiday", F.coalesce(F.lead(flag).over(o), F.lit(0))))


def holiday_streak(cal: DataFrame, flag: str = "is_holiday") -> DataFrame:
    """Length of the run of consecutive holiday rows each holiday day belongs to (0 otherwise).

    Gaps and islands: a change flag, its running sum as island id, island size.
    Runs over the distinct-date calendar (bounded by days), then J10 joins back.
    """
    o = Window.orderBy("date")
    c = cal.withColumn("_chg", F.when(F.lag(flag).over(o).isNull() | (F.lag(flag).over(o) != F.col(flag)), 1)
                       .otherwise(0))
    c = c.withColumn("_island", F.sum("_chg").over(o.rowsBetween(Window.unboundedPreceding, 0)))
    size = F.count("*").over(Window.partitionBy("_island"))
    return c.withColumn("holiday_streak", F.when(F.col(flag) == 1, size).otherwise(0)).drop("_chg", "_island")


def join_calendar(facts: DataFrame, cal: DataFrame, date_col: str = "sale_date") -> DataFrame:
    """Facts LEFT JOIN calendar on date (broadcast: one row per day)."""
    return facts.join(F.broadcast(cal.withColumnRenamed("date", date_col)), date_col, "left")


# ---- product attributes -----------------------------------------------------------

def pack_size(name) -> F.Column:
    """Number of the first matching pack-size pattern (string, '' if none)."""
    n = col(name)
    e = F.lit("")
    for p in reversed(PACK_SIZE_PATTERNS):
        m = F.regexp_extract(n, p, 1)
        e = F.when(m != "", m).otherwise(e)
    return F.when(n.isNull(), F.lit("")).otherwise(e)


def product_attributes(df: DataFrame) -> DataFrame:
    """P26 + P27 + P28 + P29 + P30: categories, pack size, name length, fresh flag, shelf life."""
    cat = F.col("category_code")
    name = F.coalesce(F.col("product_name"), F.lit(""))
    fresh_kw = F.lit(False)
    for k in FRESH_KEYWORDS:
        fresh_kw = fresh_kw | name.contains(k)
    fresh = fresh_kw | F.coalesce(cat.startswith(FRESH_CATEGORY_PREFIX), F.lit(False))
    dairy = F.lit(False)
    for k in DAIRY_KEYWORDS:
        dairy = dairy | name.contains(k)
    size = pack_size(name)
    return df.select(
        "*",
        F.coalesce(F.substring(cat, 1, 2), F.lit("00")).alias("main_category"),
        F.coalesce(F.substring(cat, 1, 4), F.lit("0000")).alias("sub_category"),
        size.alias("pack_size"),
        F.coalesce(F.when(size != "", size.cast("double")), F.lit(0.0)).alias("pack_size_num"),
        F.length(name).alias("name_length"),
        fresh.cast("int").alias("is_fresh"),
        F.when(fresh & dairy, SHELF_LIFE_DAIRY).when(fresh, SHELF_LIFE_FRESH)
         .otherwise(SHELF_LIFE_OTHER).alias("shelf_life_hours"),
    )


# ---- windows over series -------------------------------------------------------------

def series_window(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def lag_features(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str = "qty",
                 lags: Iterable[int] = (1, 3, 7, 14, 30), prefix: str = "qty_lag") -> DataFrame:
    """W1 (row form): value k rows back within the key, null -> 0."""
    w = series_window(keys, order)
    return df.select("*", *[F.coalesce(F.lag(value, k).over(w), F.lit(0.0)).alias(f"{prefix}{k}") for k in lags])


def date_lag_features(df: DataFrame, keys: Sequence[str], date_col: str = "sale_date", value: str = "qty",
                      lags: Iterable[int] = (1, 7), prefix: str = "qty_dlag") -> DataFrame:
    """W1 (gap-aware form): value exactly k calendar days earlier (0 if that day had no row).

    An equi-join on (key, date - k): shuffles once per lag on the key, no range join.
    """
    keys = list(keys)
    out = df
    for k in lags:
        prev = df.select(*keys, F.date_add(F.col(date_col), k).alias(date_col), F.col(value).alias(f"{prefix}{k}"))
        out = out.join(prev, keys + [date_col], "left").withColumn(f"{prefix}{k}", F.coalesce(f"{prefix}{k}", F.lit(0.0)))
    return out


def rolling_features(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str = "qty",
                     windows: Iterable[int] = (7, 14, 30), stats: Sequence[str] = ("mean", "std"),
                     fill_zero: bool = False, prefix: str = "qty") -> DataFrame:
    """Rolling mean/std (/max/min) over the last n rows incl. current (min 1 row)."""
    base = series_window(keys, order)
    cols = []
    fns = {"mean": F.avg, "std": F.stddev_samp, "max": F.max, "min": F.min}
    for n in windows:
        w = base.rowsBetween(-(n - 1), 0)
        for s in stats:
            e = fns[s](value).over(w)
            cols.append((F.coalesce(e, F.lit(0.0)) if fill_zero else e).alias(f"{prefix}_{s}{n}"))
    return df.select("*", *cols)


def trend_features(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str = "qty",
                   prefix: str = "qty") -> DataFrame:
    """7-row change of the 7-row mean (pct_change(7), 0 if undefined) and the
    value 7 rows back (0 if none)."""
    w = series_window(keys, order)
    ma = F.avg(value).over(w.rowsBetween(-6, 0))
    d = df.withColumn("_ma7", ma)
    prev = F.lag("_ma7", 7).over(w)
    return (d.withColumn(f"{prefix}_trend7", F.coalesce(F.try_divide(F.col("_ma7"), prev) - 1, F.lit(0.0)))
             .withColumn(f"{prefix}_last_week", F.coalesce(F.lag(value, 7).over(w), F.lit(0.0)))
             .drop("_ma7"))


def centred_moving_average(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str = "qty",
                           window: int = 7, out: str = "qty_cma") -> DataFrame:
    """Centred rolling mean, min 1 row. Odd n: +-(n-1)/2; even n: -n/2 ... n/2-1."""
    lo, hi = (-(window - 1) // 2, (window - 1) // 2) if window % 2 else (-(window // 2), window // 2 - 1)
    return df.withColumn(out, F.avg(value).over(series_window(keys, order).rowsBetween(lo, hi)))


def centred_over_runs(runs: DataFrame, keys: Sequence[str], order: Sequence[str], value: str = "qty", most: int = 7,
                      share: int = 4, out: str = "qty_cma") -> DataFrame:
    """W9 over a grid's runs, made dense at the end: the mean of ``centred_moving_average`` with the window min(``most``, days / ``share``) of
    the key, null for a window below 2. Empty days hold 0, so a window's sum is that of the few rows near it, which lie
    beside the run; only runs are sorted, and their other columns hold for all their days."""
    own, every = series_window(keys, order), Window.partitionBy(*keys)
    day, at = F.unix_date(order[0]), F.unix_date
    reach = most // 2
    near = [f(c, k).over(own).alias(f"__{n}{c}{k}") for k in range(1, reach + 1) for n, f in (("b", F.lag), ("a", F.lead)) for c in (order[0], value)]
    d = runs.select("*", *near, at(F.min(order[0]).over(every)).alias("__d0"), at(F.max(order[0]).over(every)).alias("__d1"))
    d = d.withColumn("__w", F.least(F.lit(most), F.expr(f"cast((__d1 - __d0 + 1) div {share} as int)")))
    d = d.select("*", day.alias("__at"), F.explode(F.sequence(F.lit(0), F.col("run_days") - 1)).alias("__j"))
    u = F.col("__at") + F.col("__j")
    lo = F.greatest(u - F.expr("cast(__w div 2 as int)"), F.col("__d0"))
    hi = F.least(u + F.expr("cast((__w - 1) div 2 as int)"), F.col("__d1"))
    d = d.withColumns({"__lo": lo, "__hi": hi})
    pairs = [(F.col("__at"), F.col(value))] + [(at(f"__{n}{order[0]}{k}"), F.col(f"__{n}{value}{k}")) for k in range(1, reach + 1) for n in "ba"]
    inside = [F.when((a >= F.col("__lo")) & (a <= F.col("__hi")), v).otherwise(0.0) for a, v in pairs]
    mean = F.when(F.col("__w") >= 2, sum(inside[1:], inside[0]) / (F.col("__hi") - F.col("__lo") + 1))
    kept = [c for c in runs.columns if c not in (order[0], value, "run_days") and not c.startswith("fill_")]
    return d.select(*kept, F.date_add(order[0], F.col("__j")).alias(order[0]), F.when(F.col("__j") == 0, F.col(value)).otherwise(0.0).alias(value), mean.alias(out))


def cumulative(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str = "qty",
               out: str = "qty_cum") -> DataFrame:
    """Running total."""
    w = series_window(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(value).over(w))


def interaction_features(df: DataFrame, rate: str = "discount_rate", value: str = "qty") -> DataFrame:
    """P25: flag * qty / discount rate for weekend, month end and bad weather; 0 when rate = 0."""
    r, q = F.col(rate), F.col(value)

    def inter(flag):
        return F.when(r != 0, F.col(flag) * q / r).otherwise(F.lit(0.0))
    out = df.withColumn("promo_weekend", inter("is_weekend")).withColumn("promo_month_end", inter("is_month_end"))
    if "bad_weather" in df.columns:
        out = out.withColumn("weather_promo", inter("bad_weather"))
    return out


def slot_feature_vector(buckets: DataFrame, ts: str = "bucket_start", promo_start: int = 20,
                        promo_end: int = 22) -> DataFrame:
    """Demand-model features of a 30-minute bucket: clock parts, promo flag, hours
    to the promo end (>= 0), cyclic hour / weekday, rush flags, price, discount rate,
    discount flag and price ratio 1/d (1 when d <= 0)."""
    t = F.col(ts)
    h, dow = F.hour(t), F.weekday(t)
    d = F.coalesce(F.col("discount_rate"), F.lit(1.0))
    return buckets.select(
        "*", F.year(t).alias("year"), h.alias("hour"), F.minute(t).alias("minute"), dow.alias("day_of_week"),
        F.month(t).alias("month"), F.dayofmonth(t).alias("day_of_month"), (dow >= 5).cast("int").alias("weekend"),
        ((h >= promo_start) & (h < promo_end)).cast("int").alias("in_promotion"),
        F.greatest(F.lit(0.0), promo_end - h - F.minute(t) / 60.0).alias("time_to_promo_end"),
        F.sin(h * (TWO_PI / 24)).alias("hour_sin"), F.cos(h * (TWO_PI / 24)).alias("hour_cos"),
        F.sin(dow * (TWO_PI / 7)).alias("day_sin"), F.cos(dow * (TWO_PI / 7)).alias("day_cos"),
        ((h >= 7) & (h < 9)).cast("int").alias("is_morning_rush"), ((h >= 11) & (h < 13)).cast("int").alias("is_lunch_time"),
        ((h >= 17) & (h < 19)).cast("int").alias("is_evening_rush"), ((h >= 22) | (h < 6)).cast("int").alias("is_night"),
        F.coalesce(F.col("discounted_price"), F.lit(100.0)).alias("price"), d.alias("rate"),
        (d < 1).cast("int").alias("has_discount"),
        F.when(d > 0, 1.0 / d).otherwise(F.lit(1.0)).alias("price_ratio"))


# ---- J12: point-in-time rows ----------------------------------------------------------

def point_in_time(spine: DataFrame, groups: dict, keys: Sequence[str], as_of: str = "as_of") -> DataFrame:
    """Every row of ``spine`` (keys, as_of) with the last known values of each feature group at that time.

    ``groups``: {name: (frame, time column)}; a frame holds keys, its time and its own feature columns, any number of rows
    a key. All groups and the spine become one union, sorted once per key; the last struct of each group up to the
    spine row is its value (a later one is never seen; none gives nulls). Feature names must differ between groups."""
    keys = list(keys)
    union = spine.select(*keys, F.col(as_of).cast("timestamp").alias("__ts"), F.lit(1).alias("__spine"), as_of)
    columns = {}
    for name, (df, time) in groups.items():
        columns[name] = [c for c in df.columns if c not in keys and c != time]
        part = df.select(*keys, F.col(time).cast("timestamp").alias("__ts"), F.lit(0).alias("__spine"), F.struct(*columns[name]).alias(f"__{name}"))
        union = union.unionByName(part, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("__ts", "__spine").rowsBetween(Window.unboundedPreceding, 0)
    seen = union.select(*keys, as_of, "__spine", *[F.last(f"__{n}", ignorenulls=True).over(w).alias(f"__{n}") for n in groups])
    return seen.where("__spine = 1").select(*keys, as_of, *[F.col(f"__{n}.{c}").alias(c) for n, cs in columns.items() for c in cs])
