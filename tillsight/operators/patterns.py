"""Per-key sales patterns, elasticity and as-of history.

Each function answers for *all* keys in one pass: conditional aggregation
replaces the source system's repeated per-hour / per-weekday scans, per-key
scalars (look-back cut-offs, quantile edges, as-of times) are grouped
aggregates joined back on the key, and nested outputs are built only from
bounded groups (24 hours, 7 weekdays, <= 5 bins).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import rnd
from ..schema import WEATHER_TYPE_CODES
from ..session import cut_lineage
from .positions import numbered

KEYS = ("store_code", "product_code")


def _k(keys):
    return list(keys)


# ---- F8 -----------------------------------------------------------------------

def lookback(df: DataFrame, keys: Sequence[str] = KEYS, ts: str = "sale_ts", days: int = 90) -> DataFrame:
    """F8: rows within ``days`` of the key's own latest timestamp (never empty: the
    latest row always qualifies, so the source system's fallback to all rows is implied)."""
    keys = _k(keys)
    last = df.groupBy(*keys).agg(F.max(ts).alias("_last_ts"))
    return (df.join(last, keys, "inner")
              .where(F.col(ts) >= F.col("_last_ts") - F.make_interval(days=F.lit(days)))
              .drop("_last_ts"))


# ---- A19 / A20 / T4 --------------------------------------------------------------

def hourly_profile(df: DataFrame, keys: Sequence[str] = KEYS, ts: str = "sale_ts") -> DataFrame:
    """Per key and hour: mean qty, total, rows, mean discount rate."""
    return df.groupBy(*keys, F.hour(ts).alias("hour")).agg(
        F.avg("qty").alias("avg_sales"), F.sum("qty").alias("total_sales"),
        F.count("*").alias("transactions"), F.avg("discount_rate").alias("avg_discount"))


def weekday_profile(df: DataFrame, keys: Sequence[str] = KEYS, ts: str = "sale_ts") -> DataFrame:
    """Per key and weekday (Mon=0): mean qty, total, rows."""
    return df.groupBy(*keys, F.weekday(ts).alias("weekday")).agg(
        F.avg("qty").alias("avg_sales"), F.sum("qty").alias("total_sales"), F.count("*").alias("transactions"))


def nested_profile(profile: DataFrame, keys: Sequence[str], slot: str, out: str) -> DataFrame:
    """A26 nested form: ``map<slot, struct>`` per key (bounded: <= 24 or 7 entries)."""
    vals = [c for c in profile.columns if c not in set(keys) | {slot}]
    return profile.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col(slot), F.struct(*vals)))).alias(out))


def best_worst_hours(hourly: DataFrame, keys: Sequence[str] = KEYS, n: int = 3) -> DataFrame:
    """T4: best and worst ``n`` hours by mean sales (hour breaks ties) as comma lists.

    Defaults when a key has no hourly rows: best "20,21", worst "2,3,4" (applied by
    the caller through ``coalesce`` after a left join).
    """
    keys = _k(keys)
    wb = Window.partitionBy(*keys).orderBy(F.desc("avg_sales"), F.asc("hour"))
    ww = Window.partitionBy(*keys).orderBy(F.asc("avg_sales"), F.asc("hour"))
    h = hourly.select(*keys, "hour", "avg_sales", F.row_number().over(wb).alias("_b"), F.row_number().over(ww).alias("_w"))

    def ordered(flag):
        s = F.array_sort(F.collect_list(F.when(F.col(flag) <= n, F.struct(F.col(flag), F.col("hour")))))
        return F.array_join(F.transform(s, lambda x: x["hour"].cast("string")), ",")
    return h.groupBy(*keys).agg(ordered("_b").alias("best_hours"), ordered("_w").alias("worst_hours"))


# ---- A21 / F12 --------------------------------------------------------------------

def promo_hours_performance(df: DataFrame, keys: Sequence[str] = KEYS, ts: str = "sale_ts",
                            start: int = 20, end: int = 22) -> DataFrame:
    """Promo-window vs other hours in one pass (conditional aggregation).

    promo_ratio = sum(promo qty) / sum(other qty), 1.0 if that sum <= 0; all three
    fields are null when either side has no rows."""
    return df.groupBy(*keys).agg(*_promo_sums(ts, start, end)).select(*keys, *_promo_fields())


def _promo_sums(ts: str, start: int, end: int) -> list:
    h = F.hour(ts)
    promo = (h >= start) & (h < end)
    return [F.avg(F.when(promo, F.col("qty"))).alias("_pa"), F.avg(F.when(~promo, F.col("qty"))).alias("_na"),
            F.sum(F.when(promo, F.col("qty"))).alias("_ps"), F.sum(F.when(~promo, F.col("qty"))).alias("_ns"),
            F.count_if(promo).alias("_pc"), F.count_if(~promo).alias("_nc")]


def _promo_fields() -> list:
    both = (F.col("_pc") > 0) & (F.col("_nc") > 0)
    return [F.when(both, F.col("_pa")).alias("promo_avg_sales"),
            F.when(both, F.col("_na")).alias("non_promo_avg_sales"),
            F.when(both, F.when(F.col("_ns") > 0, F.col("_ps") / F.col("_ns")).otherwise(1.0)).alias("promo_ratio")]


# ---- A22 / W17 ----------------------------------------------------------------------

def price_elasticity(df: DataFrame, keys: Sequence[str] = KEYS, rate: str = "discount_rate", qty: str = "qty",
                     bins: int = 5, min_rows: int = 10, default: float = 1.2, out: str = "price_elasticity") -> DataFrame:
    """A22 + W17: elasticity over quantile bins of the realised discount rate.

    Edges are exact per-key quantiles (``percentile``: interpolating, map-side
    combined) with duplicates dropped; bins are right-closed with the lowest edge
    included (pandas ``qcut(duplicates='drop')``). Per bin: mean rate r, total qty q;
    consecutive bins give |((q_i - q_{i-1}) / max(q_{i-1}, 1)) / ((r_i - r_{i-1}) / r_{i-1})|,
    zero price changes skipped; the key's value is their mean, else ``default``
    (also for fewer than ``min_rows`` rows or fewer than 2 bins)."""
    keys = _k(keys)
    probs = F.array(*[F.lit(i / bins) for i in range(bins + 1)])
    # Rates are compared at 1e-6 resolution so bin membership never hinges on float noise.
    d = df.where(F.col(rate).isNotNull()).withColumn(rate, rnd(rate, 6))
    edges = d.groupBy(*keys).agg(F.array_distinct(F.percentile(rate, probs)).alias("_edges"),
                                 F.count("*").alias("_n"))
    j = d.join(edges.where(F.size("_edges") >= 2), keys, "inner")
    inner = F.slice("_edges", 2, F.size("_edges") - 2)
    j = j.withColumn("_bin", F.size(F.filter(inner, lambda e: e < F.col(rate))))
    b = j.groupBy(*keys, "_bin").agg(F.avg(rate).alias("_r"), F.sum(qty).alias("_q"))
    w = Window.partitionBy(*keys).orderBy("_bin")
    pr, pq = F.lag("_r").over(w), F.lag("_q").over(w)
    b = b.withColumn("_pc", F.try_divide(F.col("_r") - pr, pr)) \
         .withColumn("_qc", (F.col("_q") - pq) / F.greatest(pq, F.lit(1.0)))
    e = b.where(F.col("_pc").isNotNull() & (F.col("_pc") != 0)) \
         .groupBy(*keys).agg(F.avg(F.abs(F.col("_qc") / F.col("_pc"))).alias("_e"))
    res = edges.join(e, keys, "left")
    value = F.when(F.col("_n") >= min_rows, F.coalesce("_e", F.lit(default))).otherwise(F.lit(default))
    return res.select(*keys, value.alias(out))


# ---- A23 / A24 -----------------------------------------------------------------------

def weather_impact(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean qty per row on rainy vs sunny days and hot (high >= 30) vs mild
    (20 <= high < 30) days; 1.0 unless both sides have rows and the base is > 0.
    Expects ``code_day`` and ``high`` from the weather join."""
    return df.groupBy(*keys).agg(*_weather_fields())


def _mean_ratio(a, b):
    ma, mb = F.avg(F.when(a, F.col("qty"))), F.avg(F.when(b, F.col("qty")))
    return F.coalesce(F.when(mb > 0, ma / mb), F.lit(1.0))


def _weather_fields() -> list:
    code = F.lpad(F.col("code_day"), 2, "0")
    rainy = code.isin(*WEATHER_TYPE_CODES["is_rainy"])
    sunny = code == "01"
    hot = F.col("high") >= 30
    mild = (F.col("high") >= 20) & (F.col("high") < 30)
    return [_mean_ratio(rainy, sunny).alias("rain_impact"), _mean_ratio(hot, mild).alias("hot_impact"),
            F.lit(1.0).alias("cold_impact")]


def holiday_impact_ratios(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Holiday vs non-holiday and weekend vs workday mean qty per row
    (uses ``holiday_legal`` and ``weekend`` from the calendar join); defaults 1.0."""
    return df.groupBy(*keys).agg(*_holiday_fields())


def _holiday_fields() -> list:
    hol = F.col("holiday_legal") == 1
    wkd = F.col("weekend") == 1
    return [_mean_ratio(hol, ~hol).alias("holiday_boost"), _mean_ratio(wkd, ~wkd).alias("weekend_boost")]


# ---- A25 ---------------------------------------------------------------------------------

def sales_trend(df: DataFrame, keys: Sequence[str] = KEYS, date_col: str = "sale_date", min_rows: int = 14) -> DataFrame:
    """(last 7 daily totals - previous 7) / previous 7, 0 when the previous total
    is <= 0, or with fewer than 14 rows or 14 sale days."""
    keys = _k(keys)
    daily = df.groupBy(*keys, date_col).agg(F.sum("qty").alias("_q"), F.count("*").alias("_rows"))
    w = Window.partitionBy(*keys).orderBy(F.desc(date_col))
    d = daily.withColumn("_rn", F.row_number().over(w))
    g = d.groupBy(*keys).agg(F.sum(F.when(F.col("_rn") <= 7, F.col("_q"))).alias("_r7"),
                             F.sum(F.when((F.col("_rn") > 7) & (F.col("_rn") <= 14), F.col("_q"))).alias("_p7"),
                             F.count("*").alias("_days"), F.sum("_rows").alias("_rows"))
    ok = (F.col("_rows") >= min_rows) & (F.col("_days") >= 14) & (F.col("_p7") > 0)
    return g.select(*keys, F.when(ok, (F.col("_r7") - F.col("_p7")) / F.col("_p7")).otherwise(F.lit(0.0)).alias("sales_trend"))


# ---- A26 / A27 ---------------------------------------------------------------------------

def sales_pattern(rows: DataFrame, keys: Sequence[str] = KEYS, lookback_days: int = 90,
                  promo: tuple = (20, 22)) -> DataFrame:
    """A26 (flattened): one record per key from the look-back rows (F8).

    ``rows`` must carry sale_ts, sale_date, qty, gross_amount, avg_price,
    discount_rate, is_promo, code_day, high (J1) and holiday_legal, weekend (J2).
    """
    keys = _k(keys)
    r = lookback(rows, keys, days=lookback_days)
    # what needs only sums of a key's rows is one aggregate: a sort and hash table for each would lie side by side in a task
    out = r.groupBy(*keys).agg(F.sum("qty").alias("total_sales"), F.sum("gross_amount").alias("total_revenue"),
                               F.avg("avg_price").alias("avg_price"), F.avg("discount_rate").alias("avg_discount"),
                               F.avg("is_promo").alias("discount_frequency"), *_promo_sums("sale_ts", *promo),
                               *_weather_fields(), *_holiday_fields())
    impacts = ["rain_impact", "hot_impact", "cold_impact", "holiday_boost", "weekend_boost"]
    out = out.select(*keys, "total_sales", "total_revenue", "avg_price", "avg_discount", "discount_frequency", *_promo_fields(), *impacts)
    for p in (price_elasticity(r, keys), sales_trend(r, keys), best_worst_hours(hourly_profile(r, keys), keys)):
        out = out.join(p, keys, "left")
    out = out.select(*[c for c in out.columns if c not in (*impacts, "price_elasticity", "sales_trend", "best_hours", "worst_hours")],
                     "price_elasticity", *impacts, "sales_trend", "best_hours", "worst_hours")
    return (out.withColumn("price_elasticity", F.coalesce("price_elasticity", F.lit(1.2)))
               .withColumn("best_hours", F.coalesce("best_hours", F.lit(",".join(str(h) for h in range(*promo)))))
               .withColumn("worst_hours", F.coalesce("worst_hours", F.lit("2,3,4"))))


def nested_sales_pattern(rows: DataFrame, keys: Sequence[str] = KEYS, lookback_days: int = 90, promo: tuple = (20, 22)) -> DataFrame:
    """A26 as a nested record per key: ``hourly_pattern`` map<hour, struct> and ``weekday_pattern`` map<weekday, struct> beside
    the scalar fields, with the promo, weather and holiday fields as structs."""
    keys = _k(keys)
    r = lookback(rows, keys, days=lookback_days)
    hours = nested_profile(hourly_profile(r, keys), keys, "hour", "hourly_pattern")
    days = nested_profile(weekday_profile(r, keys), keys, "weekday", "weekday_pattern")
    flat = sales_pattern(rows, keys, lookback_days, promo)
    groups = {"promo_performance": ["promo_avg_sales", "non_promo_avg_sales", "promo_ratio"],
              "weather_impact": ["rain_impact", "hot_impact", "cold_impact"], "holiday_impact": ["holiday_boost", "weekend_boost"]}
    inner = {c for cols in groups.values() for c in cols}
    out = flat.join(hours, keys, "left").join(days, keys, "left")
    return out.select(*[c for c in out.columns if c not in inner], *[F.struct(*cols).alias(name) for name, cols in groups.items()])


def product_summary(rows: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Totals over all rows + the look-back pattern's sensitivity fields."""
    keys = _k(keys)
    tot = rows.groupBy(*keys).agg(
        F.sum("qty").alias("total_qty"), F.sum("gross_amount").alias("total_revenue"),
        F.sum("net_amount").alias("_net"), F.avg("discount_rate").alias("avg_discount"),
        F.stddev_samp("discount_rate").alias("discount_std"))
    tot = tot.withColumn("avg_price", F.when((F.col("_net") != 0) & (F.col("total_qty") != 0),
                                             F.col("_net") / F.col("total_qty")).otherwise(F.lit(0.0))).drop("_net")
    pat = sales_pattern(rows, keys).select(*keys, "discount_frequency", "price_elasticity",
                                           F.coalesce("promo_ratio", F.lit(1.2)).alias("promo_sensitivity"),
                                           "best_hours", "worst_hours", "rain_impact", "hot_impact",
                                           "holiday_boost", "weekend_boost")
    trend = sales_trend(rows, keys)
    return tot.join(trend, keys, "left").join(pat, keys, "left")


# ---- A28 / F13: as-of history ---------------------------------------------------------

def asof_history(rows: DataFrame, asof: DataFrame, keys: Sequence[str] = KEYS, ts: str = "sale_ts",
                 promo: tuple = (20, 22)) -> DataFrame:
    """A28 + F13: history features of each key at its as-of time (``asof``: keys, as_of).

    One conditional aggregation relative to ``as_of`` (rows joined to their key's
    as-of on the key):
      hist mean/std over [as_of - 30 d, ...) (all rows if none), promo ratio
      mean(promo)/max(mean(other), 0.1) (1.2 if a side is empty), week trend
      (S[-7d, now) - S[-14d, -7d)) / max(S[-14d, -7d), 1) (0 if a side is empty),
      last week [as_of - 8 d, as_of - 7 d), recent 3 h [as_of - 3 h, ...)."""
    keys = _k(keys)
    r = rows.join(asof, keys, "inner")
    t, a = F.col(ts), F.col("as_of")

    def ago(days=0, hours=0):
        return a - F.make_interval(days=F.lit(days), hours=F.lit(hours))
    h = F.hour(t)
    is_promo = (h >= promo[0]) & (h < promo[1])
    recent = t >= ago(30)
    wk = (t >= ago(7)) & (t < a)
    pwk = (t >= ago(14)) & (t < ago(7))
    q = F.col("qty")
    g = r.groupBy(*keys, "as_of").agg(
        F.avg(F.when(recent, q)).alias("_rm"), F.stddev_samp(F.when(recent, q)).alias("_rs"),
        F.count_if(recent).alias("_rn"), F.avg(q).alias("_am"), F.stddev_samp(q).alias("_as"),
        F.avg(F.when(is_promo, q)).alias("_pm"), F.avg(F.when(~is_promo, q)).alias("_nm"),
        F.sum(F.when(wk, q)).alias("_w"), F.sum(F.when(pwk, q)).alias("_pw"),
        F.coalesce(F.sum(F.when((t >= ago(8)) & (t < ago(7)), q)), F.lit(0.0)).alias("last_week_sales"),
        F.coalesce(F.sum(F.when(t >= ago(hours=3), q)), F.lit(0.0)).alias("recent_3h_sales"))
    rn = F.col("_rn") > 0
    return g.select(
        *keys, "as_of",
        F.when(rn, F.col("_rm")).otherwise(F.col("_am")).alias("hist_avg_sales"),
        F.when(rn, F.col("_rs")).otherwise(F.col("_as")).alias("hist_sales_std"),
        F.coalesce(F.col("_pm") / F.greatest(F.col("_nm"), F.lit(0.1)), F.lit(1.2)).alias("hist_promo_sales_ratio"),
        F.coalesce((F.col("_w") - F.col("_pw")) / F.greatest(F.col("_pw"), F.lit(1.0)), F.lit(0.0)).alias("sales_trend"),
        "last_week_sales", "recent_3h_sales")


def latest_asof(rows: DataFrame, keys: Sequence[str] = KEYS, ts: str = "sale_ts") -> DataFrame:
    """As-of = each key's latest till time (a grouped max)."""
    return rows.groupBy(*keys).agg(F.max(ts).alias("as_of"))


# ---- A29 ------------------------------------------------------------------------------

def price_features(rows: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """List-price and discount statistics, 4-bin elasticity (>= 20 rows), discount frequency."""
    keys = _k(keys)
    g = rows.groupBy(*keys).agg(
        F.avg("list_price").alias("avg_price"), F.stddev_samp("list_price").alias("price_std"),
        F.min("list_price").alias("min_price"), F.max("list_price").alias("max_price"),
        F.median("list_price").alias("median_price"), F.avg("discount_rate").alias("avg_discount"),
        F.stddev_samp("discount_rate").alias("discount_std"), F.min("discount_rate").alias("min_discount"),
        F.max("discount_rate").alias("max_discount"), F.avg("is_promo").alias("discount_frequency"))
    el = price_elasticity(rows, keys, bins=4, min_rows=20)
    return g.join(el, keys, "left").withColumn("price_elasticity", F.coalesce("price_elasticity", F.lit(1.2)))


# ---- A30 ------------------------------------------------------------------------------

def store_features(tx: DataFrame) -> DataFrame:
    """Per (store, product): share of the product's stores selling more
    (``rank() - 1`` over stores / number of stores), traffic min(n/100, 2),
    conversion min(n/500, 1), mean ticket. The window runs over per-store
    aggregates of one product (bounded by its number of stores)."""
    g = tx.groupBy("store_code", "product_code").agg(F.sum("qty").alias("_q"), F.count("*").alias("_n"),
                                                     F.avg("gross_amount").alias("store_avg_transaction"))
    w = Window.partitionBy("product_code")
    rank = F.rank().over(w.orderBy(F.desc("_q"))) - 1
    return g.select("store_code", "product_code", (rank / F.count("*").over(w)).alias("store_sales_rank"),
                    F.least(F.col("_n") / 100, F.lit(2.0)).alias("store_traffic_index"),
                    F.least(F.col("_n") / 500, F.lit(1.0)).alias("store_conversion_rate"),
                    "store_avg_transaction")


# ---- A31 ------------------------------------------------------------------------------

def sales_rate_profile(slots: DataFrame, keys: Sequence[str] = KEYS, start_hour: int = 20, end_hour: int = 22,
                       hour_col: str = "hour") -> DataFrame:
    """Slot-quantity mean / max / min in the promo hours, confidence min(0.9, n/100);
    a key without promo-hour rows gets 5 / 10 / 2 and confidence 0."""
    inw = (F.col(hour_col) >= start_hour) & (F.col(hour_col) < end_hour)
    q = F.when(inw, F.col("qty"))
    g = slots.groupBy(*keys).agg(F.avg(q).alias("_a"), F.max(q).alias("_x"), F.min(q).alias("_m"),
                                 F.count_if(inw).alias("_n"))
    return g.select(*keys, F.coalesce("_a", F.lit(5.0)).alias("avg_rate"), F.coalesce("_x", F.lit(10.0)).alias("peak_rate"),
                    F.coalesce("_m", F.lit(2.0)).alias("low_rate"),
                    F.least(F.lit(0.9), F.col("_n") / 100).alias("confidence"))


# ---- A32 ------------------------------------------------------------------------------

def stage_hours(spark, promotion_start: str, promotion_end: str, time_segments: int) -> DataFrame:
    """(stage, hour) pairs: stage i covers int(s + i*h) ... int(s + (i+1)*h) inclusive."""
    s, e = int(promotion_start.split(":")[0]), int(promotion_end.split(":")[0])
    total = (e - s) if e > s else (24 - s + e)
    h = total / time_segments
    pairs = [(i, hr, int(s + (i + 1) * h) - int(s + i * h) + 1)
             for i in range(time_segments) for hr in range(int(s + i * h), int(s + (i + 1) * h) + 1)]
    return spark.createDataFrame(pairs, "stage int, hour int, n_hours int")


def stage_baseline(rows: DataFrame, keys: Sequence[str] = ("product_code",), promotion_start: str = "20:00",
                   promotion_end: str = "22:00", time_segments: int = 4, ts: str = "sale_ts",
                   date_col: str = "sale_date") -> DataFrame:
    """Baseline units per hour for each promo stage of every key.

    rate = qty in the stage's hours / days in the data's date span / hours in the
    stage; <= 0 -> 0.5. Hours are matched by an equi-join on hour against the
    (stage, hour) table (a few rows, broadcast), so no range join reaches fact size.
    Note: hour values are taken mod 24 of the clock (a 22:00-02:00 window uses 22..24,
    as the source did: hour 24 never matches)."""
    keys = _k(keys)
    sh = stage_hours(rows.sparkSession, promotion_start, promotion_end, time_segments)
    span = rows.agg((F.datediff(F.max(date_col), F.min(date_col)) + 1).alias("_days"))
    hit = rows.select(*keys, F.hour(ts).alias("hour"), "qty").join(F.broadcast(sh), "hour", "inner")
    g = hit.groupBy(*keys, "stage").agg(F.sum("qty").alias("_q"))
    nh = sh.groupBy("stage").agg(F.first("n_hours").alias("n_hours"))
    spine = rows.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.lit(time_segments - 1))).alias("stage"))
    j = (spine.join(g, keys + ["stage"], "left").join(F.broadcast(nh), "stage")
              .join(F.broadcast(span), how="inner"))   # one-row build side
    rate = F.coalesce(F.col("_q"), F.lit(0.0)) / F.col("_days") / F.col("n_hours")
    return j.select(*keys, "stage", F.when(rate > 0, rate).otherwise(F.lit(0.5)).alias("base_rate"))


# ---- A37 / A38 ------------------------------------------------------------------------

def cost_estimate(rows: DataFrame, keys: Sequence[str] = ("product_code",)) -> DataFrame:
    """30 % of the mean discounted price, clipped to [10 %, 90 %] of it."""
    g = rows.groupBy(*keys).agg(F.avg(F.col("list_price") * F.col("discount_rate")).alias("_m"))
    c = F.least(F.greatest(F.col("_m") * 0.3, F.col("_m") * 0.1), F.col("_m") * 0.9)
    return g.select(*keys, c.alias("cost_price"))


# Cost as a share of the list price by category prefix, and for all other categories.
CATEGORY_COST_RATES = {"20": 0.4, "30": 0.3, "40": 0.2}
OTHER_COST_RATE = 0.25


def cost_estimate_any(rows: DataFrame, keys: Sequence[str] = ("product_code",)) -> DataFrame:
    """A37 with its fallbacks, and which of them applied (``cost_method``): keys with a discounted row by ``cost_estimate``
    ("discounted_price"); others by the share of the mean list price that their category prefix names
    ("category_rate"); without category or price 0 ("none"). One grouped pass."""
    m, p, category = F.col("_m"), F.col("_p"), F.col("_category")
    g = rows.groupBy(*keys).agg(F.avg(F.col("list_price") * F.col("discount_rate")).alias("_m"), F.avg("list_price").alias("_p"),
                                F.max("is_promo").alias("_promo"), F.min("category_code").alias("_category"))
    share = F.lit(OTHER_COST_RATE)
    for prefix, rate in CATEGORY_COST_RATES.items():
        share = F.when(category.startswith(prefix), rate).otherwise(share)
    discounted, known = (F.col("_promo") == 1) & m.isNotNull(), category.isNotNull() & p.isNotNull()
    cost = F.when(discounted, F.least(F.greatest(m * 0.3, m * 0.1), m * 0.9)).when(known, p * share).otherwise(0.0)
    method = F.when(discounted, "discounted_price").when(known, "category_rate").otherwise("none")
    return g.select(*keys, cost.alias("cost_price"), method.alias("cost_method"))


def product_master(rows: DataFrame, keys: Sequence[str] = ("product_code",)) -> DataFrame:
    """Latest row's attributes (W14) + estimated cost (A37) + 4-bin elasticity."""
    from .features import product_attributes
    keys = _k(keys)
    order = F.struct("sale_date", "order_id", "line_no")
    latest = rows.groupBy(*keys).agg(
        F.max_by("list_price", order).alias("base_price"), F.max_by("category_code", order).alias("category_code"),
        F.max_by("product_name", order).alias("product_name"), F.count("*").alias("n_rows"),
        F.count_distinct("sale_date").alias("n_days"), F.avg("qty").alias("avg_qty"))
    attrs = product_attributes(latest).select(*keys, "base_price", "category_code", "product_name", "n_rows",
                                              "n_days", "avg_qty", "is_fresh", "shelf_life_hours")
    el = price_elasticity(rows.withColumn("store_code", F.lit("*")), ["store_code"] + keys, bins=4, min_rows=20).drop("store_code")
    return attrs.join(cost_estimate(rows, keys), keys, "left").join(el, keys, "left")


# ---- A39 / A40 ------------------------------------------------------------------------

def similar_products(products: DataFrame, k: int = 3, group: str = "category_code", price: str = "avg_price",
                     key: str = "product_code", block: int = 10_000) -> DataFrame:
    """The k products of the same category nearest in price.

    Order: price distance, then distance in the category's (price, code) order,
    then code. Under that order the k nearest always lie within k positions on
    either side (everything between is at least as close in both), so the
    candidates come from ``lag``/``lead`` over the sorted products (2k per
    product), never from all pairs of the category. The sorted products are cut into
    blocks of ``block`` positions, whatever their category, and the k rows next to a
    border go to both blocks; no window holds a category."""
    block = max(block, k)
    at = numbered(products.select(key, group, price), group, price, key, name="__at")
    own, place = F.floor(F.col("__at") / block), F.col("__at") % block
    halo = F.array_compact(F.array(own, F.when(place < k, own - 1), F.when(place >= block - k, own + 1)))
    blocks = at.select("*", own.alias("__own"), F.explode(halo).alias("__block"))
    w = Window.partitionBy("__block").orderBy("__at")
    wins, cands = [], []
    for off in range(1, k + 1):
        for name, fn in (("b", F.lag), ("a", F.lead)):
            same = fn(F.struct(group), off).over(w) == F.struct(group)     # fields of structs are equal where both are null
            wins += [F.when(same, fn(key, off).over(w)).alias(f"_{name}{off}"), F.when(same, fn(price, off).over(w)).alias(f"_{name}{off}p")]
            cands.append(F.struct(F.col(f"_{name}{off}").alias("other"), F.col(f"_{name}{off}p").alias("other_price"),
                                  F.lit(off).alias("pos")))
    x = (blocks.select(key, group, price, "__own", "__block", *wins).where(F.col("__own") == F.col("__block"))
               .select(key, group, price, F.explode(F.array(*cands)).alias("c")).where(F.col("c.other").isNotNull()))
    x = x.select(key, group, price, "c.other", "c.other_price", "c.pos",
                 F.abs(F.col("c.other_price") - F.col(price)).alias("distance"))
    r = F.row_number().over(Window.partitionBy(key).orderBy("distance", "pos", "other"))
    return x.withColumn("rank", r).where(F.col("rank") <= k)


def cold_start_forecast(products: DataFrame, similar: DataFrame, key: str = "product_code",
                        group: str = "category_code", value: str = "avg_daily_qty") -> DataFrame:
    """Category forecast (mean of the category's products) x mean adjustment of
    the similar products (their value / category forecast); category forecast alone
    when no similar product exists."""
    cat = products.groupBy(group).agg(F.avg(value).alias("category_forecast"))
    adj = (similar.join(products.select(F.col(key).alias("other"), F.col(value).alias("_ov")), "other")
                  .join(cat, group).withColumn("_adj", F.try_divide(F.col("_ov"), F.col("category_forecast")))
                  .groupBy(key).agg(F.avg("_adj").alias("adjustment")))
    return (products.select(key, group).join(cat, group).join(adj, key, "left")
                    .withColumn("forecast", F.col("category_forecast") * F.coalesce("adjustment", F.lit(1.0))))


# ---- A41 / M14 ------------------------------------------------------------------------

def future_regressor(daily: DataFrame, keys: Sequence[str] = ("product_code",), value: str = "list_price",
                     date_col: str = "sale_date", horizon: int = 7, last: str | None = None,
                     fill: str | None = None) -> DataFrame:
    """A41 + M14: regressor values for the next ``horizon`` days of every key.

    ``last`` names the column with the key's last date in gap-free rows, whose last 7 rows are then its last 7 days
    and need no order. The rows are read once, into sums by weekday. ``fill`` names the column with the value of a key's
    empty days where the rows are runs of a grid (``daily_grid``): those days are counted, not made.

    Default: mean of the last 7 rows; with >= 14 rows and a weekday pattern whose
    std exceeds 0.3 x its mean, the weekday mean (last-7 mean for a weekday never
    seen). The weekday profile has <= 7 rows per key."""
    keys = _k(keys)
    if fill:
        return _future_days(cut_lineage(_weekdays_of_runs(daily, keys, value, date_col, last, fill)), keys, value, horizon)
    if last:
        d = daily.withColumn("_recent", F.col(date_col) > F.date_sub(last, 7))
    else:
        d = daily.withColumn("_recent", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(date_col))) <= 7)
    recent = F.when(F.col("_recent"), F.col(value))
    wd = cut_lineage(d.groupBy(*keys, F.weekday(date_col).alias("weekday")).agg(
        F.avg(value).alias("_wm"), F.sum(recent).alias("_rs"), F.count(recent).alias("_rc"), F.count("*").alias("_k"),
        F.max(date_col).alias("_m")))
    return _future_days(wd, keys, value, horizon)


def _weekdays_of_runs(runs: DataFrame, keys: list, value: str, date_col: str, last: str, fill: str) -> DataFrame:
    """Sums by weekday of ``future_regressor`` over a grid's runs: what the rows hold, and ``fill`` on each other day
    from the key's first to its last."""
    at, v, new = F.weekday(date_col), F.col(value), F.col(date_col) > F.date_sub(last, 7)
    ends = runs.groupBy(*keys).agg(
        F.min(date_col).alias("_a"), F.max(date_col).alias("_m"), F.first(fill).alias("_f"),
        *[x for w in range(7) for x in (F.coalesce(F.sum(F.when(at == w, v)), F.lit(0.0)).alias(f"_s{w}"), F.count_if(at == w).alias(f"_c{w}"))],
        F.coalesce(F.sum(F.when(new, v)), F.lit(0.0)).alias("_sn"), F.count_if(new).alias("_cn"))
    n = F.datediff("_m", "_a") + 1
    days = [F.floor((n + 6 - F.pmod(F.lit(w) - F.weekday("_a"), F.lit(7))) / 7) for w in range(7)]
    newest = F.least(n, F.lit(7))
    known = F.col("_sn") + F.col("_f") * (newest - F.col("_cn"))
    rows = F.array(*[F.struct(
        F.lit(w).alias("weekday"), ((F.col(f"_s{w}") + F.col("_f") * (days[w] - F.col(f"_c{w}"))) / F.when(days[w] > 0, days[w])).alias("_wm"),
        F.when(F.weekday("_m") == w, known).alias("_rs"), F.when((F.weekday("_m") == w) & F.col("_f").isNotNull(), newest).otherwise(0).alias("_rc"),
        days[w].alias("_k")) for w in range(7)])
    return ends.select(*keys, "_m", F.explode(rows).alias("x")).select(*keys, "x.*", "_m").where("_k > 0")


def _future_days(wd: DataFrame, keys: list, value: str, horizon: int) -> DataFrame:
    base = wd.groupBy(*keys).agg(F.try_divide(F.sum("_rs"), F.sum("_rc")).alias("recent_avg"), F.sum("_k").alias("_n"),
                                 F.max("_m").alias("_last"))
    wd = wd.select(*keys, "weekday", "_wm")
    pat = wd.groupBy(*keys).agg(F.stddev_samp("_wm").alias("_ws"), F.avg("_wm").alias("_wa"))
    fut = base.join(pat, keys, "left").select(
        *keys, "recent_avg", ((F.col("_n") >= 14) & (F.col("_ws") > F.col("_wa") * 0.3)).alias("_use"),
        F.explode(F.sequence(F.date_add("_last", 1), F.date_add("_last", horizon))).alias("ds"))
    fut = fut.withColumn("weekday", F.weekday("ds")).join(wd, keys + ["weekday"], "left")
    return fut.select(*keys, "ds",
                      F.coalesce(F.when(F.col("_use"), F.coalesce("_wm", "recent_avg")).otherwise(F.col("recent_avg")),
                                  F.lit(0.0)).alias(value))
