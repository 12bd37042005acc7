"""Prediction input: scenario grid and history lookups.

The source system built the grid per product with Python loops and looked up
each lag date with a filter. Here one pass serves every key and every
prediction day: the grid is ``explode(sequence)`` per request (no cross join),
and all lag / fallback / recent-window values are conditional aggregates of
one ``groupBy(key, slot, predict_date)`` over the slot history, so neither an
equi-join per lag nor a range join is needed.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import season_code

LAGS = (1, 3, 7, 14, 30)


def discount_ladder(lo: float = 0.4, hi: float = 0.9, step: float = 0.1) -> F.Column:
    """Ladder lo..hi as scaled integers (no float drift), returned as doubles."""
    n0, n1, s = round(lo * 100), round(hi * 100), round(step * 100)
    return F.transform(F.sequence(F.lit(n0), F.lit(n1), F.lit(s)), lambda x: x / 100.0)


def scenario_grid(requests: DataFrame, slots: Sequence[int], lo: float = 0.4, hi: float = 0.9,
                  step: float = 0.1) -> DataFrame:
    """Requests (keys, predict_date, list_price, first_date) x slots x discount ladder,
    plus the date features of the prediction day (P11, P17 season code, P3 day index)."""
    d = F.col("predict_date")
    return (requests
            .select("*", F.explode(F.array(*[F.lit(s) for s in slots])).alias("slot"))
            .select("*", F.explode(discount_ladder(lo, hi, step)).alias("discount_rate"))
            .withColumn("avg_price", F.col("list_price") * F.col("discount_rate"))
            .withColumn("is_promo", F.lit(1))
            .withColumn("weekday", F.weekday(d) + 1)
            .withColumn("month", F.month(d)).withColumn("year", F.year(d))
            .withColumn("is_weekend", (F.weekday(d) >= 5).cast("int"))
            .withColumn("is_month_end", (F.dayofmonth(d) >= 25).cast("int"))
            .withColumn("quarter", F.quarter(d))
            .withColumn("day_index", F.datediff(d, F.col("first_date")) + 1)
            .withColumn("season_code", season_code(F.month(d))))


def slot_history_features(history: DataFrame, requests: DataFrame, keys: Sequence[str],
                          slot: str = "slot", date_col: str = "sale_date") -> DataFrame:
    """J6 + W16 for every (key, slot, predict_date).

    J6 lag k: mean qty on predict_date - k; else mean over [lag - 3 d, lag]; else
    the slot's mean; else 0.  W16: with >= 7 slot rows, mean / std / OLS slope of
    the rows since predict_date - 7 d; with >= 30 rows, mean / std since - 30 d;
    value one week earlier. Missing -> 0.
    """
    keys = list(keys)
    h = history.join(requests.select(*keys, "predict_date"), keys, "inner")
    d, p, q = F.col(date_col), F.col("predict_date"), F.col("qty")
    aggs = [F.avg(q).alias("_slot_mean"), F.count("*").alias("_n")]
    for k in LAGS:
        lag = F.date_sub(p, k)
        aggs.append(F.avg(F.when(d == lag, q)).alias(f"_x{k}"))
        aggs.append(F.avg(F.when((d >= F.date_sub(lag, 3)) & (d <= lag), q)).alias(f"_r{k}"))
    l7, l30 = d >= F.date_sub(p, 7), d >= F.date_sub(p, 30)
    aggs += [F.avg(F.when(l7, q)).alias("_m7"), F.stddev_samp(F.when(l7, q)).alias("_s7"),
             F.regr_slope(F.when(l7, q), F.when(l7, F.datediff(d, p).cast("double"))).alias("_t7"),
             F.avg(F.when(l30, q)).alias("_m30"), F.stddev_samp(F.when(l30, q)).alias("_s30"),
             F.avg(F.when(d == F.date_sub(p, 7), q)).alias("_lw")]
    g = h.groupBy(*keys, slot, "predict_date").agg(*aggs)
    out = [*keys, slot, "predict_date"]
    for k in LAGS:
        out.append(F.coalesce(f"_x{k}", f"_r{k}", "_slot_mean", F.lit(0.0)).alias(f"qty_lag{k}"))
    n7, n30 = F.col("_n") >= 7, F.col("_n") >= 30
    out += [F.coalesce(F.when(n7, F.col("_m7")), F.lit(0.0)).alias("qty_mean7"),
            F.coalesce(F.when(n7, F.col("_s7")), F.lit(0.0)).alias("qty_std7"),
            F.coalesce(F.when(n7, F.col("_t7")), F.lit(0.0)).alias("qty_trend7"),
            F.coalesce(F.when(n30, F.col("_m30")), F.lit(0.0)).alias("qty_mean30"),
            F.coalesce(F.when(n30, F.col("_s30")), F.lit(0.0)).alias("qty_std30"),
            F.coalesce("_lw", F.lit(0.0)).alias("qty_last_week")]
    return g.select(*out)


def prediction_input(history: DataFrame, keys: Sequence[str], slots: Sequence[int], days: int = 1,
                     lo: float = 0.4, hi: float = 0.9) -> DataFrame:
    """J5 + J6 + W16 + U1: scoring rows for the ``days`` days after each key's last
    history date, every slot and discount level, in one pass."""
    keys = list(keys)
    last = history.groupBy(*keys).agg(
        F.max("sale_date").alias("_last"), F.min("sale_date").alias("first_date"),
        F.max_by("list_price", F.struct("sale_date", "slot")).alias("list_price"))
    req = last.select(*keys, "first_date", "list_price",
                      F.explode(F.sequence(F.date_add("_last", 1), F.date_add("_last", days))).alias("predict_date"))
    grid = scenario_grid(req, slots, lo, hi)
    feats = slot_history_features(history.where(F.col("slot").isin(*slots)), req, keys)
    return grid.join(feats, keys + ["slot", "predict_date"], "left").na.fill(0.0, subset=[
        c for c in feats.columns if c.startswith("qty_")])


def align_columns(df: DataFrame, spec: Sequence[tuple]) -> DataFrame:
    """Select exactly ``spec`` = [(name, type, default)]: missing columns get a
    typed literal default, extra columns are dropped, order follows the spec."""
    have = set(df.columns)
    return df.select(*[(F.col(n) if n in have else F.lit(dflt)).cast(t).alias(n) for n, t, dflt in spec])
