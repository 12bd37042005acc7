"""Filters and base derived fields (F*, P1-P8, F4)."""

from __future__ import annotations

from functools import reduce
from operator import and_
from typing import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import avg_selling_price, discount_rate, is_promo, time_slot


def filter_sales(df: DataFrame, store_code: str | None = None, product_code: str | None = None,
                 channel: str | None = None, positive_qty: bool = True,
                 drop: Iterable[str] = ()) -> DataFrame:
    """Store, product, channel and qty>0 predicates, then drop columns.

    Unset arguments mean "all keys": the single-SKU call of the source system is a
    filter on this all-keys result.
    """
    cond = F.lit(True)
    if store_code is not None:
        cond &= F.col("store_code") == store_code
    if product_code is not None:
        cond &= F.col("product_code") == product_code
    if channel is not None:
        cond &= F.col("channel") == channel
    if positive_qty:
        cond &= F.col("qty") > 0
    out = df.where(cond)
    return out.drop(*drop) if drop else out


def is_positive():
    """positive gross amount and quantity."""
    return (F.col("gross_amount") > 0) & (F.col("qty") > 0)


def is_priced():
    """quantity, gross and list price all positive."""
    return is_positive() & (F.col("list_price") > 0)


def is_return():
    """return rows; null quantities are neither sales nor returns."""
    return F.col("qty") < 0


def is_complete(cols: Iterable[str]):
    """no null in ``cols``."""
    return reduce(and_, (F.col(c).isNotNull() for c in cols))


def keep_positive(df: DataFrame) -> DataFrame:
    """F2 as a filter."""
    return df.where(is_positive())


def keep_priced(df: DataFrame) -> DataFrame:
    """F3 as a filter."""
    return df.where(is_priced())


def split_returns(df: DataFrame):
    """(sales rows with qty >= 0, return rows with qty < 0)."""
    return df.where(~is_return()), df.where(is_return())


def hour_in_range(ts, start_hour: int, end_hour: int):
    """hour within [start, end] (wraps past midnight)."""
    h = F.hour(ts)
    if start_hour <= end_hour:
        return (h >= start_hour) & (h <= end_hour)
    return (h >= start_hour) | (h <= end_hour)


def filter_hours(df: DataFrame, start_hour: int, end_hour: int, ts: str = "sale_ts") -> DataFrame:
    """F6 as a filter."""
    return df.where(hour_in_range(ts, start_hour, end_hour))


def filter_dates(df: DataFrame, start, end, date_col: str = "sale_date") -> DataFrame:
    """inclusive date range."""
    return df.where(F.col(date_col).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def clock_in_range(ts, start_hhmm: str, end_hhmm: str):
    """clock time of ``ts`` within [start, end] (wraps past midnight)."""
    t = F.date_format(ts, "HH:mm")
    if start_hhmm <= end_hhmm:
        return (t >= start_hhmm) & (t <= end_hhmm)
    return (t >= start_hhmm) | (t <= end_hhmm)


def coerce_numeric(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """string/any -> double, malformed -> null."""
    return df.select(*[F.expr(f"try_cast(`{c}` AS DOUBLE)").alias(c) if c in set(cols) else F.col(c)
                       for c in df.columns])


def base_fields(df: DataFrame, gap_minutes: int = 60, rate_variant: str = "amount",
                with_slot: bool = True) -> DataFrame:
    """P3-P8 row fields: day index, discount rate, average price, promo flag, slot.

    The day index (P3) is 1-based from the key's first date and uses a window;
    it is added by :func:`day_index` on aggregated data instead of raw rows.
    """
    out = df.withColumn("discount_rate", discount_rate(rate_variant)) \
            .withColumn("avg_price", avg_selling_price("net")) \
            .withColumn("is_promo", is_promo())
    if with_slot and "sale_ts" in df.columns:
        out = out.withColumn("slot", time_slot("sale_ts", gap_minutes))
    return out


def day_index(df: DataFrame, keys: Iterable[str], date_col: str = "sale_date", aggregated: bool = False) -> DataFrame:
    """1-based day number from the key's first date.

    On raw rows the first date is a grouped (map-side combined) min joined back,
    so a hot key never becomes one window partition of raw rows. On per-day
    aggregates (``aggregated=True``, bounded by days per key) it is a window that
    shares the exchange of the other series windows on the same key.
    """
    keys = list(keys)
    if aggregated:
        from pyspark.sql import Window
        first = F.min(date_col).over(Window.partitionBy(*keys))
        return df.withColumn("day_index", F.datediff(F.col(date_col), first) + 1)
    first = df.groupBy(*keys).agg(F.min(date_col).alias("_first_date"))
    return (df.join(first, keys, "left")
              .withColumn("day_index", F.datediff(F.col(date_col), F.col("_first_date")) + 1)
              .drop("_first_date"))
