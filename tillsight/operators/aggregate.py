"""Grain-changing aggregations: slot, daily, 30-minute buckets (A1-A5).

All of them are hash aggregations with map-side partial aggregation, so a hot
product contributes one partial row per map task before the shuffle.
"""

from __future__ import annotations

import math
from typing import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import sdiv

GRID_ROWS = 1_000_000       # dense rows of a partition of the daily grid, about


def _post_price_fields(df: DataFrame) -> DataFrame:
    """Average price and discount rate with defaults."""
    avg_price = F.when(F.col("qty") > 0, (F.col("gross_amount") - F.col("discount_amount")) / F.col("qty"))
    rate = F.when(F.col("gross_amount") > 0, 1 - F.col("discount_amount") / F.col("gross_amount"))
    return (df.withColumn("avg_price", F.coalesce(avg_price, F.col("list_price")))
              .withColumn("discount_rate", F.coalesce(rate, F.lit(1.0))))


def slot_aggregate(df: DataFrame, keys: Sequence[str] = ("store_code", "product_code"),
                   date_col: str = "sale_date", slot_col: str = "slot") -> DataFrame:
    """A1 + A4: one row per key x date x slot."""
    g = df.groupBy(*keys, date_col, slot_col).agg(
        F.sum("qty").alias("qty"),
        F.sum("gross_amount").alias("gross_amount"),
        F.avg("list_price").alias("list_price"),
        F.avg("is_promo").alias("promo_share"),
        F.sum("discount_amount").alias("discount_amount"),
    )
    return _post_price_fields(g)


def daily_from_slots(df: DataFrame, keys: Sequence[str] = ("store_code", "product_code"),
                     date_col: str = "sale_date", slot_col: str = "slot") -> DataFrame:
    """A2 + A4: daily aggregation of line rows with mean promo flag and mean slot.

    Includes ``sum(discount_amount)`` (the source omitted it and then used it).
    """
    g = df.groupBy(*keys, date_col).agg(
        F.sum("qty").alias("qty"),
        F.sum("gross_amount").alias("gross_amount"),
        F.avg("list_price").alias("list_price"),
        F.avg("is_promo").alias("promo_share"),
        F.avg(slot_col).alias("mean_slot"),
        F.sum("discount_amount").alias("discount_amount"),
    )
    return _post_price_fields(g)


def daily_aggregate(df: DataFrame, keys: Sequence[str] = ("product_code",),
                    date_col: str = "sale_date") -> DataFrame:
    """A3 (+F4): returns removed, then per key x date sums, mean list price,
    promotion count and flag, and average selling price (null when qty = 0)."""
    g = df.where(F.col("qty") >= 0).groupBy(*keys, date_col).agg(
        F.sum("qty").alias("qty"),
        F.sum("gross_amount").alias("gross_amount"),
        F.sum("net_amount").alias("net_amount"),
        F.sum("discount_amount").alias("discount_amount"),
        F.avg("list_price").alias("list_price"),
        F.sum("is_promo").cast("long").alias("promo_count"),
    )
    return (g.withColumn("avg_price", F.when(F.col("qty") > 0,
                                             (F.col("gross_amount") - F.col("discount_amount")) / F.col("qty")))
             .withColumn("is_promo", (F.col("promo_count") > 0).cast("int")))


def half_hour_buckets(df: DataFrame, keys: Sequence[str] = ("store_code", "product_code"),
                      ts: str = "sale_ts", minutes: int = 30) -> DataFrame:
    """A5: tumbling ``minutes`` buckets: total qty, mean list price, mean rate, mean discounted price."""
    w = F.window(ts, f"{minutes} minutes")
    return (df.withColumn("discounted_price", F.col("list_price") * F.col("discount_rate"))
              .groupBy(*keys, w.alias("bucket"))
              .agg(F.sum("qty").alias("qty"),
                   F.avg("list_price").alias("list_price"),
                   F.avg("discount_rate").alias("discount_rate"),
                   F.avg("discounted_price").alias("discounted_price"))
              .select(*keys, F.col("bucket.start").alias("bucket_start"), "qty", "list_price",
                      "discount_rate", "discounted_price"))


def attach_key_bounds(df: DataFrame, keys: Iterable[str], date_col: str = "sale_date") -> DataFrame:
    """Per-key first/last date (grouped, then joined on the key)."""
    keys = list(keys)
    b = df.groupBy(*keys).agg(F.min(date_col).alias("first_date"), F.max(date_col).alias("last_date"))
    return df.join(b, keys, "left")


def daily_grid(daily: DataFrame, keys: Sequence[str] = ("product_code",), date_col: str = "sale_date",
               zero_cols: Sequence[str] = ("qty", "gross_amount", "is_promo", "discount_rate", "promo_count"),
               mean_cols: Sequence[str] = ("list_price",), last: str | None = None, runs: bool = False) -> DataFrame:
    """J4 + W8: dense per-key daily series from the key's first to last date.

    Each row is followed by the empty days up to the key's next row (``explode`` of a sequence), so the dense rows
    are made where the daily rows already lie and are never shuffled or joined; gaps are filled: counts/amounts with 0,
    price columns with the key mean. Rows with a null in ``keys`` fill no day. The daily rows are dealt by key
    over so many partitions that one holds about ``GRID_ROWS`` dense rows, which later steps per key sort in memory.
    ``last`` names a further column for the key's last date.

    ``runs`` leaves the grid unexploded, for steps that can add up empty days without seeing them: a row is a day and
    the empty days up to the key's next one, ``run_days`` in all, and ``fill_<c>`` is what those hold in a price column.
    """
    from pyspark.sql import Window
    keys = list(keys)
    own = Window.partitionBy(*keys)
    dealt = daily if runs else daily.repartition(grid_partitions(daily, keys, date_col), *keys)
    d = dealt.select(
        "*", *[F.avg(c).over(own).alias(f"_mean_{c}") for c in mean_cols],
        F.lead(date_col).over(own.orderBy(date_col)).alias("_next"),
        *([F.max(date_col).over(own).alias(last)] if last else []))
    end = F.greatest(F.col(date_col), F.date_sub(F.coalesce("_next", date_col), 1))
    d = d.where(F.col(date_col).isNotNull())
    if runs:
        full = d.withColumn("_day", F.col(date_col)).withColumn("run_days", F.datediff(end, date_col) + 1)
    else:
        full = d.withColumn("_day", F.explode(F.sequence(F.col(date_col), end)))
    real = F.col("_day") == F.col(date_col)
    for k in keys:
        real &= F.col(k).isNotNull()
    sel = []
    for c in daily.columns:
        if c in keys or c == date_col:
            continue
        v = F.when(real, F.col(c))
        if c in zero_cols:
            sel.append(F.coalesce(v, F.lit(0).cast(daily.schema[c].dataType)).alias(c))
        elif c in mean_cols:
            sel.append(F.coalesce(v, F.col(f"_mean_{c}")).alias(c))
        else:
            sel.append(v.alias(c))
    extra = ["run_days", *[F.col(f"_mean_{c}").alias(f"fill_{c}") for c in mean_cols]] if runs else []
    return full.select(*keys, F.col("_day").alias(date_col), *sel, *extra, *([last] if last else []))


def grid_partitions(daily: DataFrame, keys: Sequence[str], date_col: str) -> int:
    """Partitions that give each about ``GRID_ROWS`` rows of the dense series, at least the session's number."""
    spark = daily.sparkSession
    spans = daily.groupBy(*keys).agg((F.datediff(F.max(date_col), F.min(date_col)) + 1).alias("_n"))
    rows = spans.agg(F.sum("_n")).first()[0] or 0        # one number
    return max(math.ceil(rows / GRID_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions")))


def slot_grid(slots: DataFrame, product_col: str = "product_code", date_col: str = "sale_date",
              slot_col: str = "slot", fill_cols: Sequence[str] = ("list_price", "avg_price", "promo_share",
                                                                   "discount_rate", "store_code"),
              mean_cols: Sequence[str] = ("list_price", "avg_price")) -> DataFrame:
    """J3 + W7 + W8: dense product x date x slot grid, then fills.

    Dates are the dates present anywhere in the data and slots the observed
    [min, max] range. The grid is generated per product by exploding sequences
    and semi-joining the distinct dates (bounded by days, broadcast), never by a
    cross join. Within (product, date) price fields are forward- then
    backward-filled over slots; remaining gaps take the product mean; qty and
    gross fill with 0, promo share with 0.

    Plan: products and slot rows are hash-partitioned by product once, over so many
    partitions that one holds about ``GRID_ROWS`` rows of the grid; the spine is exploded
    there, and the join, both fill windows (forward, and backward as a reversed running
    window) and the product mean (a product's grid is bounded by days x slots) reuse that partitioning.
    """
    from pyspark.sql import Window
    days = slots.select(date_col).distinct()
    glob = slots.agg(F.min(date_col).alias("_d0"), F.max(date_col).alias("_d1"),
                     F.min(slot_col).alias("_s0"), F.max(slot_col).alias("_s1"))
    size = slots.agg(F.approx_count_distinct(product_col).alias("p"), F.count_distinct(date_col).alias("d"),
                     (F.max(slot_col) - F.min(slot_col) + 1).alias("s")).first()      # one row
    n = max(math.ceil(size["p"] * size["d"] * (size["s"] or 0) / GRID_ROWS), int(slots.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    products = slots.select(product_col).distinct().repartition(n, product_col)
    spine = (products.join(F.broadcast(glob), how="inner")   # one-row build side
             .select(product_col, F.explode(F.sequence("_d0", "_d1")).alias(date_col), "_s0", "_s1")
             .join(F.broadcast(days), date_col, "left_semi")
             .select(product_col, date_col, F.explode(F.sequence("_s0", "_s1")).alias(slot_col)))
    part = [product_col, date_col]
    full = spine.join(slots.repartition(n, product_col), [product_col, date_col, slot_col], "left")
    fwd = Window.partitionBy(*part).orderBy(slot_col).rowsBetween(Window.unboundedPreceding, 0)
    bwd = Window.partitionBy(*part).orderBy(F.desc(slot_col)).rowsBetween(Window.unboundedPreceding, 0)
    for c in fill_cols:
        if c in full.columns:
            full = full.withColumn(c, F.coalesce(F.last(c, True).over(fwd), F.last(c, True).over(bwd)))
    prod = Window.partitionBy(product_col)
    for c in mean_cols:
        full = full.withColumn(c, F.coalesce(F.col(c), F.avg(c).over(prod)))
    return (full.withColumn("qty", F.coalesce("qty", F.lit(0.0)))
                .withColumn("gross_amount", F.coalesce("gross_amount", F.lit(0.0)))
                .withColumn("promo_share", F.coalesce("promo_share", F.lit(0.0))))


def safe_ratio(a, b):
    return sdiv(a, b)
