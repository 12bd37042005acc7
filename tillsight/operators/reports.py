"""Business reports over transactions.

Every report is a grouped aggregation (partial + final).  Shares of a total
join the grouped rows to a one-row global aggregate (broadcast, exactly one
row), never a window without ``partitionBy`` over fact rows.
"""

from __future__ import annotations

from functools import reduce
from operator import and_
from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import rnd


def with_totals(df: DataFrame, *aggs) -> DataFrame:
    """Attach global aggregates to every row (the build side is one row)."""
    return df.join(F.broadcast(df.agg(*aggs)), how="inner")


def kpi_overview(tx: DataFrame) -> DataFrame:
    """A10: totals, discount %, distinct orders, active days, orders per day."""
    tot = tx.agg(F.sum("gross_amount").alias("total_sales"),
                 F.sum("discount_amount").alias("total_discount"),
                 F.sum("net_amount").alias("total_net_sales"),
                 F.count_distinct("order_id").alias("total_orders"),
                 F.count_distinct("sale_date").alias("days_with_orders"))
    return tot.select(
        rnd("total_sales").alias("total_sales"),
        rnd("total_discount").alias("total_discount"),
        rnd("total_net_sales").alias("total_net_sales"),
        rnd(F.coalesce(F.when(F.col("total_sales") > 0, F.col("total_discount") / F.col("total_sales") * 100),
                       F.lit(0.0))).alias("discount_pct"),
        "total_orders", "days_with_orders",
        rnd(F.coalesce(F.try_divide("total_orders", "days_with_orders"), F.lit(0.0))).alias("avg_daily_orders"),
    )


def orders_per_day(tx: DataFrame) -> DataFrame:
    """A11."""
    return tx.groupBy("sale_date").agg(F.count_distinct("order_id").alias("orders"))


def discount_type_mix(tx: DataFrame) -> DataFrame:
    """Rows per discount type (nulls dropped like value_counts)."""
    return tx.where(F.col("discount_type").isNotNull()).groupBy("discount_type").agg(F.count("*").alias("rows"))


def channel_revenue(tx: DataFrame) -> DataFrame:
    """Revenue by channel (ordered at output)."""
    return (tx.where(F.col("channel").isNotNull()).groupBy("channel")
              .agg(F.sum("gross_amount").alias("revenue")))


def top_products_by_revenue(tx: DataFrame, n: int = 10, name_col: str = "product_name") -> DataFrame:
    """Top-n product names by gross revenue (name breaks ties); a TakeOrdered top-k."""
    g = tx.where(F.col(name_col).isNotNull()).groupBy(name_col).agg(F.sum("gross_amount").alias("revenue"))
    return g.orderBy(F.desc("revenue"), F.asc(name_col)).limit(n)


def category_stats(tx: DataFrame) -> DataFrame:
    """A14 + A15 + P32: per category sums, guarded ratios and shares of total (in %)."""
    g = tx.where(F.col("category_code").isNotNull()).groupBy("category_code").agg(
        F.sum("gross_amount").alias("sales"),
        F.sum("discount_amount").alias("discount"),
        F.sum("qty").alias("qty"),
        F.count_distinct("order_id").alias("orders"),
        F.count_distinct("product_code").alias("products"),
    ).withColumn("actual_sales", F.col("sales") - F.col("discount"))
    g = with_totals(g, F.sum("sales").alias("_ts"), F.sum("actual_sales").alias("_ta"),
                    F.sum("qty").alias("_tq"), F.sum("orders").alias("_to"))

    def guard(num, den, scale=1.0):
        return F.when(F.col(den) > 0, F.col(num) / F.col(den) * scale).otherwise(F.lit(0.0))

    return g.select(
        "category_code",
        rnd("sales").alias("sales"), rnd("discount").alias("discount"), rnd("qty").alias("qty"),
        "orders", "products",
        rnd("actual_sales").alias("actual_sales"),
        rnd(guard("discount", "sales", 100.0)).alias("discount_pct"),
        rnd(guard("actual_sales", "qty")).alias("avg_unit_price"),
        rnd(guard("actual_sales", "orders")).alias("avg_order_value"),
        rnd(guard("qty", "products")).alias("avg_qty_per_product"),
        rnd(guard("sales", "_ts", 100.0)).alias("sales_share"),
        rnd(guard("actual_sales", "_ta", 100.0)).alias("actual_sales_share"),
        rnd(guard("qty", "_tq", 100.0)).alias("qty_share"),
        rnd(guard("orders", "_to", 100.0)).alias("orders_share"),
    )


def category_summary(stats: DataFrame, top: int = 5) -> DataFrame:
    """Category count, totals, mean discount %, top-5 concentration."""
    tot = stats.agg(F.count("*").alias("n_categories"),
                    rnd(F.sum("sales")).alias("total_sales"),
                    rnd(F.sum("actual_sales")).alias("total_actual_sales"),
                    F.sum("qty").cast("long").alias("total_qty"),
                    F.sum("orders").cast("long").alias("total_orders"),
                    rnd(F.avg("discount_pct")).alias("mean_discount_pct"))
    head = (stats.orderBy(F.desc("sales"), F.asc("category_code")).limit(top)
            .agg(rnd(F.sum("sales_share")).alias("top5_sales_share"),
                 rnd(F.sum("actual_sales_share")).alias("top5_actual_sales_share"),
                 rnd(F.sum("qty_share")).alias("top5_qty_share"),
                 rnd(F.sum("orders_share")).alias("top5_orders_share")))
    return tot.join(F.broadcast(head), how="inner")


def top_categories(stats: DataFrame, n: int = 10) -> DataFrame:
    """Three top-n lists (by sales, by discount % among sales > 0, by variety)."""
    lists = [
        ("sales", stats, [F.desc("sales"), F.asc("category_code")]),
        ("discount_pct", stats.where(F.col("sales") > 0), [F.desc("discount_pct"), F.asc("category_code")]),
        ("variety", stats, [F.desc("products"), F.asc("category_code")]),
    ]
    out = None
    for measure, df, order in lists:
        top = df.orderBy(*order).limit(n)
        top = top.select(F.lit(measure).alias("measure"), "category_code", "sales", "discount_pct", "products",
                         F.row_number().over(Window.partitionBy(F.lit(measure)).orderBy(*order)).alias("rank"))
        out = top if out is None else out.unionByName(top)
    return out


def category_rollup(tx: DataFrame) -> DataFrame:
    """Overall + per-category report in one ``rollup`` (level 'all' / 'category')."""
    g = tx.rollup("category_code").agg(
        F.sum("gross_amount").alias("sales"), F.sum("discount_amount").alias("discount"),
        F.sum("qty").alias("qty"), F.count_distinct("order_id").alias("orders"),
        F.grouping("category_code").alias("_g"))
    return g.select(F.when(F.col("_g") == 1, "all").otherwise("category").alias("level"),
                    F.coalesce("category_code", F.lit("*")).alias("category_code"),
                    rnd("sales").alias("sales"), rnd("discount").alias("discount"),
                    rnd("qty").alias("qty"), "orders",
                    rnd(F.when(F.col("sales") > 0, F.col("discount") / F.col("sales") * 100).otherwise(0.0))
                    .alias("discount_pct"))


def sku_popularity(tx: DataFrame) -> DataFrame:
    """Transaction rows per store x product."""
    return tx.groupBy("store_code", "product_code").agg(F.count("*").alias("n_tx"))


def top_skus(tx: DataFrame, n: int = 50) -> DataFrame:
    """Overall top-n products by transaction rows (code breaks ties)."""
    return (tx.groupBy("product_code").agg(F.count("*").alias("n_tx"))
              .orderBy(F.desc("n_tx"), F.asc("product_code")).limit(n))


def price_metrics(tx: DataFrame, keys: Sequence[str] = ("product_code",), price: str = "list_price") -> DataFrame:
    """Mean, exact median, min, max, sample std, cv (0 when mean <= 0)."""
    g = tx.groupBy(*keys).agg(F.avg(price).alias("avg_price"), F.median(price).alias("median_price"),
                              F.min(price).alias("min_price"), F.max(price).alias("max_price"),
                              F.stddev_samp(price).alias("price_std"))
    return g.withColumn("price_cv", F.when(F.col("avg_price") > 0, F.col("price_std") / F.col("avg_price"))
                        .otherwise(F.lit(0.0)))


def sales_metrics(tx: DataFrame, keys: Sequence[str] = ("product_code",)) -> DataFrame:
    """Total, mean, median, std of qty; row count; mean ticket (gross per row)."""
    return tx.groupBy(*keys).agg(
        F.sum("qty").alias("total_quantity"), F.avg("qty").alias("avg_quantity"),
        F.median("qty").alias("median_quantity"), F.stddev_samp("qty").alias("quantity_std"),
        F.count("*").alias("total_transactions"), F.avg("gross_amount").alias("avg_transaction_value"))


def resample(tx: DataFrame, unit: str = "day", keys: Sequence[str] = ("product_code",),
             ts: str = "sale_ts", value: str = "qty") -> DataFrame:
    """Per-key buckets of hour / day / week (Sunday-labelled end) / month (last day),
    empty buckets = 0. Spine per key from first to last bucket via ``sequence``."""
    keys = list(keys)
    if unit == "hour":
        b = F.date_trunc("hour", ts)
        step = F.expr("INTERVAL 1 HOUR")
    elif unit == "day":
        b = F.to_date(ts)
        step = F.expr("INTERVAL 1 DAY")
    elif unit == "week":   # label = the Sunday that closes the week
        d = F.to_date(ts)
        b = F.date_add(d, (6 - F.weekday(d)))
        step = F.expr("INTERVAL 7 DAY")
    elif unit == "month":
        b = F.last_day(F.to_date(ts))
        step = None
    else:
        raise ValueError(unit)
    g = tx.groupBy(*keys, b.alias("bucket")).agg(F.sum(value).alias("total"))
    bounds = g.groupBy(*keys).agg(F.min("bucket").alias("_b0"), F.max("bucket").alias("_b1"))
    if unit == "month":
        spine = bounds.select(*keys, F.explode(F.sequence(F.trunc("_b0", "month"), F.trunc("_b1", "month"),
                                                          F.expr("INTERVAL 1 MONTH"))).alias("_m"))
        spine = spine.select(*keys, F.last_day("_m").alias("bucket"))
    else:
        spine = bounds.select(*keys, F.explode(F.sequence("_b0", "_b1", step)).alias("bucket"))
    return (spine.join(g, keys + ["bucket"], "left")
                 .select(*keys, "bucket", F.coalesce("total", F.lit(0.0)).alias("total")))


def autocorrelation(daily: DataFrame, keys: Sequence[str] = ("product_code",), date_col: str = "sale_date",
                    value: str = "qty", lags: Sequence[int] = range(1, 8)) -> DataFrame:
    """Mean, std, min, max and lag-k autocorrelation of a dense daily series."""
    w = Window.partitionBy(*keys).orderBy(date_col)
    d = daily.select(*keys, date_col, value, *[F.lag(value, k).over(w).alias(f"_l{k}") for k in lags])
    return d.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"),
        *[F.corr(value, f"_l{k}").alias(f"autocorr_lag{k}") for k in lags])


def daily_series_stats(dense: DataFrame, keys: Sequence[str] = ("product_code",), value: str = "qty") -> DataFrame:
    """Days, sale days, zero days, total; positive-only mean/std/median/min/max. The exact median, whose
    aggregation sorts its input, reads the positive rows alone."""
    pos = F.when(F.col(value) > 0, F.col(value))
    out = dense.groupBy(*keys).agg(
        F.count("*").alias("days"), F.count_if(F.col(value) > 0).alias("sale_days"),
        F.count_if(F.col(value) == 0).alias("zero_days"), F.sum(value).alias("total"),
        F.avg(pos).alias("pos_mean"), F.stddev_samp(pos).alias("pos_std"),
        F.min(pos).alias("pos_min"), F.max(pos).alias("pos_max"))
    mid = dense.where(F.col(value) > 0).groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.median(value).alias("pos_median"))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return out.join(mid, same, "left").select(*keys, "days", "sale_days", "zero_days", "total", "pos_mean", "pos_std",
                                              "pos_median", "pos_min", "pos_max")


def weekday_stats(dense: DataFrame, keys: Sequence[str] = ("product_code",), date_col: str = "sale_date",
                  value: str = "qty") -> DataFrame:
    """Count / sum / mean / std by weekday (Mon=0); all 7 weekdays present,
    mean 0 for a weekday with no rows (7-row spine per key)."""
    keys = list(keys)
    g = dense.groupBy(*keys, F.weekday(date_col).alias("weekday")).agg(
        F.count("*").alias("n"), F.sum(value).alias("total"),
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    # a key's groups (7 at most) become one array, so that the empty weekdays need no second pass over the series;
    # a key with a null has no weekdays of its own
    known = reduce(and_, [F.col(k).isNotNull() for k in keys])
    g = g.groupBy(*keys).agg(F.collect_list(F.when(known, F.struct("weekday", "n", "total", "mean", "std"))).alias("_g"))
    day = g.select(*keys, "_g", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("weekday"))
    day = day.withColumn("_w", F.get(F.filter("_g", lambda x: x["weekday"] == F.col("weekday")), F.lit(0)))
    return day.select(*keys, "weekday", F.coalesce("_w.n", F.lit(0)).alias("n"), F.coalesce("_w.total", F.lit(0.0)).alias("total"),
                      F.coalesce("_w.mean", F.lit(0.0)).alias("mean"), F.col("_w.std").alias("std"))


def month_stats(dense: DataFrame, keys: Sequence[str] = ("product_code",), date_col: str = "sale_date",
                value: str = "qty") -> DataFrame:
    """Count / sum / mean / std by calendar month."""
    return dense.groupBy(*keys, F.month(date_col).alias("month")).agg(
        F.count("*").alias("n"), F.sum(value).alias("total"),
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))


def value_distribution(dense: DataFrame, keys: Sequence[str] = ("product_code",), value: str = "qty") -> DataFrame:
    """Number of days per daily quantity value."""
    return dense.groupBy(*keys, value).agg(F.count("*").alias("days"))


def product_list(tx: DataFrame, n: int | None = None) -> DataFrame:
    """A36 + U3: products with a name, mean list price and row count; optional first n by code."""
    g = tx.groupBy("product_code").agg(F.min("product_name").alias("product_name"),
                                       F.avg("list_price").alias("avg_price"), F.count("*").alias("rows"))
    return g.orderBy("product_code").limit(n) if n else g
