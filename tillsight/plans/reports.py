"""Report queries: KPIs, categories, SKU popularity, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import dstr, rnd
from ..operators import reports as R
from ..operators.aggregate import daily_grid
from ..operators.clean import filter_sales
from ..sources.starschema import hourly_transactions, transactions
from .registry import register
from .sales import DAILY_SQL, daily_product_sales
from .sqlparts import hx_cte, r, tx_cte, with_

ONLINE = "1-URGENT"   # the driver data's channel standing in for "online"


def _tx(spark, d):
    return transactions(spark, d, part=True)


TXF = tx_cte(orders=True, part=True)


@register("kpi_overview", "A10 P32", sql=with_(TXF) + f"""
, tot AS (SELECT sum(gross_amount) AS s, sum(discount_amount) AS dsc, sum(net_amount) AS n,
                count(DISTINCT order_id) AS total_orders FROM tx),
days AS (SELECT count(*) AS days_with_orders FROM (SELECT sale_date FROM tx GROUP BY sale_date))
SELECT {r('s')} AS total_sales, {r('dsc')} AS total_discount, {r('n')} AS total_net_sales,
       {r('coalesce(CASE WHEN s > 0 THEN dsc / s * 100 END, 0.0)')} AS discount_pct,
       total_orders, days_with_orders,
       {r('coalesce(total_orders / days_with_orders, 0.0)')} AS avg_daily_orders
FROM tot, days
""")
def q_kpi_overview(spark, d):
    return R.kpi_overview(transactions(spark, d))


@register("orders_per_day", "A11", sql=with_(tx_cte()) + """
SELECT CAST(sale_date AS VARCHAR) AS sale_date, count(DISTINCT order_id) AS orders FROM tx GROUP BY sale_date
""")
def q_orders_per_day(spark, d):
    return R.orders_per_day(transactions(spark, d)).select(dstr("sale_date"), "orders")


@register("discount_type_mix", "A12", sql=with_(tx_cte()) + """
SELECT discount_type, count(*) AS "rows" FROM tx WHERE discount_type IS NOT NULL GROUP BY discount_type
""")
def q_discount_type_mix(spark, d):
    return R.discount_type_mix(transactions(spark, d))


@register("channel_revenue", "A13", sql=with_(tx_cte(orders=True)) + f"""
SELECT channel, {r('sum(gross_amount)')} AS revenue FROM tx WHERE channel IS NOT NULL GROUP BY channel
""")
def q_channel_revenue(spark, d):
    g = R.channel_revenue(transactions(spark, d, orders=True))
    return g.select("channel", rnd("revenue").alias("revenue"))


@register("top_products_revenue", "T2", sql=with_(tx_cte(part=True)) + f"""
SELECT product_name, {r('revenue')} AS revenue FROM (
  SELECT product_name, sum(gross_amount) AS revenue FROM tx WHERE product_name IS NOT NULL
  GROUP BY product_name ORDER BY revenue DESC, product_name LIMIT 10)
""")
def q_top_products_revenue(spark, d):
    t = R.top_products_by_revenue(transactions(spark, d, part=True))
    return t.select("product_name", rnd("revenue").alias("revenue"))


CAT_SQL = f"""cat0 AS (
  SELECT category_code, sum(gross_amount) AS sales, sum(discount_amount) AS discount, sum(qty) AS qty,
         count(DISTINCT order_id) AS orders, count(DISTINCT product_code) AS products,
         sum(gross_amount) - sum(discount_amount) AS actual_sales
  FROM tx WHERE category_code IS NOT NULL GROUP BY category_code),
tots AS (SELECT sum(sales) AS _ts, sum(actual_sales) AS _ta, sum(qty) AS _tq, sum(orders) AS _to FROM cat0),
cat AS (
  SELECT category_code, {r('sales')} AS sales, {r('discount')} AS discount, {r('qty')} AS qty,
         orders, products, {r('actual_sales')} AS actual_sales,
         {r('CASE WHEN sales > 0 THEN discount / sales * 100.0 ELSE 0.0 END')} AS discount_pct,
         {r('CASE WHEN qty > 0 THEN actual_sales / qty * 1.0 ELSE 0.0 END')} AS avg_unit_price,
         {r('CASE WHEN orders > 0 THEN actual_sales / orders * 1.0 ELSE 0.0 END')} AS avg_order_value,
         {r('CASE WHEN products > 0 THEN qty / products * 1.0 ELSE 0.0 END')} AS avg_qty_per_product,
         {r('CASE WHEN _ts > 0 THEN sales / _ts * 100.0 ELSE 0.0 END')} AS sales_share,
         {r('CASE WHEN _ta > 0 THEN actual_sales / _ta * 100.0 ELSE 0.0 END')} AS actual_sales_share,
         {r('CASE WHEN _tq > 0 THEN qty / _tq * 100.0 ELSE 0.0 END')} AS qty_share,
         {r('CASE WHEN _to > 0 THEN orders / _to * 100.0 ELSE 0.0 END')} AS orders_share
  FROM cat0, tots)"""


@register("category_stats", "A14 A15 P32", sql=with_(TXF, CAT_SQL) + "SELECT * FROM cat")
def q_category_stats(spark, d):
    return R.category_stats(_tx(spark, d))


@register("category_summary", "A16", sql=with_(TXF, CAT_SQL) + f"""
, tot AS (SELECT count(*) AS n_categories, {r('sum(sales)')} AS total_sales,
                {r('sum(actual_sales)')} AS total_actual_sales, CAST(sum(qty) AS BIGINT) AS total_qty,
                CAST(sum(orders) AS BIGINT) AS total_orders, {r('avg(discount_pct)')} AS mean_discount_pct FROM cat),
head AS (SELECT {r('sum(sales_share)')} AS top5_sales_share, {r('sum(actual_sales_share)')} AS top5_actual_sales_share,
                {r('sum(qty_share)')} AS top5_qty_share, {r('sum(orders_share)')} AS top5_orders_share
         FROM (SELECT * FROM cat ORDER BY sales DESC, category_code LIMIT 5))
SELECT * FROM tot, head
""")
def q_category_summary(spark, d):
    return R.category_summary(R.category_stats(_tx(spark, d)))


@register("top_categories", "T3", sql=with_(TXF, CAT_SQL) + """
SELECT * FROM (
  SELECT 'sales' AS measure, category_code, sales, discount_pct, products,
         CAST(row_number() OVER (ORDER BY sales DESC, category_code) AS INT) AS rank
  FROM cat ORDER BY sales DESC, category_code LIMIT 10)
UNION ALL SELECT * FROM (
  SELECT 'discount_pct', category_code, sales, discount_pct, products,
         CAST(row_number() OVER (ORDER BY discount_pct DESC, category_code) AS INT)
  FROM cat WHERE sales > 0 ORDER BY discount_pct DESC, category_code LIMIT 10)
UNION ALL SELECT * FROM (
  SELECT 'variety', category_code, sales, discount_pct, products,
         CAST(row_number() OVER (ORDER BY products DESC, category_code) AS INT)
  FROM cat ORDER BY products DESC, category_code LIMIT 10)
""")
def q_top_categories(spark, d):
    return R.top_categories(R.category_stats(_tx(spark, d)))


@register("category_rollup", "A17", sql=with_(tx_cte(part=True)) + f"""
SELECT CASE WHEN grouping(category_code) = 1 THEN 'all' ELSE 'category' END AS level,
       coalesce(category_code, '*') AS category_code,
       {r('sum(gross_amount)')} AS sales, {r('sum(discount_amount)')} AS discount,
       {r('sum(qty)')} AS qty, count(DISTINCT order_id) AS orders,
       {r('CASE WHEN sum(gross_amount) > 0 THEN sum(discount_amount) / sum(gross_amount) * 100 ELSE 0.0 END')} AS discount_pct
FROM tx GROUP BY ROLLUP (category_code)
""")
def q_category_rollup(spark, d):
    return R.category_rollup(transactions(spark, d, part=True))


@register("sku_popularity_online", "F11 A18", sql=with_(tx_cte(orders=True)) + f"""
SELECT store_code, product_code, count(*) AS n_tx FROM tx
WHERE channel = '{ONLINE}' AND qty > 0 GROUP BY store_code, product_code
""")
def q_sku_popularity_online(spark, d):
    return R.sku_popularity(filter_sales(transactions(spark, d, orders=True), channel=ONLINE))


@register("top50_skus_online", "F11 A18", sql=with_(tx_cte(orders=True)) + f"""
SELECT product_code, count(*) AS n_tx FROM tx WHERE channel = '{ONLINE}' AND qty > 0
GROUP BY product_code ORDER BY n_tx DESC, product_code LIMIT 50
""")
def q_top50_skus_online(spark, d):
    return R.top_skus(filter_sales(transactions(spark, d, orders=True), channel=ONLINE), 50)


@register("price_metrics", "A7", sql=with_(tx_cte()) + f"""
SELECT product_code, {r('avg(list_price)')} AS avg_price, {r('median(list_price)')} AS median_price,
       {r('min(list_price)')} AS min_price, {r('max(list_price)')} AS max_price,
       {r('stddev_samp(list_price)')} AS price_std,
       {r('CASE WHEN avg(list_price) > 0 THEN stddev_samp(list_price) / avg(list_price) ELSE 0.0 END')} AS price_cv
FROM tx GROUP BY product_code
""")
def q_price_metrics(spark, d):
    g = R.price_metrics(transactions(spark, d))
    return g.select("product_code", *[rnd(c).alias(c) for c in g.columns if c != "product_code"])


@register("sales_metrics", "A8", sql=with_(tx_cte()) + f"""
SELECT product_code, {r('sum(qty)')} AS total_quantity, {r('avg(qty)')} AS avg_quantity,
       {r('median(qty)')} AS median_quantity, {r('stddev_samp(qty)')} AS quantity_std,
       count(*) AS total_transactions, {r('avg(gross_amount)')} AS avg_transaction_value
FROM tx GROUP BY product_code
""")
def q_sales_metrics(spark, d):
    g = R.sales_metrics(transactions(spark, d))
    return g.select("product_code", "total_transactions",
                    *[rnd(c).alias(c) for c in g.columns if c not in ("product_code", "total_transactions")])


@register("hourly_resample", "A6", sql=with_(hx_cte()) + f"""
, g AS (SELECT product_code, date_trunc('hour', sale_ts) AS bucket, sum(qty) AS total FROM hx GROUP BY ALL),
b AS (SELECT product_code, min(bucket) AS b0, max(bucket) AS b1 FROM g GROUP BY ALL),
s AS (SELECT product_code, unnest(generate_series(b0, b1, INTERVAL 1 HOUR)) AS bucket FROM b)
SELECT s.product_code, strftime(s.bucket, '%Y-%m-%d %H:%M:%S') AS bucket, {r('coalesce(total, 0.0)')} AS total
FROM s LEFT JOIN g ON g.product_code = s.product_code AND g.bucket = s.bucket
""")
def q_hourly_resample(spark, d):
    g = R.resample(hourly_transactions(spark, d), "hour")
    return g.select("product_code", F.date_format("bucket", "yyyy-MM-dd HH:mm:ss").alias("bucket"),
                    rnd("total").alias("total"))


@register("weekly_resample", "A6", sql=with_(tx_cte()) + f"""
, g AS (SELECT product_code, CAST(sale_date + CAST(7 - isodow(sale_date) AS INTEGER) AS DATE) AS bucket, sum(qty) AS total
        FROM tx GROUP BY ALL),
b AS (SELECT product_code, min(bucket) AS b0, max(bucket) AS b1 FROM g GROUP BY ALL),
s AS (SELECT product_code, CAST(unnest(generate_series(b0, b1, INTERVAL 7 DAY)) AS DATE) AS bucket FROM b)
SELECT s.product_code, CAST(s.bucket AS VARCHAR) AS bucket, {r('coalesce(total, 0.0)')} AS total
FROM s LEFT JOIN g ON g.product_code = s.product_code AND g.bucket = s.bucket
""")
def q_weekly_resample(spark, d):
    g = R.resample(transactions(spark, d), "week", ts="sale_date")
    return g.select("product_code", dstr("bucket"), rnd("total").alias("total"))


@register("monthly_resample", "A6", sql=with_(tx_cte()) + f"""
, g AS (SELECT product_code, last_day(sale_date) AS bucket, sum(qty) AS total FROM tx GROUP BY ALL),
b AS (SELECT product_code, min(bucket) AS b0, max(bucket) AS b1 FROM g GROUP BY ALL),
s AS (SELECT product_code, last_day(CAST(unnest(generate_series(date_trunc('month', b0), date_trunc('month', b1),
                                                  INTERVAL 1 MONTH)) AS DATE)) AS bucket FROM b)
SELECT s.product_code, CAST(s.bucket AS VARCHAR) AS bucket, {r('coalesce(total, 0.0)')} AS total
FROM s LEFT JOIN g ON g.product_code = s.product_code AND g.bucket = s.bucket
""")
def q_monthly_resample(spark, d):
    g = R.resample(transactions(spark, d), "month", ts="sale_date")
    return g.select("product_code", dstr("bucket"), rnd("total").alias("total"))


# Dense daily series (J4 + W8) shared by the series statistics below.
DENSE_SQL = """bounds AS (SELECT product_code, min(sale_date) AS d0, max(sale_date) AS d1, avg(list_price) AS mlp
            FROM daily GROUP BY product_code),
spine AS (SELECT product_code, mlp, CAST(unnest(generate_series(d0, d1, INTERVAL 1 DAY)) AS DATE) AS sale_date FROM bounds),
dense AS (
  SELECT s.product_code, s.sale_date, coalesce(d.qty, 0.0) AS qty, coalesce(d.gross_amount, 0.0) AS gross_amount,
         coalesce(d.promo_count, 0) AS promo_count, coalesce(d.list_price, s.mlp) AS list_price
  FROM spine s LEFT JOIN daily d ON d.product_code = s.product_code AND d.sale_date = s.sale_date)"""


def dense_daily(spark, d, last=None, runs=False):
    """J4 + W8: gap-free daily product series (qty 0 on no-sale days); ``last`` names a column for the series' last day,
    ``runs`` gives a row for a day and the empty days after it."""
    return daily_grid(daily_product_sales(spark, d).select("product_code", "sale_date", "qty", "gross_amount",
                                                           "promo_count", "list_price"), last=last, runs=runs)


@register("dense_daily_series", "J4 W8", sql=with_(tx_cte(), DAILY_SQL, DENSE_SQL) + f"""
SELECT product_code, CAST(sale_date AS VARCHAR) AS sale_date, {r('qty')} AS qty, {r('gross_amount')} AS gross_amount,
       promo_count, {r('list_price')} AS list_price FROM dense
""")
def q_dense_daily_series(spark, d):
    g = dense_daily(spark, d)
    return g.select("product_code", dstr("sale_date"), rnd("qty").alias("qty"),
                    rnd("gross_amount").alias("gross_amount"), "promo_count", rnd("list_price").alias("list_price"))


@register("series_autocorrelation", "A9", sql=with_(tx_cte(), DAILY_SQL, DENSE_SQL) + f"""
, l AS (SELECT product_code, qty, {", ".join(f"lag(qty, {k}) OVER (PARTITION BY product_code ORDER BY sale_date) AS l{k}" for k in range(1, 8))}
        FROM dense)
SELECT product_code, {r('avg(qty)')} AS mean, {r('stddev_samp(qty)')} AS std, {r('min(qty)')} AS min, {r('max(qty)')} AS max,
       {", ".join(r(f"corr(qty, l{k})") + f" AS autocorr_lag{k}" for k in range(1, 8))}
FROM l GROUP BY product_code
""")
def q_series_autocorrelation(spark, d):
    g = R.autocorrelation(dense_daily(spark, d))
    return g.select("product_code", *[rnd(c).alias(c) for c in g.columns if c != "product_code"])


@register("daily_series_stats", "A33", sql=with_(tx_cte(), DAILY_SQL, DENSE_SQL) + f"""
SELECT product_code, count(*) AS days, count(*) FILTER (WHERE qty > 0) AS sale_days,
       count(*) FILTER (WHERE qty = 0) AS zero_days, {r('sum(qty)')} AS total,
       {r('avg(qty) FILTER (WHERE qty > 0)')} AS pos_mean, {r('stddev_samp(qty) FILTER (WHERE qty > 0)')} AS pos_std,
       {r('median(qty) FILTER (WHERE qty > 0)')} AS pos_median, {r('min(qty) FILTER (WHERE qty > 0)')} AS pos_min,
       {r('max(qty) FILTER (WHERE qty > 0)')} AS pos_max
FROM dense GROUP BY product_code
""")
def q_daily_series_stats(spark, d):
    g = R.daily_series_stats(dense_daily(spark, d))
    ints = ("product_code", "days", "sale_days", "zero_days")
    return g.select(*ints, *[rnd(c).alias(c) for c in g.columns if c not in ints])


@register("weekday_profile_daily", "A34", sql=with_(tx_cte(), DAILY_SQL, DENSE_SQL) + f"""
, g AS (SELECT product_code, isodow(sale_date) - 1 AS weekday, count(*) AS n, sum(qty) AS total,
               avg(qty) AS mean, stddev_samp(qty) AS std FROM dense GROUP BY ALL),
s AS (SELECT product_code, unnest(range(0, 7)) AS weekday FROM (SELECT DISTINCT product_code FROM dense))
SELECT s.product_code, CAST(s.weekday AS INT) AS weekday, coalesce(n, 0) AS n, {r('coalesce(total, 0.0)')} AS total,
       {r('coalesce(mean, 0.0)')} AS mean, {r('std')} AS std
FROM s LEFT JOIN g ON g.product_code = s.product_code AND g.weekday = s.weekday
""")
def q_weekday_profile_daily(spark, d):
    g = R.weekday_stats(dense_daily(spark, d))
    return g.select("product_code", "weekday", "n", *[rnd(c).alias(c) for c in ("total", "mean", "std")])


@register("month_profile_daily", "A34", sql=with_(tx_cte(), DAILY_SQL, DENSE_SQL) + f"""
SELECT product_code, CAST(month(sale_date) AS INT) AS month, count(*) AS n, {r('sum(qty)')} AS total,
       {r('avg(qty)')} AS mean, {r('stddev_samp(qty)')} AS std FROM dense GROUP BY ALL
""")
def q_month_profile_daily(spark, d):
    g = R.month_stats(dense_daily(spark, d))
    return g.select("product_code", "month", "n", *[rnd(c).alias(c) for c in ("total", "mean", "std")])


@register("daily_qty_distribution", "A35", sql=with_(tx_cte(), DAILY_SQL, DENSE_SQL) + """
SELECT product_code, qty, count(*) AS days FROM dense GROUP BY ALL
""")
def q_daily_qty_distribution(spark, d):
    return R.value_distribution(dense_daily(spark, d))


@register("product_list", "A36 U3", sql=with_(tx_cte(part=True)) + f"""
SELECT product_code, min(product_name) AS product_name, {r('avg(list_price)')} AS avg_price, count(*) AS "rows"
FROM tx GROUP BY product_code
""")
def q_product_list(spark, d):
    g = R.product_list(transactions(spark, d, part=True))
    return g.select("product_code", "product_name", rnd("avg_price").alias("avg_price"), "rows")
