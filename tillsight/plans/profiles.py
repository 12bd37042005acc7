"""Validation, profiling and filter queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as PF
from ..operators.clean import clock_in_range, filter_dates, hour_in_range, is_complete, is_positive, is_priced, is_return
from ..sources.starschema import hourly_transactions, transactions
from .registry import register
from .sales import DAILY_SQL, daily_product_sales
from .sqlparts import hx_cte, out_cols, out_sql, tx_cte, with_

V1_SPEC = "missing_columns:s rows:l nulls_product_code:l nulls_qty:l nulls_gross_amount:l"


@register("required_columns_check", "V1", sql=with_(tx_cte()) + f"""
SELECT {out_sql(V1_SPEC)} FROM (
  SELECT '' AS missing_columns, count(*) AS rows, count(*) FILTER (WHERE product_code IS NULL) AS nulls_product_code,
         count(*) FILTER (WHERE qty IS NULL) AS nulls_qty, count(*) FILTER (WHERE gross_amount IS NULL) AS nulls_gross_amount
  FROM tx)
""")
def q_required_columns_check(spark, d):
    tx = transactions(spark, d)
    req = ["product_code", "qty", "gross_amount"]
    return PF.required_columns(tx, req, req).select(*out_cols(V1_SPEC))


V2_SPEC = "rows:l columns:i first_date:d last_date:d products:l categories:l members:l non_member_rows:l"


@register("load_profile", "V2 S1", sql=with_(tx_cte(orders=True, part=True)) + f"""
SELECT {out_sql(V2_SPEC)} FROM (
  SELECT count(*) AS rows, 17 AS columns, min(sale_date) AS first_date, max(sale_date) AS last_date,
         count(DISTINCT product_code) AS products, count(DISTINCT category_code) AS categories,
         count(DISTINCT member_id) AS members, count(*) FILTER (WHERE member_id IS NULL) AS non_member_rows FROM tx)
""")
def q_load_profile(spark, d):
    tx = transactions(spark, d, orders=True, part=True)
    return PF.load_profile(tx).select(*out_cols(V2_SPEC))


TX_COLS = ["store_code", "product_code", "order_id", "line_no", "sale_date", "touchpoint", "list_price", "discount_type",
           "tax_rate", "qty", "gross_amount", "discount_amount", "net_amount", "member_id", "channel", "category_code",
           "product_name"]
V3_SPEC = "table_name:s column_name:s nulls:l"


@register("null_counts_by_column", "V3", sql=with_(tx_cte(orders=True, part=True)) + f"""
SELECT {out_sql(V3_SPEC)} FROM (
  {" UNION ALL ".join(f"SELECT 'transactions' AS table_name, '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS nulls FROM tx" for c in TX_COLS)})
""")
def q_null_counts_by_column(spark, d):
    tx = transactions(spark, d, orders=True, part=True, marks=TX_COLS).select(*TX_COLS)
    return PF.null_counts(tx, "transactions").select(*out_cols(V3_SPEC))


V4_SPEC = "table_name:s rows:l columns:i first_date:d last_date:d null_cells:l"


@register("table_summaries", "V4", sql=with_(tx_cte(), hx_cte()) + f"""
SELECT {out_sql(V4_SPEC)} FROM (
  SELECT 'transactions' AS table_name, count(*) AS rows, 13 AS columns, min(sale_date) AS first_date,
         max(sale_date) AS last_date,
         sum({" + ".join(f"CAST({c} IS NULL AS BIGINT)" for c in TX_COLS[:13])}) AS null_cells FROM tx
  UNION ALL
  SELECT 'hourly', count(*), 14, min(sale_date), max(sale_date),
         sum({" + ".join(f"CAST({c} IS NULL AS BIGINT)" for c in ['store_code', 'product_code', 'order_id', 'line_no', 'sale_date', 'sale_ts', 'channel', 'category_code', 'list_price', 'discount_type', 'qty', 'gross_amount', 'discount_amount', 'net_amount'])}) FROM hx)
""")
def q_table_summaries(spark, d):
    a = PF.table_summary(transactions(spark, d), "transactions", "sale_date")
    b = PF.table_summary(hourly_transactions(spark, d), "hourly", "sale_date")
    return a.unionByName(b).select(*out_cols(V4_SPEC))


V5_SPEC = "product_code:s rows:l first_date:d"


@register("min_history_keys", "V5 A3", sql=with_(tx_cte(), DAILY_SQL) + f"""
SELECT {out_sql(V5_SPEC)} FROM (
  SELECT product_code, count(*) AS rows, min(sale_date) AS first_date FROM daily
  WHERE product_code IN (SELECT product_code FROM daily GROUP BY product_code HAVING count(*) >= 14)
  GROUP BY product_code)
""")
def q_min_history_keys(spark, d):
    kept = PF.min_history(daily_product_sales(spark, d), ["product_code"], 14)
    return kept.groupBy("product_code").agg(F.count("*").alias("rows"), F.min("sale_date").alias("first_date")) \
               .select(*out_cols(V5_SPEC))


ROWS_SPEC = ("product_code:s rows:l positive_rows:l priced_rows:l sale_rows:l return_rows:l return_qty:f "
             "complete_rows:l")


@register("row_filters_by_product", "F2 F3 F4 F10 P1", sql=with_(tx_cte(orders=True)) + f"""
SELECT {out_sql(ROWS_SPEC)} FROM (
  SELECT product_code, count(*) AS rows,
         count(*) FILTER (WHERE gross_amount > 0 AND qty > 0) AS positive_rows,
         count(*) FILTER (WHERE qty > 0 AND gross_amount > 0 AND list_price > 0) AS priced_rows,
         count(*) FILTER (WHERE qty >= 0) AS sale_rows, count(*) FILTER (WHERE qty < 0) AS return_rows,
         coalesce(sum(qty) FILTER (WHERE qty < 0), 0.0) AS return_qty,
         count(*) FILTER (WHERE {" AND ".join(f"{c} IS NOT NULL" for c in TX_COLS[:15])}) AS complete_rows
  FROM tx GROUP BY product_code)
""")
def q_row_filters_by_product(spark, d):
    used = {"product_code", "qty", "gross_amount", "list_price"}       # of the others only nulls matter
    tx = transactions(spark, d, orders=True, marks=set(TX_COLS) - used).select(*TX_COLS[:15])
    tx = tx.withColumn("qty", PF.to_number(F.col("qty").cast("string")))
    out = tx.groupBy("product_code").agg(
        F.count("*").alias("rows"), F.count_if(is_positive()).alias("positive_rows"),
        F.count_if(is_priced()).alias("priced_rows"), F.count_if(~is_return()).alias("sale_rows"),
        F.count_if(is_return()).alias("return_rows"),
        F.coalesce(F.sum(F.when(is_return(), F.col("qty"))), F.lit(0.0)).alias("return_qty"),
        F.count_if(is_complete(TX_COLS[:15])).alias("complete_rows"))
    return out.select(*out_cols(ROWS_SPEC))


WIN_SPEC = "product_code:s rows:l night_rows:l day_rows:l clock_rows:l"


@register("hour_window_filters", "F6 F9", sql=with_(hx_cte()) + f"""
SELECT {out_sql(WIN_SPEC)} FROM (
  SELECT product_code, count(*) AS rows,
         count(*) FILTER (WHERE hour(sale_ts) >= 22 OR hour(sale_ts) <= 2) AS night_rows,
         count(*) FILTER (WHERE hour(sale_ts) >= 8 AND hour(sale_ts) <= 20) AS day_rows,
         count(*) FILTER (WHERE strftime(sale_ts, '%H:%M') >= '21:30' OR strftime(sale_ts, '%H:%M') <= '01:15') AS clock_rows
  FROM hx GROUP BY product_code)
""")
def q_hour_window_filters(spark, d):
    hx = hourly_transactions(spark, d)
    out = hx.groupBy("product_code").agg(
        F.count("*").alias("rows"), F.count_if(hour_in_range("sale_ts", 22, 2)).alias("night_rows"),
        F.count_if(hour_in_range("sale_ts", 8, 20)).alias("day_rows"),
        F.count_if(clock_in_range(F.col("sale_ts"), "21:30", "01:15")).alias("clock_rows"))
    return out.select(*out_cols(WIN_SPEC))


DR_SPEC = "product_code:s rows:l qty:f"


@register("recent_date_range", "F7 F5", sql=with_(tx_cte()) + f"""
SELECT {out_sql(DR_SPEC)} FROM (
  SELECT product_code, count(*) AS rows, sum(qty) AS qty FROM tx, (SELECT max(sale_date) AS m FROM tx) mx
  WHERE sale_date BETWEEN CAST(m - 27 AS DATE) AND m GROUP BY product_code)
""")
def q_recent_date_range(spark, d):
    tx = transactions(spark, d)
    last = tx.agg(F.max("sale_date")).first()[0]     # one scalar: the data's last business day
    from datetime import timedelta
    r = filter_dates(tx, str(last - timedelta(days=27)), str(last))
    return r.groupBy("product_code").agg(F.count("*").alias("rows"), F.sum("qty").alias("qty")).select(*out_cols(DR_SPEC))


PARSE_SPEC = "order_id:s parsed:t amount:f bad_amount:f"


@register("parse_and_coerce", "P1 P2 S3", sql=with_(hx_cte()) + f"""
SELECT {out_sql(PARSE_SPEC)} FROM (
  SELECT order_id,
         CASE WHEN line_no % 3 = 0 THEN CAST(sale_date AS TIMESTAMP) + INTERVAL 12 HOUR
              ELSE date_trunc('minute', sale_ts) END AS parsed,
         CAST(regexp_extract(regexp_replace(CAST(gross_amount AS VARCHAR), '', ''), '([0-9.]+)', 1) AS DOUBLE) AS amount,
         CAST(NULL AS DOUBLE) AS bad_amount FROM hx)
""")
def q_parse_and_coerce(spark, d):
    """Till text as exported (two layouts, a third of rows date-only) parsed back; amounts coerced."""
    hx = hourly_transactions(spark, d)
    text = F.when(F.col("line_no") % 3 == 0, F.date_format("sale_ts", "yyyy/MM/dd")) \
            .otherwise(F.date_format("sale_ts", "yyyy/MM/dd HH:mm"))
    g = hx.select("order_id", PF.parse_till_time(text).alias("parsed"),
                  PF.to_number(F.col("gross_amount").cast("string")).alias("amount"),
                  PF.to_number(F.concat(F.lit("x"), F.col("order_id"))).alias("bad_amount"))
    return g.select(*out_cols(PARSE_SPEC))
