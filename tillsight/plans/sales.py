"""Daily / slot sales series queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.expr import dstr, rnd
from ..operators.aggregate import daily_aggregate
from ..operators.clean import base_fields, filter_sales
from ..sources.starschema import transactions
from .registry import register
from .sqlparts import PROMO, r, tx_cte, with_


def daily_product_sales(spark, sf_dir):
    """F1 -> P4/P8 -> A3 daily series per product (all stores, returns removed)."""
    tx = filter_sales(transactions(spark, sf_dir))
    return daily_aggregate(base_fields(tx, with_slot=False), keys=("product_code",))


DAILY_SQL = f"""daily AS (
  SELECT product_code, sale_date,
         sum(qty) AS qty, sum(gross_amount) AS gross_amount, sum(net_amount) AS net_amount,
         sum(discount_amount) AS discount_amount, avg(list_price) AS list_price,
         CAST(sum({PROMO}) AS BIGINT) AS promo_count
  FROM tx WHERE qty > 0 AND qty >= 0
  GROUP BY product_code, sale_date
)"""


@register("daily_sales_ma7", "S1 F1 P4 P5 P8 A3 W2 W3", sql=with_(tx_cte(), DAILY_SQL) + f"""
SELECT product_code, CAST(sale_date AS VARCHAR) AS sale_date,
       {r('qty')} AS qty, {r('gross_amount', 2)} AS gross_amount,
       promo_count, CAST(promo_count > 0 AS INT) AS is_promo,
       {r('CASE WHEN qty > 0 THEN (gross_amount - discount_amount) / qty END')} AS avg_price,
       {r('CASE WHEN gross_amount > 0 THEN 1 - discount_amount / gross_amount END')} AS discount_rate,
       {r('avg(qty) OVER w7')} AS qty_ma7,
       {r('stddev_samp(qty) OVER w7')} AS qty_std7
FROM daily
WINDOW w7 AS (PARTITION BY product_code ORDER BY sale_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)
""")
def q_daily_sales_ma7(spark, sf_dir):
    """Flagship: daily product sales with 7-row moving average and realised discount rate."""
    d = daily_product_sales(spark, sf_dir)
    w7 = Window.partitionBy("product_code").orderBy("sale_date").rowsBetween(-6, 0)
    return d.select(
        "product_code", dstr("sale_date"),
        rnd("qty").alias("qty"), rnd("gross_amount", 2).alias("gross_amount"),
        "promo_count", "is_promo",
        rnd("avg_price").alias("avg_price"),
        rnd(F.when(F.col("gross_amount") > 0, 1 - F.col("discount_amount") / F.col("gross_amount"))).alias("discount_rate"),
        rnd(F.avg("qty").over(w7)).alias("qty_ma7"),
        rnd(F.stddev_samp("qty").over(w7)).alias("qty_std7"),
    )
