"""Adapter: driver star-schema tables -> canonical till transactions.

Every column is defined once as SQL expression text.  The Spark side
evaluates it with ``F.expr`` and the DuckDB oracle pastes the same text into
a CTE, so both engines do the same floating-point arithmetic.

Mapping (daily grain, from ``lineitem``):
  store = supplier, product = part, order = order key, member = customer,
  channel = order priority, touchpoint = line status, sale_date = ship date,
  returns (flag R) carry negative quantity and amounts.
Hour grain (from ``events``): one store feed, product = user, channel =
event type, qty = 1 + event_id % 5, list price = value.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import NO_DISCOUNT

_SIGN = "(CASE WHEN l_returnflag = 'R' THEN -1.0 ELSE 1.0 END)"

# (alias, expression over lineitem columns)
LINE_EXPRS = [
    ("store_code", "CAST(l_suppkey AS STRING)"),
    ("product_code", "CAST(l_partkey AS STRING)"),
    ("order_id", "CAST(l_orderkey AS STRING)"),
    ("line_no", "l_linenumber"),
    ("sale_date", "CAST(l_shipdate AS DATE)"),
    ("touchpoint", "l_linestatus"),
    ("list_price", "l_extendedprice / GREATEST(l_quantity, 1.0)"),
    ("discount_type", f"CASE WHEN l_discount = 0 THEN '{NO_DISCOUNT}' "
                      "ELSE 'p-' || CAST(CAST(floor(l_discount * 100 + 0.5) AS INT) AS STRING) END"),
    ("tax_rate", "l_tax"),
    ("qty", f"{_SIGN} * l_quantity"),
    ("gross_amount", f"{_SIGN} * l_extendedprice"),
    ("discount_amount", f"{_SIGN} * l_extendedprice * l_discount"),
    ("net_amount", f"{_SIGN} * l_extendedprice - {_SIGN} * l_extendedprice * l_discount"),
]
ORDER_EXPRS = [
    ("member_id", "CAST(o_custkey AS STRING)"),
    ("channel", "o_orderpriority"),
]
_UNIT = ("CASE p_size % 5 WHEN 0 THEN 'g' WHEN 1 THEN 'ml' WHEN 2 THEN 'cm' "
         "WHEN 3 THEN '个' ELSE '包' END")
PART_EXPRS = [
    ("category_code", "lpad(substr(p_brand, 7), 2, '0') || lpad(CAST(p_size AS STRING), 2, '0') || '0101'"),
    ("product_name", f"p_name || CAST(p_size * 10 AS STRING) || {_UNIT}"),
]

_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"
EVENT_EXPRS = [
    ("store_code", "'0'"),
    ("product_code", "CAST(user_id AS STRING)"),
    ("order_id", "CAST(event_id AS STRING)"),
    ("line_no", "event_id"),
    ("sale_date", "CAST(ts AS DATE)"),
    ("sale_ts", "CAST(ts AS TIMESTAMP)"),
    ("channel", "event_type"),
    ("category_code", "lpad(CAST(user_id % 50 AS STRING), 2, '0') || '010101'"),
    ("list_price", "value"),
    ("discount_type", f"CASE WHEN {_K} % 4 = 0 THEN '{NO_DISCOUNT}' "
                      f"ELSE 'p-' || CAST({_K} % 4 * 10 AS STRING) END"),
    ("qty", "CAST(1 + event_id % 5 AS DOUBLE)"),
    ("gross_amount", "value * (1 + event_id % 5)"),
    ("discount_amount", f"value * (1 + event_id % 5) * ({_K} % 4) / 10.0"),
    ("net_amount", f"value * (1 + event_id % 5) - value * (1 + event_id % 5) * ({_K} % 4) / 10.0"),
]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cols(exprs, marks=()):
    return [(F.when(F.expr(e).isNotNull(), F.lit(True)) if a in marks else F.expr(e)).alias(a) for a, e in exprs]


def transactions(spark: SparkSession, sf_dir: str, orders: bool = False,
                 part: bool = False, marks: Collection[str] = ()) -> DataFrame:
    """Canonical daily-grain transactions.

    ``orders`` / ``part`` add member+channel / category+name through a join;
    they are opt-in because neither join can be pruned by the optimizer and
    at scale ``lineitem JOIN orders`` is a full shuffle of both tables. Of the columns in ``marks`` only whether they hold a
    value is kept (true or null), before the joins, so that counts of nulls do not shuffle the values.
    """
    li = read_table(spark, sf_dir, "lineitem")
    df = li.select(*_cols(LINE_EXPRS, marks), "l_orderkey", "l_partkey")
    if orders:
        o = read_table(spark, sf_dir, "orders").select(
            F.col("o_orderkey").alias("l_orderkey"), *_cols(ORDER_EXPRS, marks))
        df = df.join(o, "l_orderkey", "left")
    if part:
        p = read_table(spark, sf_dir, "part").select(
            F.col("p_partkey").alias("l_partkey"), *_cols(PART_EXPRS, marks))
        df = df.join(p, "l_partkey", "left")
    return df.drop("l_orderkey", "l_partkey")


def as_hourly(events: DataFrame) -> DataFrame:
    """Canonical hour-grain transactions of event rows, stored or streamed."""
    return events.select(*_cols(EVENT_EXPRS))


def hourly_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical hour-grain transactions from the ``events`` table."""
    return as_hourly(read_table(spark, sf_dir, "events"))


# ---- oracle side ---------------------------------------------------------------

def _sql_select(exprs):
    return ",\n    ".join(f"{e} AS {a}" for a, e in exprs)


def tx_sql(orders: bool = False, part: bool = False) -> str:
    """SELECT producing the same rows as :func:`transactions` (DuckDB)."""
    cols = [_sql_select(LINE_EXPRS)]
    joins = ""
    if orders:
        cols.append(_sql_select(ORDER_EXPRS))
        joins += "\n  LEFT JOIN orders ON o_orderkey = l_orderkey"
    if part:
        cols.append(_sql_select(PART_EXPRS))
        joins += "\n  LEFT JOIN part ON p_partkey = l_partkey"
    return "SELECT\n    " + ",\n    ".join(cols) + "\n  FROM lineitem" + joins


def hx_sql() -> str:
    return "SELECT\n    " + _sql_select(EVENT_EXPRS) + "\n  FROM events"
