"""Validation and profiling.

All of them are single-pass aggregations (null counts for every column come
from one ``agg`` and are unpivoted with ``stack``), so profiling a 100 TB
table costs one scan.
"""

from __future__ import annotations

from typing import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def required_columns(df: DataFrame, required: Sequence[str], critical: Sequence[str]) -> DataFrame:
    """V1: one row: missing required columns (comma list, '' if none) + null count per critical column."""
    missing = [c for c in required if c not in df.columns]
    aggs = [F.count_if(F.col(c).isNull()).alias(f"nulls_{c}") for c in critical if c in df.columns]
    return df.agg(F.lit(",".join(missing)).alias("missing_columns"), F.count("*").alias("rows"), *aggs)


def load_profile(tx: DataFrame) -> DataFrame:
    """V2: rows, columns, date span, distinct products / categories / members, non-member rows."""
    return tx.agg(F.count("*").alias("rows"), F.lit(len(tx.columns)).alias("columns"),
                  F.min("sale_date").alias("first_date"), F.max("sale_date").alias("last_date"),
                  F.count_distinct("product_code").alias("products"),
                  F.count_distinct("category_code").alias("categories"),
                  F.count_distinct("member_id").alias("members"),
                  F.count_if(F.col("member_id").isNull()).alias("non_member_rows"))


def null_counts(df: DataFrame, table: str) -> DataFrame:
    """V3: (table, column, nulls) for every column, from one aggregation + ``stack``."""
    cols = df.columns
    agg = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"c{i}") for i, c in enumerate(cols)])
    pairs = ", ".join(f"'{c}', c{i}" for i, c in enumerate(cols))
    return agg.select(F.lit(table).alias("table_name"),
                      F.expr(f"stack({len(cols)}, {pairs}) AS (column_name, nulls)"))


def table_summary(df: DataFrame, table: str, date_col: str | None) -> DataFrame:
    """V4: rows, columns, date range, total null cells of one table."""
    nulls = sum((F.col(f"`{c}`").isNull().cast("long") for c in df.columns), F.lit(0).cast("long"))
    return df.agg(F.lit(table).alias("table_name"), F.count("*").alias("rows"), F.lit(len(df.columns)).alias("columns"),
                  (F.min(date_col) if date_col else F.lit(None).cast("date")).alias("first_date"),
                  (F.max(date_col) if date_col else F.lit(None).cast("date")).alias("last_date"),
                  F.sum(nulls).alias("null_cells"))


def min_history(df: DataFrame, keys: Iterable[str], min_rows: int) -> DataFrame:
    """V5: keep keys with at least ``min_rows`` rows (grouped count + ``left_semi``;
    the source raised for a single key, here short keys are dropped)."""
    keys = list(keys)
    ok = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= min_rows).select(*keys)
    return df.join(ok, keys, "left_semi")


def drop_incomplete(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """drop rows with a null in any (or the given) column."""
    return df.dropna(subset=list(cols) if cols else None)


def parse_till_time(text) -> F.Column:
    """P2: 'yyyy/MM/dd HH:mm' (or 'yyyy-MM-dd HH:mm:ss') -> timestamp; a date-only value
    becomes 12:00 of that day; anything else -> null."""
    t = F.try_to_timestamp(text, F.lit("yyyy/MM/dd HH:mm"))
    t2 = F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss"))
    d = F.try_to_timestamp(text, F.lit("yyyy/MM/dd"))
    return F.coalesce(t, t2, d + F.expr("INTERVAL 12 HOURS"))


def to_number(c) -> F.Column:
    """Any value -> double, malformed -> null."""
    return F.expr(f"try_cast({c} AS DOUBLE)") if isinstance(c, str) else c.try_cast("double")


def round_money(df: DataFrame, cols: Sequence[str], digits: int = 2) -> DataFrame:
    """Half-even rounding of money columns (pandas ``round``)."""
    return df.select(*[F.bround(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns])


def finite_or_zero(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """NaN / +-inf -> null -> 0 before training."""
    def fix(c):
        x = F.col(c)
        return F.coalesce(F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x), F.lit(0.0)).alias(c)
    return df.select(*[fix(c) if c in cols else F.col(c) for c in df.columns])
