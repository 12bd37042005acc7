"""File sources and sinks.

Readers take an explicit schema (no inference at scale); writers go to shared
storage paths. Paths in examples and queries live under the session's
checkpoint folder, never a machine-local temp directory.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Source-system column labels of the till export, in canonical order.
TX_LABELS = {
    "sale_date": "日期", "store_code": "门店编码", "order_id": "流水单号", "member_id": "会员id",
    "sale_ts": "交易时间", "channel": "渠道名称", "touchpoint": "平台触点名称", "category_code": "小类编码",
    "product_code": "商品编码", "product_name": "商品名称", "list_price": "售价", "discount_type": "折扣类型",
    "tax_rate": "税率", "qty": "销售数量", "gross_amount": "销售金额", "net_amount": "销售净额",
    "discount_amount": "折扣金额",
}
# Schedule export labels (time slot, discount %, price, expected units / revenue / profit).
SCHEDULE_LABELS = {"time_slot": "时间段", "discount_percentage": "折扣(%)", "price": "折后价",
                   "sold": "预计销量", "revenue": "预计收入", "profit": "预计利润"}

CORRUPT = "_corrupt_record"


def tx_csv_schema(columns: Sequence[str]) -> T.StructType:
    """S1 schema: codes as strings, amounts as doubles, dates as dates, timestamps as timestamps."""
    kinds = {"sale_date": T.DateType(), "sale_ts": T.TimestampType(), "list_price": T.DoubleType(),
             "tax_rate": T.DoubleType(), "qty": T.DoubleType(), "gross_amount": T.DoubleType(),
             "net_amount": T.DoubleType(), "discount_amount": T.DoubleType(), "line_no": T.IntegerType()}
    return T.StructType([T.StructField(TX_LABELS.get(c, c), kinds.get(c, T.StringType()), True) for c in columns])


def write_tx_csv(tx: DataFrame, path: str) -> str:
    """S7 (csv): canonical frame written with the source-system labels and date formats."""
    out = tx.select(*[(F.date_format(c, "yyyy/MM/dd") if c == "sale_date" else
                       F.date_format(c, "yyyy/MM/dd HH:mm") if c == "sale_ts" else F.col(c)).alias(TX_LABELS.get(c, c))
                      for c in tx.columns])
    out.write.mode("overwrite").option("header", True).csv(path)
    return path


def read_tx_csv(spark: SparkSession, path: str, columns: Sequence[str], tolerant: bool = True,
                staging: str | None = None):
    """S1 + S3: read the till export with an explicit schema. With ``tolerant`` the
    CSV is parsed once in PERMISSIVE mode into a parquet staging table (corrupt
    record column included) under ``staging``; clean rows and quarantined raw
    records are then split from that table. Returns (clean frame, quarantine)."""
    schema = tx_csv_schema(columns)
    if tolerant:
        schema = schema.add(T.StructField(CORRUPT, T.StringType(), True))
    df = (spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE" if tolerant else "FAILFAST")
          .option("dateFormat", "yyyy/MM/dd").option("timestampFormat", "yyyy/MM/dd HH:mm")
          .option("columnNameOfCorruptRecord", CORRUPT).csv(path))
    if not tolerant:
        return df.toDF(*columns), None
    staging = staging or path.rstrip("/") + "_parsed"
    df.write.mode("overwrite").parquet(staging)
    parsed = spark.read.parquet(staging)
    good = parsed.where(F.col(CORRUPT).isNull()).drop(CORRUPT).toDF(*columns)
    bad = parsed.where(F.col(CORRUPT).isNotNull()).select(CORRUPT)
    return good, bad


def quarantined_fields(bad: DataFrame, columns: Sequence[str]) -> DataFrame:
    """S3: the quarantined records with their fields as text, named as the columns of the export, beside the raw record."""
    fields = ", ".join(f"f{i} string" for i in range(len(columns)))
    return bad.select(CORRUPT, F.from_csv(F.col(CORRUPT), fields).alias("_f")).select(
        CORRUPT, *[F.col(f"_f.f{i}").alias(c) for i, c in enumerate(columns)])


def count_rows(bad: DataFrame) -> int:
    """Row count of a quarantine frame (aggregates the whole record, never the corrupt column alone)."""
    return bad.count()


def save_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> str:
    """Write by suffix (.csv -> csv with header, anything else parquet), optionally partitioned."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if path.endswith(".csv"):
        w.option("header", True).csv(path)
    else:
        w.parquet(path)
    return path


def append_new_days(spark: SparkSession, stored_path: str, fresh: DataFrame, date_col: str = "date") -> DataFrame:
    """Incremental append: rows of ``fresh`` newer than the stored high-water mark
    (``max(date)``; every row when nothing is stored) are appended; returns the table."""
    hwm = None
    try:
        stored = spark.read.parquet(stored_path)
    except AnalysisException as e:      # only a missing table means that nothing is stored yet
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    else:
        hwm = stored.agg(F.max(date_col)).first()[0]
    new = fresh if hwm is None else fresh.where(F.col(date_col) > F.lit(hwm))
    new.write.mode("append").parquet(stored_path)
    return spark.read.parquet(stored_path)


PLAN_SCHEMA = ("plan_id string, total_profit double, segments array<struct<t:int, discount:double, sold:bigint, "
               "price:double, revenue:double, profit:double>>")


def save_plans_json(plan_rows: DataFrame, path: str) -> str:
    """One JSON document per plan (segments nested, non-ASCII kept)."""
    nested = plan_rows.groupBy("plan_id").agg(
        F.max("total_profit").alias("total_profit"),
        F.array_sort(F.collect_list(F.struct("t", "discount", "sold", "price", "revenue", "profit"))).alias("segments"))
    nested.write.mode("overwrite").json(path)
    return path


def load_plans_json(spark: SparkSession, path: str) -> DataFrame:
    """Read plans back with the fixed schema and explode to segment rows."""
    p = spark.read.schema(PLAN_SCHEMA).json(path)
    return p.select("plan_id", "total_profit", F.explode("segments").alias("s")).select("plan_id", "total_profit", "s.*")


def export_schedule(plan_rows: DataFrame, path: str) -> str:
    """S10 + T1: schedule table with the export labels, sorted at output, as CSV."""
    out = plan_rows.orderBy("plan_id", "t").select("plan_id", *[F.col(c).alias(v) for c, v in SCHEDULE_LABELS.items()])
    out.write.mode("overwrite").option("header", True).csv(path)   # range-partitioned by the sort, no single task
    return path
