"""Source / sink round trips and composite feature rows."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from ..operators import features as FT
from ..operators import pricing as PR
from ..operators import scenario as SC
from ..sources import files as FS
from ..sources.dims import calendar_from_dates, calendar_years_from, calendar_years_sql, weather_from_dates, holiday_sql
from ..sources.starschema import transactions
from ..session import cut_lineage, ensure_checkpoint_dir
from .calendar import fact_dates, year_range_dates
from .registry import REGISTRY, register
from .sqlparts import dates_cte, out_cols, out_sql, tx_cte, weather_cte, with_


def scratch(spark, name: str, sf_dir: str) -> str:
    """A path under the cluster's shared checkpoint folder, unique per input folder."""
    tag = hashlib.sha1(sf_dir.encode()).hexdigest()[:10]
    return ensure_checkpoint_dir(spark).rstrip("/") + f"/tables/{name}_{tag}"


CSV_SPEC = "product_code:s rows:l qty:f gross_amount:f first_date:d quarantined:l"


@register("csv_roundtrip_transactions", "S1 S3 S7", sql=with_(tx_cte()) + f"""
SELECT {out_sql(CSV_SPEC)} FROM (
  SELECT product_code, count(*) AS rows, sum(qty) AS qty, sum(gross_amount) AS gross_amount,
         min(sale_date) AS first_date, 0 AS quarantined FROM tx GROUP BY product_code)
""")
def q_csv_roundtrip_transactions(spark, d):
    """Till export written as labelled CSV, read back with an explicit schema; malformed
    rows would be quarantined (none here)."""
    tx = transactions(spark, d)
    cols = tx.columns
    path = FS.write_tx_csv(tx, scratch(spark, "tx_csv", d))
    good, bad = FS.read_tx_csv(spark, path, cols)
    n_bad = FS.count_rows(bad)
    return good.groupBy("product_code").agg(
        F.count("*").alias("rows"), F.sum("qty").alias("qty"), F.sum("gross_amount").alias("gross_amount"),
        F.min("sale_date").alias("first_date"), F.lit(n_bad).alias("quarantined")).select(*out_cols(CSV_SPEC))


BAD_SPEC = "product_code:s rows:l qty:f bad_qty:l bad_price:l"
_BAD_QTY, _BAD_PRICE = "CAST(order_id AS BIGINT) % 23 = 0", "CAST(order_id AS BIGINT) % 29 = 0"


@register("csv_quarantine_by_product", "S1 S3 S7", sql=with_(tx_cte()) + f"""
SELECT {out_sql(BAD_SPEC)} FROM (
  SELECT product_code, count(*) FILTER (WHERE NOT ({_BAD_QTY}) AND NOT ({_BAD_PRICE})) AS rows,
         coalesce(sum(qty) FILTER (WHERE NOT ({_BAD_QTY}) AND NOT ({_BAD_PRICE})), 0.0) AS qty,
         count(*) FILTER (WHERE {_BAD_QTY}) AS bad_qty, count(*) FILTER (WHERE {_BAD_PRICE}) AS bad_price
  FROM tx GROUP BY product_code)
""")
def q_csv_quarantine_by_product(spark, d):
    """A till export in which some tills wrote words for numbers: clean rows are summed, quarantined records are read
    back from their raw text and counted by product and by the field at fault."""
    tx = transactions(spark, d)
    damaged = tx.withColumn("qty", F.expr(f"CASE WHEN {_BAD_QTY} THEN 'n/a' ELSE CAST(qty AS STRING) END")) \
                .withColumn("list_price", F.expr(f"CASE WHEN {_BAD_PRICE} THEN '?' ELSE CAST(list_price AS STRING) END"))
    path = FS.write_tx_csv(damaged, scratch(spark, "tx_csv_damaged", d))
    good, bad = FS.read_tx_csv(spark, path, tx.columns)
    bad = FS.quarantined_fields(bad, tx.columns)
    both = good.select("product_code", F.lit(1).alias("ok"), "qty", F.lit(0).alias("q"), F.lit(0).alias("p")).unionByName(
        bad.select("product_code", F.lit(0).alias("ok"), F.lit(None).cast("double").alias("qty"),
                   (F.col("qty") == "n/a").cast("int").alias("q"), (F.col("list_price") == "?").cast("int").alias("p")))
    return both.groupBy("product_code").agg(
        F.sum("ok").alias("rows"), F.coalesce(F.sum("qty"), F.lit(0.0)).alias("qty"), F.sum("q").alias("bad_qty"),
        F.sum("p").alias("bad_price")).select(*out_cols(BAD_SPEC))


W_SPEC = "date:d code_day:s high:i low:i rainfall:f"


@register("weather_incremental_append", "S6 S2", sql=with_(tx_cte(), dates_cte(), weather_cte()) + f"""
SELECT {out_sql(W_SPEC)} FROM weather
""")
def q_weather_incremental_append(spark, d):
    """Weather kept as a table: the first half of the days is stored, then a refresh
    appends only days after the stored maximum (high-water mark + anti join)."""
    days = fact_dates(spark, d)
    w = weather_from_dates(days).select("date", "code_day", "high", "low", "rainfall")
    path = scratch(spark, "weather_store", d)
    cut = days.agg(F.min("date").alias("a"), F.max("date").alias("b")).first()
    half = cut.a + (cut.b - cut.a) / 2
    w.where(F.col("date") <= F.lit(half)).write.mode("overwrite").parquet(path)
    table = FS.append_new_days(spark, path, w)
    return table.select(*out_cols(W_SPEC))


def _stag_sql():
    from .pricing import PLANS_SQL, _stagger_paths_sql
    return [*PLANS_SQL, _stagger_paths_sql()]


JSON_SPEC = "plan_id:s t:i discount:f sold:l price:f revenue:f profit:f total_profit:f"


@register("plan_json_roundtrip", "S9 D14", sql=with_(*_stag_sql()) + f"""
SELECT {out_sql(JSON_SPEC)} FROM (
  SELECT plan_id, t, discount, sold, base_price * discount AS price, base_price * discount * sold AS revenue,
         (base_price * discount - cost_price) * sold AS profit, total_profit FROM stag)
""")
def q_plan_json_roundtrip(spark, d):
    from ..operators import pricing as PR
    from .pricing import plan_requests
    plan = PR.staggered_plan(plan_requests(spark, d))
    path = FS.save_plans_json(plan, scratch(spark, "plans_json", d))
    return FS.load_plans_json(spark, path).select(*out_cols(JSON_SPEC))


EXP_SPEC = "plan_id:s 时间段:s 折扣(%):f 折后价:f 预计销量:l 预计收入:f 预计利润:f"


@register("schedule_export", "S10 T1", sql=with_(*_stag_sql()) + """
SELECT plan_id,
       strftime(TIMESTAMP '2000-01-01 20:00:00' + INTERVAL (t * 30) MINUTE, '%H:%M') || '-' ||
       strftime(TIMESTAMP '2000-01-01 20:00:00' + INTERVAL (t * 30 + 30) MINUTE, '%H:%M') AS "时间段",
       floor(round((1 - discount) * 100, 1) * 10000 + 0.500001) / 10000 AS "折扣(%)",
       floor(base_price * discount * 10000 + 0.500001) / 10000 AS "折后价",
       CAST(sold AS BIGINT) AS "预计销量",
       floor(base_price * discount * sold * 10000 + 0.500001) / 10000 AS "预计收入",
       floor((base_price * discount - cost_price) * sold * 10000 + 0.500001) / 10000 AS "预计利润"
FROM stag
""")
def q_schedule_export(spark, d):
    from ..functions.expr import rnd
    from ..operators import pricing as PR
    from .pricing import plan_requests
    plan = PR.staggered_plan(plan_requests(spark, d))
    path = FS.export_schedule(plan, scratch(spark, "schedule_csv", d))
    schema = "plan_id string, `时间段` string, `折扣(%)` double, `折后价` double, `预计销量` bigint, `预计收入` double, `预计利润` double"
    back = spark.read.schema(schema).option("header", True).csv(path)
    return back.select("plan_id", "时间段", *[rnd(c).alias(c) if c != "预计销量" else F.col(c) for c in
                                             ["折扣(%)", "折后价", "预计销量", "预计收入", "预计利润"]])


PRED_SPEC = "predict_date:d slot:i rows:l mean_price:f"


@register("predictions_by_day_export", "S8 U1", sql=f"""
SELECT {out_sql(PRED_SPEC)} FROM (
  SELECT predict_date, slot, count(*) AS rows, avg(avg_price) AS mean_price
  FROM ({REGISTRY['prediction_input'].sql}) GROUP BY ALL)
""")
def q_predictions_by_day_export(spark, d):
    """Scoring rows written partitioned by prediction day, read back per day and slot."""
    pi = REGISTRY["prediction_input"].fn(spark, d)
    path = FS.save_table(pi, scratch(spark, "predictions", d), partition_by=["predict_date"])
    back = spark.read.parquet(path)
    return back.groupBy("predict_date", "slot").agg(F.count("*").alias("rows"), F.avg("avg_price").alias("mean_price")) \
               .select(*out_cols(PRED_SPEC))


CALF_SPEC = "date:d is_holiday:i holiday_impact:i is_shopping_day:i is_payday:i day_of_week:i week_of_year:i"


@register("calendar_feature_flags", "P24 P23", sql=with_(tx_cte(), dates_cte(), calendar_years_sql("dates")) + f"""
SELECT {out_sql(CALF_SPEC)} FROM (
  SELECT d.date, holiday_legal AS is_holiday,
         CASE WHEN holiday_name = '' THEN 0 WHEN holiday_type = 'holiday' THEN 4 WHEN holiday_type = 'recess' THEN 3
              WHEN (month(d.date) = 6 AND day(d.date) = 18) OR (month(d.date) = 11 AND day(d.date) = 11)
                   OR (month(d.date) = 12 AND day(d.date) = 12) THEN 2 ELSE 1 END AS holiday_impact,
         CAST((month(d.date) = 6 AND day(d.date) = 18) OR (month(d.date) = 11 AND day(d.date) = 11)
              OR (month(d.date) = 12 AND day(d.date) = 12) AS INT) AS is_shopping_day,
         CAST(day(d.date) IN (15, 30) AS INT) AS is_payday, isodow(d.date) - 1 AS day_of_week, weekofyear(d.date) AS week_of_year
  FROM dates d JOIN cyears ON cyears.ds = d.date)
""")
def q_calendar_feature_flags(spark, d):
    """P24 flags per business day with the P23 impact of the year-range calendar."""
    days = fact_dates(spark, d)
    cal = calendar_years_from(days).select(F.col("ds").alias("date"), "holiday_name", "holiday_type", "holiday_legal")
    imp = FT.holiday_impact(cal, "date").select("date", "holiday_impact", F.col("holiday_legal").alias("is_holiday"))
    f = FT.calendar_features(days.select(F.col("date").alias("sale_date")), "sale_date").withColumnRenamed("sale_date", "date")
    f = f.withColumn("day_of_week", F.weekday("date"))
    return f.join(imp, "date", "left").select(*out_cols(CALF_SPEC))


HOL_SPEC = "date:d name:s kind:s"


@register("holiday_list", "U4 J11", sql=with_(tx_cte(), dates_cte(), holiday_sql("dates").strip()) + f"""
SELECT {out_sql(HOL_SPEC)} FROM (
  SELECT date, legal_name AS name, 'legal' AS kind FROM legal
  UNION ALL SELECT date, name, 'work' FROM hdays WHERE kind = 'work'
  UNION ALL SELECT date, window_name, 'window' FROM hwin)
""")
def q_holiday_list(spark, d):
    """Holiday list of the fact's years: days off, worked weekend days and influence-window days concatenated."""
    from ..sources.dims import _holiday_frames
    held, window = _holiday_frames(fact_dates(spark, d))
    u = held.select("date", F.col("legal_name").alias("name"), F.when(F.col("kind") == "work", "work").otherwise("legal").alias("kind")) \
             .unionByName(window.select("date", F.col("window_name").alias("name"), F.lit("window").alias("kind")))
    return u.select(*out_cols(HOL_SPEC))


MERGE_SPEC = "product_code:s sale_date:d qty:f main_category:s pack_size:s is_fresh:i"


@register("merge_product_attributes", "J9 P26", sql=f"""
WITH a AS ({REGISTRY['daily_sales_ma7'].sql}), b AS ({REGISTRY['product_attributes'].sql})
SELECT a.product_code, a.sale_date, a.qty, b.main_category, b.pack_size, b.is_fresh
FROM a LEFT JOIN b ON b.product_code = a.product_code
""")
def q_merge_product_attributes(spark, d):
    """Left join of a keyed table with product attributes on a key list (no order is
    promised by Spark; callers sort at output)."""
    a = REGISTRY["daily_sales_ma7"].fn(spark, d)
    b = REGISTRY["product_attributes"].fn(spark, d)
    return a.join(b, ["product_code"], "left").select("product_code", "sale_date", "qty", "main_category",
                                                       "pack_size", "is_fresh")


ROW_SPEC_COLS = ("store_code, product_code, a.as_of, hist_avg_sales, hist_sales_std, hist_promo_sales_ratio, "
                 "a.sales_trend, last_week_sales, recent_3h_sales, avg_price, price_std, median_price, avg_discount, "
                 "discount_frequency, price_elasticity, promo_avg_sales, promo_ratio")


@register("asof_feature_row", "J12 P6", sql=f"""
WITH a AS ({REGISTRY['asof_history_features'].sql}), b AS ({REGISTRY['price_features'].sql}),
c AS ({REGISTRY['promo_hours_performance'].sql})
SELECT {ROW_SPEC_COLS} FROM a JOIN b USING (store_code, product_code) LEFT JOIN c USING (store_code, product_code)
""")
def q_asof_feature_row(spark, d):
    """One feature row per (store, product, as-of) assembled from the history (A28),
    price (A29) and promo-window (A21) groups by key joins."""
    a = REGISTRY["asof_history_features"].fn(spark, d)
    b = REGISTRY["price_features"].fn(spark, d)
    c = REGISTRY["promo_hours_performance"].fn(spark, d)
    j = a.join(b, ["store_code", "product_code"]).join(c, ["store_code", "product_code"], "left")
    return j.select(*[x.strip().split(".")[-1] for x in ROW_SPEC_COLS.split(",")])


# Feature row of a model: name, type, default where a group knows nothing of the key.
FEATURE_ROW = [
    ("store_code", "string", None), ("product_code", "string", None), ("as_of", "string", None),
    ("hour_of_day", "int", 0), ("day_of_week", "int", 0), ("month", "int", 1), ("weekend", "int", 0), ("quarter", "int", 1),
    ("time_to_promo_start", "int", 0), ("time_to_promo_end", "int", 0), ("in_promotion_time", "int", 0), ("is_month_end", "int", 0),
    ("hist_avg_sales", "double", 0.0), ("hist_sales_std", "double", 0.0), ("hist_promo_sales_ratio", "double", 1.2),
    ("sales_trend", "double", 0.0), ("last_week_sales", "double", 0.0), ("recent_3h_sales", "double", 0.0),
    ("avg_price", "double", 0.0), ("price_std", "double", 0.0), ("median_price", "double", 0.0), ("avg_discount", "double", 1.0),
    ("discount_frequency", "double", 0.0), ("price_elasticity", "double", 1.2),
    ("temperature", "double", 20.0), ("rainfall", "double", 0.0), ("weather_severity", "int", 0), ("temp_band", "string", "medium"), ("bad_weather", "int", 0),
    ("is_holiday", "int", 0), ("holiday_kind", "string", "普通日"), ("prev_day_holiday", "int", 0), ("next_day_holiday", "int", 0), ("holiday_streak", "long", 0),
    ("main_category", "string", "00"), ("pack_size_num", "double", 0.0), ("is_fresh", "int", 0), ("shelf_life_hours", "int", 168),
    ("competitor_price", "double", 0.0),
]


def _row_sql():
    groups = {"h": "hist_avg_sales hist_sales_std hist_promo_sales_ratio sales_trend last_week_sales recent_3h_sales",
              "p": "avg_price price_std median_price avg_discount discount_frequency price_elasticity",
              "w": "temperature rainfall weather_severity temp_band bad_weather",
              "c": "is_holiday holiday_kind prev_day_holiday next_day_holiday holiday_streak",
              "a": "main_category pack_size_num is_fresh shelf_life_hours",
              "b": "hour_of_day day_of_week month weekend quarter time_to_promo_start time_to_promo_end in_promotion_time is_month_end"}
    at = {c: f"{g}.{c}" for g, cs in groups.items() for c in cs.split()}
    sql_type = {"string": "VARCHAR", "int": "INTEGER", "long": "BIGINT", "double": "DOUBLE"}
    lit = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else repr(v)
    cols = []
    for n, t, default in FEATURE_ROW:
        e = at.get(n, f"h.{n}" if n in ("store_code", "product_code", "as_of") else lit(default))
        cols.append(f"CAST({e if default is None else f'coalesce({e}, {lit(default)})'} AS {sql_type[t]}) AS {n}")
    return f"""
WITH h AS ({REGISTRY['asof_history_features'].sql}), p AS ({REGISTRY['price_features'].sql}),
a AS ({REGISTRY['product_attributes'].sql}), w0 AS ({REGISTRY['weather_hourly_feed'].sql}), c0 AS ({REGISTRY['holidays_hourly_feed'].sql}),
t AS (SELECT *, CAST(as_of AS TIMESTAMP) AS ts FROM h),
b AS (SELECT store_code, product_code, hour(ts) AS hour_of_day, isodow(ts) - 1 AS day_of_week, month(ts) AS month,
             CAST(isodow(ts) >= 6 AS INT) AS weekend, quarter(ts) AS quarter,
             (((20 - hour(ts)) % 24) + 24) % 24 AS time_to_promo_start, (((22 - hour(ts)) % 24) + 24) % 24 AS time_to_promo_end,
             CAST(hour(ts) >= 20 AND hour(ts) < 22 AS INT) AS in_promotion_time, CAST(day(ts) >= 25 AS INT) AS is_month_end FROM t)
SELECT {", ".join(cols)}
FROM h JOIN b USING (store_code, product_code) LEFT JOIN p USING (store_code, product_code)
LEFT JOIN a ON a.product_code = h.product_code
LEFT JOIN w0 w ON w.date = substr(h.as_of, 1, 10) LEFT JOIN c0 c ON c.date = substr(h.as_of, 1, 10)"""


@register("asof_full_feature_row", "J12 P35 P12", sql=_row_sql())
def q_asof_full_feature_row(spark, d):
    """J12 + P35: one row per (store, product) at its latest time with the base, history, price, weather, calendar and
    product groups, merged point in time and aligned to the declared schema (a column no group has gets its default)."""
    keys = ["store_code", "product_code"]
    own = lambda n: REGISTRY[n].fn(spark, d)
    hist = cut_lineage(own("asof_history_features"))
    spine = hist.select(*keys, "as_of")
    day = F.substring("as_of", 1, 10)
    dims = {n: spine.join(F.broadcast(own(q).withColumnRenamed("date", "__day")), day == F.col("__day")).drop("__day")
            for n, q in (("weather", "weather_hourly_feed"), ("calendar", "holidays_hourly_feed"))}
    product = spine.join(own("product_attributes").drop("category_code", "product_name"), "product_code")
    base = FT.asof_base_features(spine.withColumn("__text", F.col("as_of")).withColumn("as_of", F.to_timestamp("as_of")))
    base = base.withColumn("as_of", F.col("__text")).drop("__text")
    price = own("price_features").join(spine, keys)
    groups = {"history": (hist, "as_of"), "price": (price, "as_of"), "product": (product, "as_of"), "base": (base, "as_of"),
              **{n: (df, "as_of") for n, df in dims.items()}}
    row = FT.point_in_time(spine, groups, keys)
    row = row.fillna({n: v for n, t, v in FEATURE_ROW if v is not None and n in row.columns})
    return SC.align_columns(row, FEATURE_ROW)


# ---- D13: request validation ------------------------------------------------------------

REQ_SPEC = ("product_code:s initial_stock:f original_price:f cost_price:f promotion_start:s promotion_end:s min_discount:f "
            "max_discount:f time_segments:i status:s reasons:s")


@register("validated_plan_requests", "D13", sql=with_(tx_cte()) + f"""
, hist AS (SELECT product_code, avg(list_price) AS hist_price FROM tx WHERE qty > 0 AND CAST(product_code AS INT) % 13 <> 0 GROUP BY ALL),
q AS (SELECT product_code, CAST(product_code AS INT) AS k, CAST(sum(qty) AS BIGINT) AS stock, max(list_price) AS price FROM tx GROUP BY ALL),
r0 AS (SELECT product_code, CASE WHEN k % 17 = 0 THEN NULL ELSE stock - 100 END AS initial_stock, CASE WHEN k % 3 > 0 THEN price END AS original_price,
              CASE WHEN k % 5 = 0 THEN price * 0.95 END AS cost_price, '20:00' AS promotion_start,
              CASE k % 29 WHEN 0 THEN '20:00' WHEN 1 THEN '24:30' ELSE '22:00' END AS promotion_end,
              0.4 AS min_discount, CASE WHEN k % 23 = 0 THEN 1.4 ELSE 0.9 END AS max_discount, CASE WHEN k % 31 = 0 THEN 0 ELSE 4 END AS time_segments
       FROM q),
r1 AS (SELECT r0.* REPLACE (coalesce(original_price, hist_price) AS original_price) FROM r0 LEFT JOIN hist USING (product_code)),
r2 AS (SELECT * REPLACE (coalesce(cost_price, original_price * 0.7) AS cost_price) FROM r1),
r3 AS (SELECT *, concat_ws(',',
    CASE WHEN initial_stock IS NULL OR initial_stock <= 0 THEN 'stock_must_be_positive' END,
    CASE WHEN original_price IS NULL OR original_price <= 0 THEN 'no_price' END,
    CASE WHEN NOT regexp_matches(promotion_end, '^([01][0-9]|2[0-3]):[0-5][0-9]$') OR promotion_start = promotion_end THEN 'bad_window' END,
    CASE WHEN NOT (min_discount > 0 AND min_discount <= max_discount AND max_discount <= 1) THEN 'bad_discount_range' END,
    CASE WHEN time_segments < 1 THEN 'no_segments' END,
    CASE WHEN max_discount <= 1 AND original_price > 0 AND cost_price > original_price * max_discount * 0.9 THEN 'margin_out_of_reach' END) AS reasons FROM r2)
SELECT {out_sql(REQ_SPEC)} FROM (SELECT *, CASE WHEN reasons = '' THEN 'valid' ELSE 'rejected' END AS status FROM r3)
""")
def q_validated_plan_requests(spark, d):
    """A request for each product of the fact (net units less 100 as stock, some fields missing or wrong by its code),
    checked by all rules in one pass; valid and rejected parts with their reasons."""
    tx = transactions(spark, d)
    k = F.col("product_code").cast("int")
    hist = tx.where((F.col("qty") > 0) & (k % 13 != 0)).groupBy("product_code").agg(F.avg("list_price").alias("hist_price"))
    q = tx.groupBy("product_code").agg(F.sum("qty").cast("long").alias("stock"), F.max("list_price").alias("price"))
    req = q.select("product_code", F.when(k % 17 != 0, F.col("stock") - 100).alias("initial_stock"), F.when(k % 3 > 0, F.col("price")).alias("original_price"),
                   F.when(k % 5 == 0, F.col("price") * 0.95).alias("cost_price"), F.lit("20:00").alias("promotion_start"),
                   F.when(k % 29 == 0, "20:00").when(k % 29 == 1, "24:30").otherwise("22:00").alias("promotion_end"),
                   F.lit(0.4).alias("min_discount"), F.when(k % 23 == 0, 1.4).otherwise(0.9).alias("max_discount"),
                   F.when(k % 31 == 0, 0).otherwise(4).alias("time_segments"), F.lit(0.1).alias("min_gross_margin"))
    valid, rejected = PR.validate_requests(req, hist)
    both = valid.withColumn("status", F.lit("valid")).withColumn("reasons", F.lit("")).unionByName(
        rejected.withColumn("status", F.lit("rejected")).withColumn("reasons", F.array_join("reasons", ",")))
    return both.select(*out_cols(REQ_SPEC))
