"""Live monitoring queries (R1-R11, J13): batch twins and Structured Streaming runs, checked by the
same SQL oracles. The streams read the events as files that arrive out of event order."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import patterns as PT
from ..operators import pricing as PR
from ..session import cut_lineage
from ..sources.starschema import hourly_transactions, read_table
from ..streaming import monitor as MON
from ..streaming import stream as ST
from .pricing import PLANS_SQL, _stagger_paths_sql, plan_requests
from .registry import register
from .sqlparts import hx_cte, out_cols, out_sql, with_


def live_inputs(spark, d):
    plans = plan_requests(spark, d)
    plan_rows = PR.staggered_plan(plans)
    upd = MON.sales_updates(hourly_transactions(spark, d), plans)
    return plans, plan_rows, upd


UPD_SQL = """upd AS (
  SELECT p.plan_id || '@' || CAST(hx.sale_date AS VARCHAR) AS strategy_id, p.plan_id, hx.sale_date, hx.sale_ts AS ts,
         hx.line_no AS event_id, hx.qty AS quantity_sold, p.initial_stock,
         CAST(floor(((((hour(hx.sale_ts) * 60 + minute(hx.sale_ts) - 1200) % 1440) + 1440) % 1440) / 30.0) AS INT) AS t
  FROM hx JOIN plans p ON p.store_code = hx.store_code AND p.product_code = hx.product_code
  WHERE ((((hour(hx.sale_ts) * 60 + minute(hx.sale_ts) - 1200) % 1440) + 1440) % 1440) < 120)"""
PERF_SQL = """strat AS (SELECT DISTINCT strategy_id, plan_id, sale_date, initial_stock FROM upd),
spine AS (SELECT s.*, st.t, st.sold AS expected_sales, st.discount FROM strat s JOIN stag st ON st.plan_id = s.plan_id),
ag AS (SELECT strategy_id, t, sum(quantity_sold) AS act, count(*) AS n, min(ts) AS f, max(ts) AS l FROM upd GROUP BY ALL),
pj AS (SELECT sp.*, coalesce(ag.act, 0.0) AS actual_sales, ag.n, ag.f, ag.l
       FROM spine sp LEFT JOIN ag ON ag.strategy_id = sp.strategy_id AND ag.t = sp.t),
p1 AS (SELECT *, greatest(0.0, 1 - (t + 1) * 0.5 / 2.0) AS time_remaining_ratio,
              CASE WHEN expected_sales > 0 THEN actual_sales / expected_sales ELSE 0.0 END AS a_prog FROM pj),
perf AS (
  SELECT strategy_id, plan_id, t, discount, actual_sales, expected_sales,
    CASE WHEN n > 0 THEN CASE WHEN expected_sales > 0 THEN (actual_sales - expected_sales) / expected_sales ELSE 0.0 END
         ELSE CASE WHEN expected_sales > 0 THEN -1.0 ELSE 0.0 END END AS deviation,
    CASE WHEN n >= 2 AND (floor(epoch(l)) - floor(epoch(f))) / 3600.0 > 0
         THEN actual_sales / ((floor(epoch(l)) - floor(epoch(f))) / 3600.0) ELSE 0.0 END AS sales_rate,
    initial_stock - sum(actual_sales) OVER (PARTITION BY strategy_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS remaining_stock,
    time_remaining_ratio,
    CASE WHEN expected_sales <= 0 THEN 0.5 ELSE least(greatest(
      CASE WHEN a_prog >= 1 - time_remaining_ratio
           THEN 0.5 + 0.5 * least(a_prog / greatest(1 - time_remaining_ratio, 0.1), 2.0)
           ELSE 0.5 * (a_prog / greatest(1 - time_remaining_ratio, 0.1)) END, 0.0), 1.0) END AS on_track_score,
    CASE WHEN expected_sales > 0 THEN a_prog / greatest(1 - time_remaining_ratio, 0.1) ELSE 1.0 END AS progress_ratio
  FROM p1),
perf2 AS MATERIALIZED (SELECT *, CAST(on_track_score < 0.3 OR abs(deviation) > 0.3 OR (sales_rate = 0 AND expected_sales > 0) AS INT)
                   AS needs_adjustment FROM perf)"""
LIVE_SQL = [*PLANS_SQL, _stagger_paths_sql(), UPD_SQL, PERF_SQL]

PERF_SPEC = ("strategy_id:s t:i actual_sales:f expected_sales:l deviation:f sales_rate:f remaining_stock:f "
             "time_remaining_ratio:f on_track_score:f progress_ratio:f needs_adjustment:i")


@register("live_stage_performance", "R1 R2 R3 J13", sql=with_(*LIVE_SQL) + f"SELECT {out_sql(PERF_SPEC)} FROM perf2")
def q_live_stage_performance(spark, d):
    _, plan_rows, upd = live_inputs(spark, d)
    return MON.stage_performance(upd, plan_rows).select(*out_cols(PERF_SPEC))


ADJ_SPEC = "strategy_id:s at_stage:i t:i factor:f new_discount:f new_price:f new_expected_sales:l"


@register("live_adjusted_plan", "R4", sql=with_(*LIVE_SQL) + f"""
, a AS MATERIALIZED (SELECT strategy_id, plan_id, t AS at_stage, remaining_stock,
               CASE WHEN on_track_score < 0.3 THEN 1.5 WHEN on_track_score < 0.7 THEN 1.2 WHEN progress_ratio > 1.5 THEN 0.7
                    WHEN progress_ratio > 1.2 THEN 0.9 ELSE 1.0 END AS factor
        FROM perf2 WHERE needs_adjustment = 1 AND remaining_stock > 0),
r AS (SELECT a.*, st.t, st.discount, p.base_price, p.min_discount, p.max_discount FROM a
      JOIN stag st ON st.plan_id = a.plan_id AND st.t >= a.at_stage JOIN plans p ON p.plan_id = a.plan_id),
n AS (SELECT *, CASE WHEN factor > 1.1 THEN greatest(min_discount, discount * 0.9)
                     WHEN factor < 0.9 THEN least(max_discount, discount * 1.1) ELSE discount END AS new_discount FROM r)
SELECT {out_sql(ADJ_SPEC)} FROM (
  SELECT strategy_id, at_stage, t, factor, new_discount, base_price * new_discount AS new_price,
         floor(remaining_stock / ((4 - at_stage) * 0.5) * 0.5 * (1 / new_discount)) AS new_expected_sales FROM n)
""")
def q_live_adjusted_plan(spark, d):
    plans, plan_rows, upd = live_inputs(spark, d)
    perf = MON.stage_performance(upd, plan_rows)
    return MON.adjusted_plan(perf, plan_rows, plans).select(*out_cols(ADJ_SPEC))


HIST_SPEC = "strategy_id:s adjustments:l last_stages:s"


@register("live_adjustment_history", "R5", sql=with_(*LIVE_SQL) + f"""
SELECT {out_sql(HIST_SPEC)} FROM (
  SELECT strategy_id, count(*) AS adjustments, string_agg(CAST(t AS VARCHAR), ',' ORDER BY t) FILTER (WHERE rn <= 5) AS last_stages
  FROM (SELECT *, row_number() OVER (PARTITION BY strategy_id ORDER BY t DESC) AS rn FROM perf2 WHERE needs_adjustment = 1)
  GROUP BY strategy_id)
""")
def q_live_adjustment_history(spark, d):
    _, plan_rows, upd = live_inputs(spark, d)
    return MON.adjustment_history(MON.stage_performance(upd, plan_rows)).select(*out_cols(HIST_SPEC))


MON_SQL = f"""m0 AS (
  SELECT *, sum(quantity_sold) OVER w AS total_sales, first_value(ts) OVER w AS start_ts,
         (((1320 - (hour(ts) * 60 + minute(ts) + second(ts) / 60.0)) % 1440) + 1440) % 1440 / 60.0 AS time_to_close
  FROM upd WINDOW w AS (PARTITION BY strategy_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
m1 AS (SELECT *, (floor(epoch(ts)) - floor(epoch(start_ts))) / 3600.0 AS elapsed_hours FROM m0),
m2 AS (SELECT *, CASE WHEN elapsed_hours > 0 THEN total_sales / elapsed_hours ELSE 0.0 END AS sales_rate,
              CASE WHEN time_to_close > 0 AND initial_stock > total_sales THEN (initial_stock - total_sales) / time_to_close
                   ELSE 0.0 END AS required_rate FROM m1),
m3 AS (SELECT *, CASE WHEN required_rate > 0 THEN sales_rate / required_rate ELSE 1.0 END AS progress_ratio,
              CASE WHEN elapsed_hours > 0 THEN least(1.0, greatest(0.0, 1 - time_to_close / elapsed_hours)) ELSE 0.0 END
                AS time_pressure FROM m2),
m4 AS (SELECT *, CASE WHEN progress_ratio >= 1.2 THEN 'ahead' WHEN progress_ratio >= 0.8 THEN 'on_track'
                      WHEN progress_ratio >= 0.5 THEN 'behind' ELSE 'critical' END AS status FROM m3),
m5 AS (SELECT *, CASE WHEN status = 'critical' THEN CASE WHEN time_to_close < 1.0 THEN 'emergency_discount' ELSE 'increase_discount' END
                      WHEN status = 'behind' THEN CASE WHEN time_pressure > 0.7 THEN 'moderate_discount_increase' ELSE 'monitoring' END
                      WHEN status = 'on_track' THEN 'no_adjustment_needed' ELSE 'consider_reducing_discount' END AS kind FROM m4),
m6 AS (SELECT *, CAST(kind IN ('emergency_discount', 'increase_discount', 'moderate_discount_increase') AS INT) AS need FROM m5),
m7 AS (SELECT *, least(coalesce(sum(need) OVER (PARTITION BY strategy_id ORDER BY ts, event_id
                                               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), {MON.MAX_ADJUSTMENTS})
                   AS prior_adjustments FROM m6),
mon AS (
  SELECT m7.*, CASE WHEN prior_adjustments >= {MON.MAX_ADJUSTMENTS} THEN 'max_adjustments_reached' ELSE kind END AS adjustment_type,
         CAST(prior_adjustments < {MON.MAX_ADJUSTMENTS} AND need = 1 AS INT) AS adjustment_needed,
         initial_stock - total_sales AS remaining_stock, st.discount
  FROM m7 LEFT JOIN stag st ON st.plan_id = m7.plan_id AND st.t = m7.t),
mon2 AS (SELECT *, CASE WHEN adjustment_needed = 1
                        THEN greatest({MON.EMERGENCY_FLOOR}, discount - {MON.EMERGENCY_INCREMENT} *
                             CASE adjustment_type WHEN 'emergency_discount' THEN 2.0 WHEN 'increase_discount' THEN 1.0
                                  WHEN 'moderate_discount_increase' THEN 0.5 ELSE 0.0 END)
                        ELSE discount END AS new_discount,
              concat_ws(',', CASE WHEN adjustment_needed = 1 OR adjustment_type = 'consider_reducing_discount' THEN adjustment_type
                                  ELSE 'keep_monitoring' END,
                        CASE WHEN adjustment_needed = 1 AND time_to_close < 0.5 THEN 'final_clearance' END,
                        CASE WHEN adjustment_needed = 1 AND time_to_close < 1.0
                              AND CASE WHEN initial_stock > 0 THEN total_sales / initial_stock ELSE 0.0 END < 0.3
                             THEN 'staff_purchase_or_donation' END) AS recommendations FROM mon)"""
MON_SPEC = ("strategy_id:s ts:t event_id:l t:i total_sales:f remaining_stock:f elapsed_hours:f time_to_close:f "
            "sales_rate:f required_rate:f progress_ratio:f status:s time_pressure:f adjustment_needed:i "
            "adjustment_type:s prior_adjustments:l recommendations:s discount:f new_discount:f")


@register("live_progress_monitor", "R6 R7 R8", sql=with_(*LIVE_SQL, MON_SQL) + f"SELECT {out_sql(MON_SPEC)} FROM mon2")
def q_live_progress_monitor(spark, d):
    _, plan_rows, upd = live_inputs(spark, d)
    return MON.progress_monitor(upd, plan_rows).select(*out_cols(MON_SPEC))


SUM_SPEC = "strategy_id:s checkpoints:l total_sales:f adjustments:l last_status:s last_discount:f"


@register("live_monitoring_summary", "R9", sql=with_(*LIVE_SQL, MON_SQL) + f"""
SELECT {out_sql(SUM_SPEC)} FROM (
  SELECT strategy_id, count(*) AS checkpoints, max(total_sales) AS total_sales, sum(adjustment_needed) AS adjustments,
         max(CASE WHEN rn = 1 THEN status END) AS last_status, max(CASE WHEN rn = 1 THEN new_discount END) AS last_discount
  FROM (SELECT *, row_number() OVER (PARTITION BY strategy_id ORDER BY ts DESC, event_id DESC) AS rn FROM mon2)
  GROUP BY strategy_id)
""")
def q_live_monitoring_summary(spark, d):
    _, plan_rows, upd = live_inputs(spark, d)
    return MON.monitoring_summary(MON.progress_monitor(upd, plan_rows)).select(*out_cols(SUM_SPEC))


SMOOTH_SQL = """bsh(stage, hour, n_hours) AS (VALUES (0, 20, 1), (1, 20, 2), (1, 21, 2), (2, 21, 1), (3, 21, 2), (3, 22, 2)),
bspan AS (SELECT date_diff('day', min(sale_date), max(sale_date)) + 1 AS days FROM hx),
bq AS (SELECT store_code, product_code, stage, sum(qty) AS q FROM hx JOIN bsh ON bsh.hour = hour(hx.sale_ts) GROUP BY ALL),
bnh AS (SELECT DISTINCT stage, n_hours FROM bsh),
bsp AS (SELECT k.store_code, k.product_code, s.stage FROM (SELECT DISTINCT store_code, product_code FROM hx) k,
        (SELECT DISTINCT stage FROM bsh) s),
base AS (SELECT p.plan_id, bsp.stage AS t,
                CASE WHEN coalesce(bq.q, 0.0) / bspan.days / bnh.n_hours > 0 THEN coalesce(bq.q, 0.0) / bspan.days / bnh.n_hours
                     ELSE 0.5 END AS base_rate
         FROM bsp LEFT JOIN bq ON bq.store_code = bsp.store_code AND bq.product_code = bsp.product_code AND bq.stage = bsp.stage
         JOIN bnh ON bnh.stage = bsp.stage JOIN plans p ON p.store_code = bsp.store_code AND p.product_code = bsp.product_code,
         bspan),
obs AS (SELECT plan_id, t, sale_date, sum(quantity_sold) / 0.5 AS obs FROM upd GROUP BY ALL),
g AS (SELECT plan_id, t, count(*) AS days, list(obs ORDER BY sale_date) AS xs FROM obs GROUP BY ALL)"""
SMOOTH_SPEC = "plan_id:s t:i days:l base_rate:f smoothed_rate:f"


@register("live_rate_smoothing", "R10 A32", sql=with_(*LIVE_SQL, SMOOTH_SQL) + f"""
SELECT {out_sql(SMOOTH_SPEC)} FROM (
  SELECT g.plan_id, g.t, days, coalesce(base.base_rate, 1.0) AS base_rate,
         list_reduce(list_prepend(coalesce(base.base_rate, 1.0), xs), lambda acc, x: x * 0.4 + acc * 0.6) AS smoothed_rate
  FROM g LEFT JOIN base ON base.plan_id = g.plan_id AND base.t = g.t)
""")
def q_live_rate_smoothing(spark, d):
    plans, _, upd = live_inputs(spark, d)
    return MON.smoothed_base_rates(upd, stage_base_rates(spark, d, plans)).select(*out_cols(SMOOTH_SPEC))


def stage_base_rates(spark, d, plans):
    return (PT.stage_baseline(hourly_transactions(spark, d), ["store_code", "product_code"])
              .join(plans.select("store_code", "product_code", "plan_id"), ["store_code", "product_code"])
              .select("plan_id", F.col("stage").alias("t"), "base_rate"))


WIN_SPEC = "kind:s strategy_id:s window_start:t updates:l units:f"


@register("live_window_metrics", "R11", sql=with_(*LIVE_SQL) + f"""
SELECT {out_sql(WIN_SPEC)} FROM (
  SELECT 'tumbling_5m' AS kind, strategy_id, time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, count(*) AS updates,
         sum(quantity_sold) AS units FROM upd GROUP BY ALL
  UNION ALL
  SELECT 'sliding_30m', strategy_id, ws, count(*), sum(quantity_sold) FROM (
    SELECT strategy_id, quantity_sold, time_bucket(INTERVAL 5 MINUTE, ts) - to_minutes(CAST(5 * k AS BIGINT)) AS ws
    FROM upd, (SELECT unnest(range(0, 6)) AS k) kk) GROUP BY ALL)
""")
def q_live_window_metrics(spark, d):
    _, _, upd = live_inputs(spark, d)
    t, s = MON.window_metrics(upd)
    return (t.withColumn("kind", F.lit("tumbling_5m")).unionByName(s.withColumn("kind", F.lit("sliding_30m")))
             .select(*out_cols(WIN_SPEC)))


ORDER_SPEC = "strategy_id:s seq:l ts:t event_id:l quantity_sold:f total_sales:f"


@register("stream_ordered_updates", "R1", sql=with_(*PLANS_SQL, UPD_SQL) + f"""
SELECT {out_sql(ORDER_SPEC)} FROM (
  SELECT strategy_id, row_number() OVER w AS seq, ts, event_id, quantity_sold, sum(quantity_sold) OVER w AS total_sales
  FROM upd WINDOW w AS (PARTITION BY strategy_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
""")
def q_stream_ordered_updates(spark, d):
    """Two deliveries out of event order -> keyed buffer with event-time timers -> updates in event order."""
    plans = plan_requests(spark, d)
    out = ST.run_deliveries(ST.arrivals(read_table(spark, d, "events")), "ordered_updates", lambda s: ST.ordered_updates(s, plans))
    return out.select(*out_cols(ORDER_SPEC))


STREAM_WIN_SPEC = "product_code:s window_start:t window_end:t updates:l units:f"


@register("stream_window_sales", "R1 R11", sql=with_(hx_cte()) + f"""
SELECT {out_sql(STREAM_WIN_SPEC)} FROM (
  SELECT product_code, time_bucket(INTERVAL 5 MINUTE, sale_ts) AS window_start,
         time_bucket(INTERVAL 5 MINUTE, sale_ts) + INTERVAL 5 MINUTE AS window_end, count(*) AS updates, sum(qty) AS units
  FROM hx GROUP BY ALL)
""")
def q_stream_window_sales(spark, d):
    """Two deliveries out of event order -> watermark 10 min -> 5-minute windows per product; a closing
    heartbeat closes the last ones."""
    out = ST.run_deliveries(ST.arrivals(read_table(spark, d, "events")), "window_sales", ST.windowed_sales)
    return out.select(*out_cols(STREAM_WIN_SPEC))


@register("stream_progress_state", "R1 R6 R7 R8", sql=with_(*LIVE_SQL, MON_SQL) + f"SELECT {out_sql(MON_SPEC)} FROM mon2")
def q_stream_progress_state(spark, d):
    """The monitoring rules of ``live_progress_monitor`` as keyed state over deliveries out of event order; same rows."""
    plans = plan_requests(spark, d)
    plan_rows = cut_lineage(PR.staggered_plan(plans))
    out = ST.run_deliveries(ST.arrivals(read_table(spark, d, "events")), "progress_state",
                            lambda s: ST.progress_stream(s, plans, plan_rows))
    return out.select(*out_cols(MON_SPEC))


RATES_SPEC = "plan_id:s t:i sale_date:d days:l observed_rate:f smoothed_rate:f"
_RATES_SQL = with_(*PLANS_SQL, UPD_SQL, SMOOTH_SQL) + f"""
SELECT {out_sql(RATES_SPEC)} FROM (
  SELECT plan_id, t, sale_date, days, observed_rate,
         list_reduce(list_prepend(base_rate, xs[1:days]), lambda acc, x: x * 0.4 + acc * 0.6) AS smoothed_rate
  FROM (SELECT o.plan_id, o.t, o.sale_date, o.obs AS observed_rate, coalesce(base.base_rate, 1.0) AS base_rate, g.xs,
               row_number() OVER (PARTITION BY o.plan_id, o.t ORDER BY o.sale_date) AS days
        FROM obs o JOIN g ON g.plan_id = o.plan_id AND g.t = o.t LEFT JOIN base ON base.plan_id = o.plan_id AND base.t = o.t))
"""


@register("stream_rate_smoothing", "R10", sql=_RATES_SQL)
def q_stream_rate_smoothing(spark, d):
    """The recursive rate of each (plan, stage) in keyed state, a row for each closed day."""
    plans = plan_requests(spark, d)
    base = cut_lineage(stage_base_rates(spark, d, plans))
    out = ST.run_deliveries(ST.arrivals(read_table(spark, d, "events")), "rate_smoothing", lambda s: ST.smoothed_rates(s, plans, base))
    return out.select(*out_cols(RATES_SPEC))


@register("live_rate_history", "R10", sql=_RATES_SQL)
def q_live_rate_history(spark, d):
    """Batch twin of ``stream_rate_smoothing``."""
    plans = plan_requests(spark, d)
    upd = MON.sales_updates(hourly_transactions(spark, d), plans)
    return MON.smoothed_rate_history(upd, stage_base_rates(spark, d, plans)).select(*out_cols(RATES_SPEC))
