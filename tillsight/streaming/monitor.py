"""Live monitoring of markdown plans (R1-R11), batch form.

A *strategy* is one plan on one business day. Sales updates are till rows
inside the promotion window. The same rules run in two shapes:

* batch twins here (windows over a strategy's own rows / stages, so every
  window is bounded by one strategy's events) - checked against SQL;
* the streaming form in ``stream.py`` (watermarked windows and stateful
  processors with event-time timers), which produces the same rows incrementally.

Stage lookup (J13) is a range join turned into an equi-join: the stage index is
computed from the clock minute, then joined on (plan, stage).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Emergency control parameters (increment, floor, max adjustments per session)
EMERGENCY_INCREMENT = 0.1
EMERGENCY_FLOOR = 0.3
MAX_ADJUSTMENTS = 3
SMOOTHING_ALPHA = 0.4
STEP_MULTIPLIER = {"emergency_discount": 2.0, "increase_discount": 1.0, "moderate_discount_increase": 0.5}


def sales_updates(rows: DataFrame, plans: DataFrame, start: str = "20:00", end: str = "22:00",
                  stages: int = 4) -> DataFrame:
    """Till rows in the promotion window as sales updates of strategy plan@day,
    with their stage index (J13 as arithmetic on the clock minute)."""
    s = int(start[:2]) * 60 + int(start[3:])
    e = int(end[:2]) * 60 + int(end[3:])
    seg = ((e - s) % 1440) / stages
    minute = F.hour("sale_ts") * 60 + F.minute("sale_ts")
    off = F.pmod(minute - s, F.lit(1440))
    u = rows.where(off < (e - s) % 1440).join(plans.select("store_code", "product_code", "plan_id", "initial_stock"),
                                               ["store_code", "product_code"])
    return u.select(F.concat_ws("@", "plan_id", F.col("sale_date").cast("string")).alias("strategy_id"), "plan_id",
                    "sale_date", F.col("sale_ts").alias("ts"), F.col("line_no").alias("event_id"),
                    F.col("qty").alias("quantity_sold"), "initial_stock",
                    F.floor(off / seg).cast("int").alias("t"))


def stage_performance(updates: DataFrame, plan_rows: DataFrame, stages: int = 4, stage_hours: float = 0.5) -> DataFrame:
    """R2 + R3 at the end of every stage of every strategy: actual vs plan, deviation,
    units/hour, stock left, time left, on-track score, needs-adjustment flag."""
    strat = updates.select("strategy_id", "plan_id", "sale_date", "initial_stock").distinct()
    spine = strat.join(plan_rows.select("plan_id", "t", F.col("sold").alias("expected_sales"),
                                        "discount"), "plan_id")
    agg = updates.groupBy("strategy_id", "t").agg(F.sum("quantity_sold").alias("_act"), F.count("*").alias("_n"),
                                                  F.min("ts").alias("_first"), F.max("ts").alias("_last"))
    j = spine.join(agg, ["strategy_id", "t"], "left")
    w = Window.partitionBy("strategy_id").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    act = F.coalesce(F.col("_act"), F.lit(0.0))
    exp = F.col("expected_sales")
    dev = F.when(F.col("_n") > 0, F.when(exp > 0, (act - exp) / exp).otherwise(0.0)) \
           .otherwise(F.when(exp > 0, -1.0).otherwise(0.0))
    span_h = (F.unix_timestamp("_last") - F.unix_timestamp("_first")) / 3600.0
    rate = F.when((F.col("_n") >= 2) & (span_h > 0), act / span_h).otherwise(0.0)
    tau = F.greatest(F.lit(0.0), 1 - (F.col("t") + 1) * stage_hours / (stages * stage_hours))
    e_prog = 1 - tau
    a_prog = F.when(exp > 0, act / exp).otherwise(0.0)
    raw = F.when(a_prog >= e_prog, 0.5 + 0.5 * F.least(a_prog / F.greatest(e_prog, F.lit(0.1)), F.lit(2.0))) \
           .otherwise(0.5 * (a_prog / F.greatest(e_prog, F.lit(0.1))))
    score = F.when(exp <= 0, 0.5).otherwise(F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)))
    out = j.select("strategy_id", "plan_id", "t", "discount", act.alias("actual_sales"), exp.alias("expected_sales"),
                   dev.alias("deviation"), rate.alias("sales_rate"),
                   (F.col("initial_stock") - F.sum(act).over(w)).alias("remaining_stock"),
                   tau.alias("time_remaining_ratio"), score.alias("on_track_score"),
                   F.when(exp > 0, a_prog / F.greatest(e_prog, F.lit(0.1))).otherwise(1.0).alias("progress_ratio"))
    need = (F.col("on_track_score") < 0.3) | (F.abs("deviation") > 0.3) | ((F.col("sales_rate") == 0) & (F.col("expected_sales") > 0))
    return out.withColumn("needs_adjustment", need.cast("int"))


def adjustment_factor(score, progress) -> F.Column:
    """1.5 / 1.2 when behind by score; 0.7 / 0.9 when ahead by the unclamped progress ratio."""
    return (F.when(score < 0.3, 1.5).when(score < 0.7, 1.2).when(progress > 1.5, 0.7)
             .when(progress > 1.2, 0.9).otherwise(1.0))


def adjusted_plan(perf: DataFrame, plan_rows: DataFrame, plans: DataFrame, stages: int = 4,
                  stage_hours: float = 0.5) -> DataFrame:
    """For every stage analysis that needs an adjustment (and stock is left), the
    re-priced remaining stages (current and later): discount x0.9 (floor min) when
    behind, x1.1 (cap max) when ahead; expected = int(stock / hours left * stage hours / d)."""
    a = perf.where((F.col("needs_adjustment") == 1) & (F.col("remaining_stock") > 0)).select(
        "strategy_id", "plan_id", F.col("t").alias("at_stage"), "remaining_stock",
        adjustment_factor(F.col("on_track_score"), F.col("progress_ratio")).alias("factor"))
    rem = a.join(plan_rows.select("plan_id", "t", "discount"), "plan_id").where(F.col("t") >= F.col("at_stage"))
    rem = rem.join(plans.select("plan_id", "base_price", "min_discount", "max_discount"), "plan_id")
    d = F.col("discount")
    nd = (F.when(F.col("factor") > 1.1, F.greatest(F.col("min_discount"), d * 0.9))
           .when(F.col("factor") < 0.9, F.least(F.col("max_discount"), d * 1.1)).otherwise(d))
    hours_left = (stages - F.col("at_stage")) * stage_hours
    rem = rem.withColumn("new_discount", nd)
    return rem.select("strategy_id", "at_stage", "t", "factor", "new_discount",
                      (F.col("base_price") * F.col("new_discount")).alias("new_price"),
                      F.floor(F.col("remaining_stock") / hours_left * stage_hours * (1 / F.col("new_discount")))
                       .cast("long").alias("new_expected_sales"))


def adjustment_history(perf: DataFrame, last: int = 5) -> DataFrame:
    """Number of adjustments per strategy and the stages of the last five."""
    a = perf.where(F.col("needs_adjustment") == 1)
    w = Window.partitionBy("strategy_id").orderBy(F.desc("t"))
    a = a.withColumn("_rn", F.row_number().over(w))
    return a.groupBy("strategy_id").agg(
        F.count("*").alias("adjustments"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_rn") <= last, F.col("t")))),
                                 lambda x: x.cast("string")), ",").alias("last_stages"))


def emergency_recommendations() -> F.Column:
    """Advice of one update as a comma list: the decision, then what is added when an
    adjustment is needed and little time (and little cleared) is left."""
    needed, left = F.col("adjustment_needed") == 1, F.col("time_to_close")
    cleared = F.when(F.col("initial_stock") > 0, F.col("total_sales") / F.col("initial_stock")).otherwise(0.0)
    reduce_ = F.col("adjustment_type") == "consider_reducing_discount"
    return F.concat_ws(",", F.when(needed | reduce_, F.col("adjustment_type")).otherwise("keep_monitoring"),
                       F.when(needed & (left < 0.5), "final_clearance"),
                       F.when(needed & (cleared < 0.3) & (left < 1.0), "staff_purchase_or_donation"))


def hours_to_close(ts, end_hhmm: str = "22:00") -> F.Column:
    """Hours from a timestamp's clock time to the end of the promotion, past midnight if need be."""
    end = int(end_hhmm[:2]) * 60 + int(end_hhmm[3:])
    return F.pmod(F.lit(end) - (F.hour(ts) * 60 + F.minute(ts) + F.second(ts) / 60.0), F.lit(1440)) / 60.0


def progress_monitor(updates: DataFrame, plan_rows: DataFrame, end_hhmm: str = "22:00",
                     increment: float = EMERGENCY_INCREMENT, floor: float = EMERGENCY_FLOOR,
                     max_adjustments: int = MAX_ADJUSTMENTS) -> DataFrame:
    """R6 + R7 + R8 at every sales update of every strategy (batch twin of the state handler).

    Running total, elapsed hours since the first update, hours to close, required
    rate, progress ratio and status, time pressure; the emergency decision with at
    most ``max_adjustments`` per session and the emergency discount."""
    w = Window.partitionBy("strategy_id").orderBy("ts", "event_id")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    u = updates.select("*", F.sum("quantity_sold").over(run).alias("total_sales"),
                       F.first("ts").over(run).alias("_start"))
    ttc = hours_to_close(F.col("ts"), end_hhmm)
    elapsed = (F.unix_timestamp("ts") - F.unix_timestamp("_start")) / 3600.0
    u = u.withColumn("elapsed_hours", elapsed).withColumn("time_to_close", ttc)
    init, tot = F.col("initial_stock"), F.col("total_sales")
    rate = F.when(F.col("elapsed_hours") > 0, tot / F.col("elapsed_hours")).otherwise(0.0)
    req = F.when((F.col("time_to_close") > 0) & (init > tot), (init - tot) / F.col("time_to_close")).otherwise(0.0)
    u = u.withColumn("sales_rate", rate).withColumn("required_rate", req)
    ratio = F.when(F.col("required_rate") > 0, F.col("sales_rate") / F.col("required_rate")).otherwise(1.0)
    u = u.withColumn("progress_ratio", ratio)
    status = (F.when(F.col("progress_ratio") >= 1.2, "ahead").when(F.col("progress_ratio") >= 0.8, "on_track")
               .when(F.col("progress_ratio") >= 0.5, "behind").otherwise("critical"))
    pressure = F.when(F.col("elapsed_hours") > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0),
                      1 - F.col("time_to_close") / F.col("elapsed_hours")))).otherwise(0.0)
    u = u.withColumn("status", status).withColumn("time_pressure", pressure)
    kind = (F.when(F.col("status") == "critical",
                   F.when(F.col("time_to_close") < 1.0, "emergency_discount").otherwise("increase_discount"))
             .when(F.col("status") == "behind",
                   F.when(F.col("time_pressure") > 0.7, "moderate_discount_increase").otherwise("monitoring"))
             .when(F.col("status") == "on_track", "no_adjustment_needed").otherwise("consider_reducing_discount"))
    base_need = kind.isin(*STEP_MULTIPLIER)
    u = u.withColumn("_kind", kind).withColumn("_need", base_need.cast("int"))
    prior = F.coalesce(F.sum("_need").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    u = u.withColumn("prior_adjustments", F.least(prior, F.lit(max_adjustments)))
    blocked = F.col("prior_adjustments") >= max_adjustments
    u = u.withColumn("adjustment_type", F.when(blocked, "max_adjustments_reached").otherwise(F.col("_kind"))) \
         .withColumn("adjustment_needed", ((~blocked) & (F.col("_need") == 1)).cast("int"))
    u = u.withColumn("recommendations", emergency_recommendations())
    u = u.join(plan_rows.select("plan_id", "t", "discount"), ["plan_id", "t"], "left")
    mult = F.coalesce(F.element_at(F.create_map(*[x for k, v in STEP_MULTIPLIER.items()
                                                  for x in (F.lit(k), F.lit(v))]), F.col("adjustment_type")), F.lit(0.0))
    new_d = F.when(F.col("adjustment_needed") == 1, F.greatest(F.lit(floor), F.col("discount") - increment * mult)) \
             .otherwise(F.col("discount"))
    return u.select("strategy_id", "ts", "event_id", "t", "total_sales", (init - tot).alias("remaining_stock"),
                    "elapsed_hours", "time_to_close", "sales_rate", "required_rate", "progress_ratio", "status",
                    "time_pressure", "adjustment_needed", "adjustment_type", "prior_adjustments", "recommendations",
                    "discount", new_d.alias("new_discount"))


def monitoring_summary(monitor: DataFrame) -> DataFrame:
    """Per strategy: checkpoints, total sales, adjustments, last status and discount."""
    last = F.struct("ts", "event_id")
    return monitor.groupBy("strategy_id").agg(
        F.count("*").alias("checkpoints"), F.max("total_sales").alias("total_sales"),
        F.sum("adjustment_needed").alias("adjustments"), F.max_by("status", last).alias("last_status"),
        F.max_by("new_discount", last).alias("last_discount"))


def smoothed_base_rates(updates: DataFrame, base: DataFrame, stage_hours: float = 0.5,
                        alpha: float = SMOOTHING_ALPHA) -> DataFrame:
    """Per (plan, stage), observed units/hour of each day folded in day order into
    ``alpha * obs + (1 - alpha) * old``, starting from the A32 base rate. The fold is an
    ``aggregate`` over the stage's days (bounded by days)."""
    obs = updates.groupBy("plan_id", "t", "sale_date").agg((F.sum("quantity_sold") / stage_hours).alias("obs"))
    g = obs.groupBy("plan_id", "t").agg(F.array_sort(F.collect_list(F.struct("sale_date", "obs"))).alias("_s"),
                                        F.count("*").alias("days"))
    j = g.join(base, ["plan_id", "t"], "left")
    fold = F.aggregate("_s", F.coalesce(F.col("base_rate"), F.lit(1.0)),
                       lambda acc, x: x["obs"] * alpha + acc * (1 - alpha))
    return j.select("plan_id", "t", "days", F.coalesce("base_rate", F.lit(1.0)).alias("base_rate"),
                    fold.alias("smoothed_rate"))


def smoothed_rate_history(updates: DataFrame, base: DataFrame, stage_hours: float = 0.5,
                          alpha: float = SMOOTHING_ALPHA) -> DataFrame:
    """R10 day by day (batch twin of the keyed state): per (plan, stage, day) the observed rate and
    the rate smoothed up to that day, by ``aggregate`` over the sorted days so far."""
    obs = updates.groupBy("plan_id", "t", "sale_date").agg((F.sum("quantity_sold") / stage_hours).alias("obs"))
    g = obs.groupBy("plan_id", "t").agg(F.array_sort(F.collect_list(F.struct("sale_date", "obs"))).alias("_s"))
    g = g.join(base, ["plan_id", "t"], "left").select("*", F.posexplode("_s").alias("_at", "_day"))
    fold = F.aggregate(F.slice("_s", F.lit(1), F.col("_at") + 1), F.coalesce(F.col("base_rate"), F.lit(1.0)),
                       lambda acc, x: x["obs"] * alpha + acc * (1 - alpha))
    return g.select("plan_id", "t", F.col("_day.sale_date").alias("sale_date"), (F.col("_at") + 1).cast("long").alias("days"),
                    F.col("_day.obs").alias("observed_rate"), fold.alias("smoothed_rate"))


def window_metrics(updates: DataFrame, every: str = "5 minutes", span: str = "30 minutes") -> tuple[DataFrame, DataFrame]:
    """Per strategy, tumbling ``every`` windows and sliding ``span`` windows every ``every``."""
    t = updates.groupBy("strategy_id", F.window("ts", every).alias("w")).agg(
        F.count("*").alias("updates"), F.sum("quantity_sold").alias("units"))
    s = updates.groupBy("strategy_id", F.window("ts", span, every).alias("w")).agg(
        F.count("*").alias("updates"), F.sum("quantity_sold").alias("units"))
    return (t.select("strategy_id", F.col("w.start").alias("window_start"), "updates", "units"),
            s.select("strategy_id", F.col("w.start").alias("window_start"), "updates", "units"))
