"""Structured Streaming form of the live monitor.

Sales updates arrive in files, out of event order by up to the watermark's delay. Three stateful
processors keep their state per key in RocksDB and act on event-time timers only, so what they emit does not
hang on how updates were cut into files and batches:

* ``OrderedUpdates`` (R1) buffers updates by monitoring slot and releases a slot in event order when
  the watermark passes its end;
* ``ProgressMonitor`` (R6, R7, R8) runs the monitoring rules on the released updates of a strategy and drops
  all state by a timer at the end of the promotion;
* ``RateSmoother`` (R10) folds each closed day of a (plan, stage) into the recursive rate.

Windowed metrics (R11) run in append mode. A closing heartbeat, an update-free row with a later time, moves
the watermark past the last window and timer, so nothing stays unemitted. Every run has its own landing, sink
and checkpoint folder under the shared checkpoint folder. The batch twins are in ``monitor.py``."""

from __future__ import annotations

from contextlib import contextmanager
from typing import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..session import run_folder
from ..sources.starschema import as_hourly
from .monitor import (EMERGENCY_FLOOR, EMERGENCY_INCREMENT, MAX_ADJUSTMENTS, SMOOTHING_ALPHA, STEP_MULTIPLIER,
                      hours_to_close, sales_updates)

WATERMARK = "10 minutes"
DELAY_MINUTES = 8           # updates arrive up to this much later than they happened
SLOT_SECONDS = 300          # R11: monitoring cadence
HEARTBEAT = -1              # event_id and user_id of a closing heartbeat
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


# ---- arrival of updates in files

def arrivals(events: DataFrame, delay_minutes: int = DELAY_MINUTES) -> tuple[DataFrame, DataFrame]:
    """The events in two deliveries out of event order: each arrives 0 to ``delay_minutes`` minutes late (by its id), and
    the cut between the deliveries is 21:00 of the middle day. The second ends with a heartbeat a day after the last event."""
    late = F.make_dt_interval(mins=F.pmod(F.hash("event_id"), F.lit(delay_minutes + 1)))
    lo, hi = events.agg(F.min("ts"), F.max("ts")).first()
    if lo is None:
        return events, events
    cut = F.lit((lo + (hi - lo) / 2).replace(hour=21, minute=0, second=0, microsecond=0)).cast(events.schema["ts"].dataType)
    first = F.col("ts") + late < cut
    heartbeat = events.agg((F.max("ts") + F.make_dt_interval(days=F.lit(1))).alias("ts"))
    cols = [F.col("ts") if c == "ts" else F.lit(HEARTBEAT if c in ("event_id", "user_id") else None).cast(t.dataType).alias(c)
            for c, t in ((c, events.schema[c]) for c in events.columns)]
    return events.where(first), events.where(~first).unionByName(heartbeat.select(*cols))


def update_stream(spark: SparkSession, landing: str, schema, watermark: str = WATERMARK) -> DataFrame:
    """The landed files as a stream of till rows with a watermark on ``sale_ts``."""
    return as_hourly(spark.readStream.schema(schema).parquet(landing)).withWatermark("sale_ts", watermark)


@contextmanager
def _rocksdb(spark: SparkSession):
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def run_deliveries(deliveries, name: str, build: Callable[[DataFrame], DataFrame], progress: list | None = None) -> DataFrame:
    """Land each delivery, run ``build`` over the stream until it has caught up (``availableNow``; every run resumes from
    the checkpoint of the one before) and return what the sink holds. ``progress`` collects the runs' progress reports."""
    spark, schema = deliveries[0].sparkSession, deliveries[0].schema
    base = run_folder(spark, f"stream-{name}")
    for part in deliveries:
        part.write.mode("append").parquet(f"{base}/landing")
        with _rocksdb(spark):
            out = build(update_stream(spark, f"{base}/landing", schema))
            query = (out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{base}/checkpoint")
                     .option("path", f"{base}/sink").trigger(availableNow=True).start())
            query.awaitTermination()
        if progress is not None:
            progress += query.recentProgress
    return spark.read.schema(out.schema).parquet(f"{base}/sink")


# ---- R11: windows

def windowed_sales(rows: DataFrame, every: str = "5 minutes") -> DataFrame:
    """R11 streaming: tumbling windows per product, closed by the watermark."""
    return (rows.groupBy("product_code", F.window("sale_ts", every).alias("w"))
                .agg(F.count("*").alias("updates"), F.sum("qty").alias("units"))
                .select("product_code", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "updates", "units"))


# ---- R1: event order

def _slot_end(us: int) -> int:
    return (us // (SLOT_SECONDS * 1_000_000) + 1) * SLOT_SECONDS * 1000


def _emitted(keyed, processor: StatefulProcessor) -> DataFrame:
    """The processor's rows; it hands on times as microseconds and dates as days, which need no time zone."""
    out = keyed.transformWithState(processor, processor.output, "Append", "EventTime")
    named = {"us": F.timestamp_micros("us").alias("ts"), "day": F.date_from_unix_date("day").alias("sale_date")}
    return out.select(*[named.get(c, F.col(c)) for c in out.columns])


class OrderedUpdates(StatefulProcessor):
    """Updates of a key, released in the order of (event time, id).

    An update waits in the buffer until the watermark passes the end of its slot; by then no earlier update can
    arrive, as later ones are dropped by the watermark itself. An update delivered twice counts once. ``closes``
    is the time after which nothing more can come for the key: then its state is removed.

    Every call for state or a timer is a message between Python and the JVM, so a key's buffer and session are one value,
    and only the next timer is set: the end of the first slot that waits, or else the session's end."""

    carried = "event_id long, qty double, closes long"
    session_schema = "seq long, total double, closes long"
    output = "strategy_id string, seq long, us long, event_id long, quantity_sold double, total_sales double"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        fields = [f.split() for f in self.carried.split(", ")]
        self.fields = [n for n, _ in fields]
        self.id = 1 + self.fields.index("event_id")
        self.ends = 1 + self.fields.index("closes")
        session = ", ".join(f"session_{f}" for f in self.session_schema.split(", "))
        self.names = [f.split()[0] for f in self.output.split(", ")]
        self.held = handle.getValueState("held", "us array<bigint>, " + ", ".join(f"{n} array<{t}>" for n, t in fields) + ", " + session)

    def _get(self):
        """(rows that wait, session or None), nothing for a key without state."""
        held = self.held.get()
        if held is None:
            return [], None
        k = 1 + len(self.fields)
        session = tuple(held[k:])
        return list(zip(*held[:k])), session if session[-1] is not None else None

    def _put(self, waiting, session) -> None:
        columns = [list(c) for c in zip(*waiting)] if waiting else [[] for _ in range(1 + len(self.fields))]
        self.held.update((*columns, *(session or [None] * len(self.session_schema.split(", ")))))

    def _next(self, waiting, session):
        """The time of the next timer."""
        if waiting:
            return min(_slot_end(r[0]) for r in waiting)
        return session[-1] if session else None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        waiting, session = self._get()
        before = self._next(waiting, session)
        known = {(_slot_end(r[0]), r[self.id]) for r in waiting}
        new: dict = {}
        for r in rows:
            new[(_slot_end(int(r.us)), int(r.event_id))] = (int(r.us), *(getattr(r, f) for f in self.fields))
        waiting += [row for at, row in new.items() if at not in known]
        self._put(waiting, session)
        at = self._next(waiting, session)
        if before is None or at != before:
            self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        waiting, session = self._get()
        if not waiting and session is None:         # a timer that an earlier one took the place of
            return
        due = sorted((r for r in waiting if _slot_end(r[0]) <= now), key=lambda r: (r[0], r[self.id]))
        waiting = [r for r in waiting if _slot_end(r[0]) > now]
        for row in due:
            session, emitted = self.step(key, session, row[0], dict(zip(self.fields, row[1:])))
            yield Row(**dict(zip(self.names, emitted)))
        if not waiting and session[-1] <= now:
            self.held.clear()
            return
        if due:
            self._put(waiting, session)
        self.handle.registerTimer(self._next(waiting, session))

    def step(self, key, state, us: int, row: dict):
        """The session and the output row after one more update; the session's last field is its end."""
        seq, total, closes = state or (0, 0.0, 0)
        seq, total, closes = seq + 1, total + row["qty"], max(closes, row["closes"])
        return (seq, total, closes), (key[0], seq, us, row["event_id"], row["qty"], total)

    def close(self) -> None:
        pass


def _emergency_kind(status: str, ttc: float, pressure: float) -> str:
    if status == "critical":
        return "emergency_discount" if ttc < 1.0 else "increase_discount"
    if status == "behind":
        return "moderate_discount_increase" if pressure > 0.7 else "monitoring"
    return "no_adjustment_needed" if status == "on_track" else "consider_reducing_discount"


class ProgressMonitor(OrderedUpdates):
    """R6 + R7 + R8: the rules of ``monitor.progress_monitor`` on the ordered updates of a strategy: running total, required
    rate, status, time pressure, the emergency decision with at most ``max_adjustments`` a session, the new discount and
    the recommendations. The session ends with the promotion."""

    carried = ("event_id long, qty double, closes long, t int, initial_stock long, time_to_close double, discount double")
    session_schema = "start long, total double, needs long, closes long"
    output = ("strategy_id string, us long, event_id long, t int, total_sales double, remaining_stock double, "
              "elapsed_hours double, time_to_close double, sales_rate double, required_rate double, progress_ratio double, "
              "status string, time_pressure double, adjustment_needed int, adjustment_type string, prior_adjustments long, "
              "recommendations string, discount double, new_discount double")

    def __init__(self, increment: float = EMERGENCY_INCREMENT, floor: float = EMERGENCY_FLOOR, max_adjustments: int = MAX_ADJUSTMENTS):
        self.increment, self.floor, self.max_adjustments = increment, floor, max_adjustments

    def step(self, key, state, us, row):
        start, total, needs, closes = state or (us // 1_000_000, 0.0, 0, 0)
        total, closes = total + row["qty"], max(closes, row["closes"])
        stock, ttc, discount = row["initial_stock"], row["time_to_close"], row["discount"]
        elapsed = (us // 1_000_000 - start) / 3600.0
        rate = total / elapsed if elapsed > 0 else 0.0
        required = (stock - total) / ttc if ttc > 0 and stock > total else 0.0
        ratio = rate / required if required > 0 else 1.0
        status = "ahead" if ratio >= 1.2 else "on_track" if ratio >= 0.8 else "behind" if ratio >= 0.5 else "critical"
        pressure = min(1.0, max(0.0, 1 - ttc / elapsed)) if elapsed > 0 else 0.0
        kind = _emergency_kind(status, ttc, pressure)
        prior = min(needs, self.max_adjustments)
        blocked = prior >= self.max_adjustments
        needed = not blocked and kind in STEP_MULTIPLIER
        kind_now = "max_adjustments_reached" if blocked else kind
        advice = [kind_now if needed or kind_now == "consider_reducing_discount" else "keep_monitoring"]
        if needed and ttc < 0.5:
            advice.append("final_clearance")
        if needed and (total / stock if stock > 0 else 0.0) < 0.3 and ttc < 1.0:
            advice.append("staff_purchase_or_donation")
        new = discount
        if needed:          # as in the batch twin, an unknown discount does not get below the floor's reach
            new = self.floor if discount is None else max(self.floor, discount - self.increment * STEP_MULTIPLIER[kind])
        out = (key[0], us, row["event_id"], row["t"], total, stock - total, elapsed, ttc, rate, required, ratio, status, pressure,
               int(needed), kind_now, prior, ",".join(advice), discount, new)
        return (start, total, needs + (kind in STEP_MULTIPLIER), closes), out


def strategy_updates(rows: DataFrame, plans: DataFrame, end_hhmm: str = "22:00") -> DataFrame:
    """Updates of strategies (R1) as the processors read them: event microseconds, hours to close, end of the promotion."""
    u = sales_updates(rows, plans, end=end_hhmm)
    left = F.pmod(F.lit(int(end_hhmm[:2]) * 60 + int(end_hhmm[3:])) - F.hour("ts") * 60 - F.minute("ts") - 1, F.lit(1440)) + 1
    closes = (F.unix_timestamp(F.date_trunc("minute", F.col("ts"))) + left * 60) * 1000
    return u.select("*", F.unix_micros("ts").alias("us"), F.col("quantity_sold").alias("qty"),
                    hours_to_close(F.col("ts"), end_hhmm).alias("time_to_close"), closes.cast("long").alias("closes"))


def ordered_updates(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """R1 streaming: the updates of each strategy in event order with their number and the running total."""
    u = strategy_updates(rows, plans).select("strategy_id", "us", "event_id", "qty", "closes", "ts")
    return _emitted(u.groupBy("strategy_id"), OrderedUpdates())


def progress_stream(rows: DataFrame, plans: DataFrame, plan_rows: DataFrame) -> DataFrame:
    """R6 + R7 + R8 streaming: the same rows as ``monitor.progress_monitor``."""
    u = strategy_updates(rows, plans).join(plan_rows.select("plan_id", "t", "discount"), ["plan_id", "t"], "left")
    u = u.select("strategy_id", "us", "event_id", "qty", "closes", "t", "initial_stock", "time_to_close", "discount", "ts")
    return _emitted(u.groupBy("strategy_id"), ProgressMonitor())


# ---- R10: smoothed rates

class RateSmoother(StatefulProcessor):
    """Units of a (plan, stage) are summed by day; when the watermark passes a day's end its observed
    rate is folded into ``alpha * observed + (1 - alpha) * old``. The rate stays in state, closed days do not. Rate and
    open days are one value, and only the first open day has a timer (see ``OrderedUpdates``)."""

    output = "plan_id string, t int, day int, days long, observed_rate double, smoothed_rate double"

    def __init__(self, stage_hours: float = 0.5, alpha: float = SMOOTHING_ALPHA):
        self.stage_hours, self.alpha = stage_hours, alpha

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "rate double, days long, closes array<bigint>, day array<int>, units array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held, open_ = self.held.get(), {}
        rate, days = held[:2] if held is not None else (None, 0)
        if held is not None:
            open_ = {closes: [day, units] for closes, day, units in zip(*held[2:])}
        before = min(open_, default=None)
        for r in rows:
            if rate is None:
                rate = float(r.base_rate)
            open_.setdefault(int(r.closes), [int(r.day), 0.0])[1] += 0.0 if r.qty is None else float(r.qty)
        self._put(rate, days, open_)
        if min(open_) != before:
            self.handle.registerTimer(min(open_))
        return iter(())

    def _put(self, rate, days, open_) -> None:
        self.held.update((rate, days, list(open_), [d for d, _ in open_.values()], [u for _, u in open_.values()]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        rate, days, *held = self.held.get()
        open_ = {closes: [day, units] for closes, day, units in zip(*held)}
        due = sorted(closes for closes in open_ if closes <= now)
        for closes in due:
            day, units = open_.pop(closes)
            observed = units / self.stage_hours
            rate, days = observed * self.alpha + rate * (1 - self.alpha), days + 1
            yield Row(plan_id=key[0], t=key[1], day=day, days=days, observed_rate=observed, smoothed_rate=rate)
        if due:
            self._put(rate, days, open_)
            if open_:
                self.handle.registerTimer(min(open_))

    def close(self) -> None:
        pass


def smoothed_rates(rows: DataFrame, plans: DataFrame, base: DataFrame) -> DataFrame:
    """R10 streaming: one row for each closed day of a (plan, stage); ``base`` holds (plan_id, t, base_rate), 1.0 where it is missing."""
    u = strategy_updates(rows, plans).join(base, ["plan_id", "t"], "left")
    u = u.select("plan_id", "t", F.unix_date("sale_date").alias("day"), "closes", "qty", F.coalesce("base_rate", F.lit(1.0)).alias("base_rate"), "ts")
    return _emitted(u.groupBy("plan_id", "t"), RateSmoother())
