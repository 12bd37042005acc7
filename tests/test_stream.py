"""The stateful processors: event order, duplicates, late updates, emptied state, equality with the batch twins."""

import datetime as dt
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from tillsight.sources.starschema import as_hourly
from tillsight.streaming import monitor as MON
from tillsight.streaming import stream as ST

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def some_events(seed, n=240):
    rng = random.Random(seed)
    start = dt.datetime(2024, 3, 1, 20, 0)
    return [(i, start + dt.timedelta(days=rng.randrange(4), seconds=rng.randrange(7200), microseconds=rng.randrange(10**6)),
             rng.choice([1, 1, 1, 2, 3]), "view", 5.0, '{"k": 1}') for i in range(n)]


@pytest.fixture(scope="module")
def plans(spark):
    return spark.createDataFrame([("0", str(u), f"0-{u}", s) for u, s in ((1, 300), (2, 25), (3, 0))],
                                 "store_code string, product_code string, plan_id string, initial_stock long")


@pytest.fixture(scope="module")
def plan_rows(spark):
    return spark.createDataFrame([(f"0-{u}", t, 0.9 - t / 10) for u in (1, 2) for t in range(4)], "plan_id string, t int, discount double")


def rows(df):
    return sorted(map(str, df.collect()))


def left_in_state(progress):
    return progress[-1]["stateOperators"][0]["numRowsTotal"]


def test_arrivals_are_out_of_event_order(spark):
    events = spark.createDataFrame(some_events(1, 2000), SCHEMA)
    first, second = ST.arrivals(events)
    assert first.count() + second.count() == 2001
    held = second.where(F.col("event_id") != ST.HEARTBEAT)
    overlap = held.agg(F.min("ts")).first()[0], first.agg(F.max("ts")).first()[0]
    assert overlap[0] < overlap[1] < overlap[0] + dt.timedelta(minutes=10)
    empty = ST.arrivals(events.limit(0))
    assert [x.count() for x in empty] == [0, 0]


@pytest.mark.parametrize("seed", [1, 2])
def test_progress_equals_batch_twin(spark, plans, plan_rows, seed):
    events = spark.createDataFrame(some_events(seed), SCHEMA)
    twice = tuple(part.unionByName(part.where("event_id % 7 = 0")) for part in ST.arrivals(events))     # delivered twice
    progress = []
    got = ST.run_deliveries(twice, "test-progress", lambda s: ST.progress_stream(s, plans, plan_rows), progress)
    want = MON.progress_monitor(MON.sales_updates(as_hourly(events), plans), plan_rows)
    assert want.count() == 240 and rows(got) == rows(want.select(*got.columns))
    assert {r.adjustment_type for r in want.collect()} >= {"max_adjustments_reached", "increase_discount"}
    # every strategy has ended: nothing is left, no session, no buffer, no timer
    assert left_in_state(progress) == 0


def test_order_within_and_across_deliveries(spark, plans):
    """Three deliveries in the worst order; an update behind the watermark is dropped, one ahead of it is not."""
    at = lambda m, s=0: dt.datetime(2024, 3, 1, 20, m, s)
    row = lambda i, ts: (i, ts, 1, "view", 5.0, '{"k": 1}')
    parts = [[row(9, at(12)), row(4, at(9)), row(5, at(9))], [row(2, at(3)), row(1, at(2, 30)), row(9, at(12))],
             [row(3, at(30)), row(7, at(30))], [row(6, at(5)), row(8, at(21, 1))], [row(ST.HEARTBEAT, at(0) + dt.timedelta(days=1))]]
    got = ST.run_deliveries([spark.createDataFrame(p, SCHEMA) for p in parts], "test-order", lambda s: ST.ordered_updates(s, plans)).collect()
    # before the fourth delivery the watermark stands at 20:20, so 6 is too late
    assert [r.event_id for r in sorted(got, key=lambda r: r.seq)] == [1, 2, 4, 5, 9, 8, 3, 7]
    assert [r.seq for r in sorted(got, key=lambda r: (r.ts, r.event_id))] == list(range(1, 9))
    total = 0.0
    for r in sorted(got, key=lambda r: r.seq):
        total += 1 + r.event_id % 5
        assert r.total_sales == total


class CountedState:
    """A processor's handle and state, with the calls that would go to the JVM counted."""
    value, calls = None, 0

    def __init__(self):
        self.timers = set()

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def clear(self):
        self.calls += 1
        self.value = None

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def fire(self, processor, key, watermark):
        out = []
        while due := sorted(t for t in self.timers if t <= watermark):
            self.timers.remove(due[0])
            out += processor.handleExpiredTimer(key, TimerValues(-1, watermark), ExpiredTimerInfo(due[0]))
        return out


def test_calls_for_state_do_not_grow_with_slots_and_days():
    us = lambda i: (1_709_323_200 + i * 150) * 1_000_000
    closes = 1_709_330_400_000
    updates = [Row(us=us(i), event_id=i, qty=1.0, closes=closes) for i in range(48)]         # 24 slots
    state, ordered = CountedState(), ST.OrderedUpdates()
    ordered.init(state)
    list(ordered.handleInputRows(("s",), iter(updates[::-1] + updates[:9]), TimerValues(-1, -1)))
    out = state.fire(ordered, ("s",), closes)
    assert [(r.event_id, r.seq, r.total_sales) for r in out] == [(i, i + 1, i + 1.0) for i in range(48)]
    assert state.value is None and not state.timers and state.calls <= 6

    day = 86_400_000
    sales = [Row(closes=closes + i * day, day=i, qty=2.0, base_rate=1.0) for i in range(60)]
    state, rates = CountedState(), ST.RateSmoother()
    rates.init(state)
    list(rates.handleInputRows(("p", 1), iter(sales[::-1]), TimerValues(-1, -1)))
    out = state.fire(rates, ("p", 1), closes + 39 * day)
    assert [(r.day, r.days) for r in out] == [(i, i + 1) for i in range(40)] and out[0].smoothed_rate == 4.0 * 0.4 + 0.6
    assert len(state.fire(rates, ("p", 1), closes + 60 * day)) == 20 and state.calls <= 9


def test_rates_equal_batch_twin(spark, plans):
    events = spark.createDataFrame(some_events(3), SCHEMA)
    base = spark.createDataFrame([("0-1", 0, 2.0), ("0-2", 3, 0.5)], "plan_id string, t int, base_rate double")
    progress = []
    got = ST.run_deliveries(ST.arrivals(events.orderBy(F.rand(5))), "test-rates", lambda s: ST.smoothed_rates(s, plans, base), progress)
    updates = MON.sales_updates(as_hourly(events), plans)
    want = MON.smoothed_rate_history(updates, base)
    assert rows(got) == rows(want.select(*got.columns))
    last = {(r.plan_id, r.t): (r.days, r.smoothed_rate) for r in sorted(want.collect(), key=lambda r: r.days)}
    assert last == {(r.plan_id, r.t): (r.days, r.smoothed_rate) for r in MON.smoothed_base_rates(updates, base).collect()}
    # only the recursive rate of each (plan, stage) stays
    assert left_in_state(progress) == len(last)


def test_windows_are_all_emitted(spark):
    events = spark.createDataFrame(some_events(4), SCHEMA)
    got = ST.run_deliveries(ST.arrivals(events), "test-windows", ST.windowed_sales)
    want = (as_hourly(events).groupBy("product_code", F.window("sale_ts", "5 minutes").alias("w"))
            .agg(F.count("*").alias("updates"), F.sum("qty").alias("units")))
    assert rows(got.select("product_code", "window_start", "updates", "units")) == rows(
        want.select("product_code", F.col("w.start").alias("window_start"), "updates", "units"))
