"""Daily seasonal forecasts with regressors and future holidays (M13, M14), for all series at once.

A series is a key's gap-free daily rows. Its terms are a trend with hinges, weekly and yearly waves, the holiday
window and regressors; the coefficients come from sums of products per key (``gram``), so a series' rows need not meet, and
the horizon is scored with the same terms. Regressors of the horizon are built with the DataFrame API:
numbers by their recent mean or weekday pattern, flags by their frequency, other values by the last one."""

from __future__ import annotations

from typing import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import cut_lineage
from .gram import BLOCK, matrix, residual_std
from .gram import ridge as solve_ridge
from .ml import SERIES, _design, day_lookup, holiday_values, packed_series, terms_in_use, trend_terms
from .patterns import future_regressor

HORIZON, MIN_DAYS, YEAR, RIDGE = 7, 14, 365, 1.0


def flag_draw(*cols) -> F.Column:
    """A number in [0, 1) that hangs on the columns' texts alone."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 7), 16, 10).cast("double") / F.lit(float(1 << 28))


def future_values(daily: DataFrame, numbers: Sequence[str] = (), flags: Sequence[str] = (), last: Sequence[str] = (),
                  keys: Sequence[str] = ("product_code",), date_col: str = "sale_date", horizon: int = HORIZON,
                  last_date: str | None = None, runs: bool = False) -> DataFrame:
    """(keys, ds, regressors) for the ``horizon`` days after each key's last row.

    Numbers: ``future_regressor`` (last-7 mean, or the weekday mean where weekdays differ). Flags: 1 on as many days as
    their frequency asks for, drawn by a fixed hash of key, day and name. Others: the value of the last row, 0 where it is null.
    ``last_date`` names the column with the key's last date, where gap-free rows have one. ``runs``: the rows are a grid's runs, whose
    empty days hold ``fill_<c>`` as a number and 0 as a flag."""
    keys = list(keys)
    out = None
    for c in numbers:
        own = future_regressor(daily, keys, c, date_col, horizon, last_date, f"fill_{c}" if runs else None)
        out = own if out is None else out.join(own, keys + ["ds"])
    days = F.datediff(F.max(date_col), F.min(date_col)) + 1
    rate = lambda c: F.sum(F.col(c).cast("double")) / days if runs else F.avg(F.col(c).cast("double"))
    stats = daily.groupBy(*keys).agg(F.max(date_col).alias("__last"), *[rate(c).alias(f"__rate_{c}") for c in flags],
                                     *[F.max_by(c, date_col).alias(f"__last_{c}") for c in last])
    days = stats.withColumn("ds", F.explode(F.sequence(F.date_add("__last", 1), F.date_add("__last", horizon))))
    drawn = [F.when(flag_draw(*[F.col(k).cast("string") for k in keys], F.col("ds").cast("string"), F.lit(c)) < F.col(f"__rate_{c}"), 1.0)
             .otherwise(0.0).alias(c) for c in flags]
    days = days.select(*keys, "ds", *drawn, *[F.coalesce(F.col(f"__last_{c}").cast("double"), F.lit(0.0)).alias(c) for c in last])
    return days if out is None else out.join(days, keys + ["ds"])


def holiday_window(dates: DataFrame, holidays: DataFrame, days: int = 2) -> DataFrame:
    """(date, holiday_window) of ``dates``: 1.0 within ``days`` days of a day off of ``holidays`` (date, kind)."""
    near = holidays.where("kind <> 'work'").select(F.explode(F.sequence(F.date_sub("date", days), F.date_add("date", days))).alias("date"))
    return dates.join(near.distinct().withColumn("holiday_window", F.lit(1.0)), "date", "left").fillna(0.0, ["holiday_window"])


def _terms(regressors: Sequence[str]):
    def design(c: dict) -> np.ndarray:
        x = _design(c["__t"].astype(float), bool(c["__yearly"][0]), c["holiday_window"].astype(float), float(c["__end"][0]))
        return np.column_stack([x, *[c[r].astype(float) for r in regressors]])
    return design


def _penalty(ridge: float, regressors: int):
    """No penalty on the constant; on regressors the ridge of their standardised form."""
    def penalty(xtx: np.ndarray, n: float) -> np.ndarray:
        out = np.full(len(xtx), ridge)
        out[0] = 0.0
        if regressors:
            mean = xtx[0, -regressors:] / n
            out[-regressors:] = ridge * np.maximum(np.diag(xtx)[-regressors:] / n - mean * mean, 1e-12)
        return out
    return penalty


def series_span(daily: DataFrame, key: str = "product_code", min_days: int = MIN_DAYS) -> DataFrame:
    """First day, number of the last day and whether a year is spanned, of each series with at least ``min_days`` days."""
    span = daily.groupBy(key).agg(F.min("sale_date").alias("__d0"), F.max("sale_date").alias("__d1"), F.count("*").alias("__n"))
    return span.where(F.col("__n") >= min_days).select(
        key, "__d0", F.datediff("__d1", "__d0").cast("double").alias("__end"), (F.col("__n") >= YEAR).alias("__yearly"))


def series_rows(daily: DataFrame, calendar: DataFrame, key: str = "product_code", span: DataFrame | None = None) -> DataFrame:
    """Rows of the series of ``series_span``, with their day number and the holiday window of the day."""
    out = daily.join(span if span is not None else series_span(daily, key), key).withColumn("__t", F.datediff("sale_date", "__d0").cast("double"))
    return out.join(F.broadcast(calendar.withColumnRenamed("date", "sale_date")), "sale_date", "left").fillna(0.0, ["holiday_window"])


def fit_series(rows: DataFrame, regressors: Sequence[str] = (), key: str = "product_code", ridge: float = RIDGE, target: str = "qty") -> DataFrame:
    """(key, n, beta, sigma) of each series of ``series_rows``; null regressors count as 0.

    The sums of products of a series (some thousand numbers) are added up and solved in the task that holds its days,
    so that only coefficients leave it; rows dealt by key, as ``daily_grid`` leaves them, are not moved."""
    rows = rows.fillna(0.0, list(regressors)) if regressors else rows
    inputs = ["__t", "__end", "__yearly", "holiday_window", *regressors]
    rows = rows.select(key, *inputs, F.col(target).cast("double").alias("__y"))
    design, penalty = _terms(regressors), _penalty(ridge, len(regressors))
    schema = to_arrow_schema(rows.select(key).schema)
    for f in (pa.field("n", pa.int64()), pa.field("beta", pa.list_(pa.float64())), pa.field("sigma", pa.float64())):
        schema = schema.append(f)

    def fit(series: pa.Table) -> pa.Table:
        c = {name: series.column(name).to_numpy() for name in [*inputs, "__y"]}
        z = 0.0
        for a in range(0, series.num_rows, BLOCK):
            part = {name: v[a:a + BLOCK] for name, v in c.items()}
            rows_ = np.column_stack([design(part), part["__y"]])
            z = z + rows_.T @ rows_
        xtx, xty, yty, n = matrix(z, len(z) - 1)
        b = solve_ridge(xtx.copy(), xty, penalty(xtx, n))
        return pa.table([series.column(key)[:1].cast(schema.field(key).type), pa.array([int(n)], pa.int64()),
                         pa.array([b.tolist()], pa.list_(pa.float64())), pa.array([residual_std(xtx, xty, yty, n, b)], pa.float64())], schema=schema)

    kind = rows.schema[key].dataType.simpleString()
    return rows.groupBy(key).applyInArrow(fit, f"`{key}` {kind}, n long, beta array<double>, sigma double")


def seasonal_forecast(daily: DataFrame, calendar: DataFrame, numbers: Sequence[str] = (), flags: Sequence[str] = (),
                      last: Sequence[str] = (), key: str = "product_code", horizon: int = HORIZON, ridge: float = RIDGE,
                      future: DataFrame | None = None, last_date: str | None = None, runs: bool = False) -> DataFrame:
    """M13 + M14: (key, ds, yhat, yhat_lower, yhat_upper) for the ``horizon`` days after each series.

    ``daily``: gap-free rows (key, sale_date, qty, regressors). ``calendar``: (date, holiday_window), history and horizon;
    days without an entry are no holidays. ``future`` replaces the regressors that ``future_values`` would build. The interval is
    1.96 residual deviations. Series shorter than ``MIN_DAYS`` give nothing. ``runs``: ``daily`` is a grid's runs, whose empty days are
    added up without being made."""
    regressors = [*numbers, *flags, *last]
    if runs:
        daily = cut_lineage(daily)
        future = future if future is not None else future_values(daily, numbers, flags, last, [key], horizon=horizon, last_date=last_date, runs=True)
        return _forecast_runs(daily, calendar, future, regressors, numbers, key, ridge)
    span = cut_lineage(series_span(daily, key))
    fits = fit_series(series_rows(daily, calendar, key, span), regressors, key, ridge)
    future = future if future is not None else future_values(daily, numbers, flags, last, [key], horizon=horizon, last_date=last_date)
    ahead = (future.withColumnRenamed("ds", "sale_date").join(span, key)
             .withColumn("__t", F.datediff("sale_date", "__d0").cast("double"))
             .join(F.broadcast(calendar.withColumnRenamed("date", "sale_date")), "sale_date", "left").fillna(0.0, ["holiday_window", *regressors]))
    ahead = ahead.join(fits, key).select(key, "sale_date", "__t", "__end", "__yearly", "holiday_window", *regressors, "beta", "sigma")
    design = _terms(regressors)

    def score(batches):
        for batch in batches:
            cols = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ["__t", "__end", "__yearly", "holiday_window", *regressors]}
            beta = batch.column("beta").to_pylist()
            hat = np.array([design({c: v[i:i + 1] for c, v in cols.items()})[0] @ np.array(b) for i, b in enumerate(beta)])
            wide = 1.96 * batch.column("sigma").to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("sale_date"), pa.array(hat, pa.float64()), pa.array(hat - wide, pa.float64()),
                                              pa.array(hat + wide, pa.float64())], names=[key, "ds", "yhat", "yhat_lower", "yhat_upper"])

    kind = daily.schema[key].dataType.simpleString()
    return ahead.mapInArrow(score, f"`{key}` {kind}, ds date, yhat double, yhat_lower double, yhat_upper double")


def _forecast_runs(runs: DataFrame, calendar: DataFrame, future: DataFrame, regressors: Sequence[str], numbers: Sequence[str], key: str,
                   ridge: float) -> DataFrame:
    """``seasonal_forecast`` of a grid's runs. The terms of the day number are the same for all series: their sums are prefixes of one
    running matrix, to which each series adds its holidays and the days that sold; a regressor is its value on empty
    days and what the days that sold differ from it."""
    days, values = holiday_values(calendar)
    fills = [f"fill_{c}" if c in numbers else None for c in regressors]
    own = packed_series(runs.where(F.col(key).isNotNull()), ["qty", *regressors, *[f for f in fills if f]], key).where(F.col("n") >= MIN_DAYS)
    ahead = future.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ds", *[F.col(c).cast("double").alias(c) for c in regressors]))).alias("ahead"))
    held, penalty = len(regressors), _penalty(ridge, len(regressors))

    def numbers_of(rows, names):
        cols = [np.nan_to_num(rows.field(c).to_numpy(zero_copy_only=False).astype(float), nan=0.0, posinf=np.inf, neginf=-np.inf) for c in names]
        return np.column_stack(cols) if cols else np.zeros((len(rows), 0))

    def run(batches):
        for batch in (b.slice(a, SERIES) for b in batches for a in range(0, b.num_rows, SERIES)):
            d0, n = (batch.column(c).to_numpy().astype(np.int64) for c in ("d0", "n"))
            parts = []
            for name, day in (("days", "sale_date"), ("ahead", "ds")):
                rows = batch.column(name).flatten()
                ends = np.cumsum(batch.column(name).value_lengths().to_numpy())
                at = rows.field(day).cast(pa.int32()).to_numpy().astype(np.int64) - np.repeat(d0, np.diff(np.r_[0, ends]))
                parts.append((rows, np.r_[0, ends], at))
            (rows, ends, t), (coming, ends2, t2) = parts
            y = rows.field("qty").to_numpy(zero_copy_only=False).astype(float)
            r, r2 = numbers_of(rows, regressors), numbers_of(coming, regressors)
            empty = np.zeros((len(n), held))
            for j, f in enumerate(fills):
                if f:
                    empty[:, j] = numbers_of(rows, [f])[ends[:-1], 0]
            x = trend_terms(int(n.max()), max(7, int(t2.max()) + 1 - int(n.max())))
            starts, first = np.unique(d0, return_inverse=True)
            flags = day_lookup(days, values, starts, len(x), 0)
            hat, wide = np.zeros(len(t2)), np.zeros(len(t2))
            g, done, use = np.zeros((x.shape[1], x.shape[1])), 0, None
            for i in np.argsort(n, kind="stable"):
                m = int(n[i])
                if m > done or use is None:
                    g += x[done:m].T @ x[done:m]
                    done, use = m, terms_in_use(m - 1, m >= YEAR)
                    base, own_x = g[np.ix_(use, use)], x[:, use]
                w = len(use)
                s, e = slice(ends[i], ends[i + 1]), slice(ends2[i], ends2[i + 1])
                hol = flags[first[i]]
                off = np.flatnonzero(hol[:m])
                h, ts, ys = hol[off], t[s], y[s]
                xs, hs, mean, dev = own_x[ts], hol[ts], empty[i], r[s] - empty[i]
                # [terms, holidays, regressors, quantity]'[the same], empty days as their constant values
                z = np.zeros((w + held + 2, w + held + 2))
                z[:w, :w] = base
                z[:w, w] = h @ own_x[off]
                z[w, w] = h @ h
                z[:w, w + 1:-1] = np.outer(base[0], mean) + xs.T @ dev
                z[w, w + 1:-1] = h.sum() * mean + hs @ dev
                total = dev.sum(axis=0)
                z[w + 1:-1, w + 1:-1] = m * np.outer(mean, mean) + np.outer(mean, total) + np.outer(total, mean) + dev.T @ dev
                z[:w, -1], z[w, -1], z[w + 1:-1, -1], z[-1, -1] = xs.T @ ys, hs @ ys, mean * ys.sum() + dev.T @ ys, ys @ ys
                z = np.triu(z) + np.triu(z, 1).T
                xtx, xty, yty, _ = matrix(z, w + held + 1)
                b = solve_ridge(xtx.copy(), xty, penalty(xtx, float(m)))
                hat[e] = np.column_stack([own_x[t2[e]], hol[t2[e]], r2[e]]) @ b
                wide[e] = 1.96 * residual_std(xtx, xty, yty, float(m), b)
            owner = pc.list_parent_indices(batch.column("ahead"))
            yield pa.RecordBatch.from_arrays([batch.column(key).take(owner), coming.field("ds"), pa.array(hat), pa.array(hat - wide), pa.array(hat + wide)],
                                             names=[key, "ds", "yhat", "yhat_lower", "yhat_upper"])

    kind = runs.schema[key].dataType.simpleString()
    return own.join(ahead, key).mapInArrow(run, f"`{key}` {kind}, ds date, yhat double, yhat_lower double, yhat_upper double")


def run_sums(runs: DataFrame, calendar: DataFrame, key: str = "product_code", min_days: int = MIN_DAYS) -> DataFrame:
    """``gram`` of [1, years since the first day, holiday window] and the quantity over the series of a grid's ``runs`` with at least
    ``min_days`` days: (key, p, z). Sums over all days of a series follow from its first and last day, those with quantities
    from the days that sold."""
    ends = F.min("sale_date").alias("a"), F.max("sale_date").alias("b")
    span = calendar.where("holiday_window <> 0 and date is not null").select(F.unix_date("date").alias("u"), F.col("holiday_window").cast("double").alias("v"))
    rows = sorted(map(tuple, span.collect()))                       # a few days a year
    at = np.array([r[0] for r in rows], np.int64)
    sums = np.array([[v, v * u, v * v] for u, v in rows], float).reshape(-1, 3)
    sums = np.vstack([np.zeros(3), np.cumsum(sums, axis=0)])        # of the holidays before each place
    flags = F.broadcast(calendar.select(F.col("date").alias("sale_date"), F.col("holiday_window").alias("__h")))
    y, t, h = F.col("qty").cast("double"), F.unix_date("sale_date").cast("double"), F.coalesce("__h", F.lit(0.0))
    own = runs.where(F.col(key).isNotNull()).join(flags, "sale_date", "left").groupBy(key).agg(
        *ends, F.sum(y).alias("sy"), F.sum(t * y).alias("ty"), F.sum(h * y).alias("hy"), F.sum(y * y).alias("yy"))
    own = own.where(F.datediff("b", "a") + 1 >= min_days).select(key, F.unix_date("a").alias("a"), F.unix_date("b").alias("b"), "sy", "ty", "hy", "yy")

    def add(batches):
        for batch in batches:
            a, b = (batch.column(c).to_numpy().astype(np.int64) for c in ("a", "b"))
            sy, ty, hy, yy = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("sy", "ty", "hy", "yy"))
            n = (b - a + 1).astype(float)
            s, hu, hh = (sums[np.searchsorted(at, b, side="right")] - sums[np.searchsorted(at, a)]).T
            s1, s11 = n * (n - 1) / 2, (n - 1) * n * (2 * n - 1) / 6
            th, ty = hu - a * s, ty - a * sy
            year = 365.25
            z = np.stack([n, s1 / year, s, sy, s1 / year, s11 / year ** 2, th / year, ty / year, s, th / year, hh, hy, sy, ty / year, hy, yy], axis=1)
            z = pa.ListArray.from_arrays(pa.array(np.arange(0, 16 * len(n) + 1, 16, dtype=np.int32)), pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(np.full(len(n), 3, np.int32)), z], names=[key, "p", "z"])

    kind = runs.schema[key].dataType.simpleString()
    return own.mapInArrow(add, f"`{key}` {kind}, p int, z array<double>")
