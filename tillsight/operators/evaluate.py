"""Forecast evaluation.

Input: a predictions frame with key columns, ``actual`` and ``predicted``.
Every metric is a grouped aggregate (per model and/or product); curves and
rankings run inside a key (bounded by the key's rows) or over the small
per-model metric table, never as a window over all prediction rows.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .quantiles import exact_quantiles, join_groups


def row_errors(pred: DataFrame) -> DataFrame:
    """error = actual - predicted, absolute error, relative % (0 actual -> /1), clipped +-100."""
    a, p = F.col("actual"), F.col("predicted")
    err = a - p
    rel = err / F.when(a != 0, a).otherwise(F.lit(1.0)) * 100
    return pred.select("*", err.alias("error"), F.abs(err).alias("abs_error"), rel.alias("rel_error_pct"),
                       F.least(F.greatest(rel, F.lit(-100.0)), F.lit(100.0)).alias("rel_error_clipped"))


def with_key_means(pred: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attach the key's mean actual / predicted (grouped, joined back on the key)."""
    m = pred.groupBy(*keys).agg(F.avg("actual").alias("key_mean_actual"), F.avg("predicted").alias("key_mean_predicted"))
    return pred.join(m, list(keys), "left")


def regression_metrics(pred: DataFrame, keys: Sequence[str]) -> DataFrame:
    """E1 + E2 + E9 + V6 per group: MSE, MAE, RMSE, R2, MAPE (0 actual -> /1), MAPE on
    non-zero actuals, SMAPE, rating from R2 and the sanity label."""
    a, p = F.col("actual"), F.col("predicted")
    err = a - p
    g = pred.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(err * err).alias("mse"), F.avg(F.abs(err)).alias("mae"),
        F.sum(err * err).alias("_ssr"), F.var_pop(a).alias("_var"),
        (F.avg(F.abs(err / F.when(a != 0, a).otherwise(F.lit(1.0)))) * 100).alias("mape"),
        (F.avg(F.when(a != 0, F.abs(err / a))) * 100).alias("_mape_nz"),
        (F.avg(F.when((F.abs(a) + F.abs(p)) != 0, F.abs(p - a) / (F.abs(a) + F.abs(p)))) * 200).alias("_smape"),
        F.bool_and(F.abs(a - p) <= 1e-8 + 1e-5 * F.abs(p)).alias("_close"))
    r2 = 1 - F.col("_ssr") / (F.col("_var") * F.col("n"))
    g = g.withColumn("rmse", F.sqrt("mse")).withColumn("r2", F.when(F.col("_var") > 0, r2))
    rating = (F.when(F.col("r2") > 0.8, "excellent").when(F.col("r2") > 0.6, "good")
               .when(F.col("r2") > 0, "needs_improvement").otherwise("negative_r2"))
    sanity = (F.when(F.col("n") < 10, "too_few_samples").when(F.col("_close"), "identical_predictions")
               .when(F.col("r2") < 0, "negative_r2").when(F.col("r2") < 0.3, "low_r2"))
    return g.select(*keys, "n", "mse", "mae", "rmse", "r2", "mape",
                    F.coalesce("_mape_nz", F.lit(0.0)).alias("mape_nonzero"), F.coalesce("_smape", F.lit(0.0)).alias("smape"),
                    rating.alias("rating"), sanity.alias("quality_warning"))


def accuracy_bands(errs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """E4 + E5: share (%) within 10/20/30 %, over / under / perfect predictions
    (error = actual - predicted, so over-prediction is error < 0), and the
    distribution over <=10, 10-20, 20-50, >50 % bands."""
    r = F.abs(F.col("rel_error_pct"))
    e = F.col("error")

    def pct(cond):
        return (F.avg(cond.cast("double")) * 100)
    return errs.groupBy(*keys).agg(
        pct(r <= 10).alias("within_10"), pct(r <= 20).alias("within_20"), pct(r <= 30).alias("within_30"),
        pct(e < 0).alias("over_prediction"), pct(e > 0).alias("under_prediction"), pct(e == 0).alias("perfect"),
        pct((r > 10) & (r <= 20)).alias("band_10_20"), pct((r > 20) & (r <= 50)).alias("band_20_50"),
        pct(r > 50).alias("band_over_50"))


def key_accuracy(errs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key samples, mean actual / predicted, mean |error|, mean |rel %|, accuracy clipped to [0, 1]."""
    g = errs.groupBy(*keys).agg(F.count("*").alias("samples"), F.avg("actual").alias("mean_actual"),
                                F.avg("predicted").alias("mean_predicted"), F.avg("abs_error").alias("mae"),
                                F.avg(F.abs("rel_error_pct")).alias("mean_rel_error"))
    acc = 1 - F.col("mae") / F.when(F.col("mean_actual") > 0, F.col("mean_actual")).otherwise(F.lit(1.0))
    return g.withColumn("accuracy", F.least(F.greatest(acc, F.lit(0.0)), F.lit(1.0)))


def best_keys(acc: DataFrame, key: str = "product_code", min_samples: int = 5, pool: int = 10, k: int = 3) -> DataFrame:
    """T5: keys with >= 5 samples -> the 10 with most samples -> the 3 most accurate
    (a top-k over the small per-key table; ties by key)."""
    valid = acc.where(F.col("samples") >= min_samples)
    top = valid.orderBy(F.desc("samples"), F.asc(key)).limit(pool)
    return top.orderBy(F.desc("accuracy"), F.asc(key)).limit(k)


def level_bins(errs: DataFrame, keys: Sequence[str], n: int = 5) -> DataFrame:
    """Sales-level bins per key: quantile bins (right-closed, lowest included) when
    all n+1 quantile edges are distinct; else equal-width bins over [min, max]
    (right-closed, the minimum itself unbinned, as pandas ``cut``) when >= n distinct
    values; else one bin per distinct value. Mean actual / predicted / error per bin;
    keys with a single bin are dropped."""
    keys = list(keys)
    edges = exact_quantiles(errs, "actual", [i / n for i in range(n + 1)], keys).select(*keys, F.col("q").alias("_q"))
    st = errs.groupBy(*keys).agg(F.min("actual").alias("_lo"), F.max("actual").alias("_hi"), F.count_distinct("actual").alias("_nd"))
    j = join_groups(errs, cut_lineage(st.join(edges, keys)), keys)
    a = F.col("actual")
    quant = F.size(F.array_distinct("_q")) == n + 1
    qbin = F.size(F.filter(F.slice("_q", 2, n - 1), lambda e: e < a))
    width = (F.col("_hi") - F.col("_lo")) / n
    ebin = F.when(a > F.col("_lo"), F.least(F.ceil((a - F.col("_lo")) / width) - 1, F.lit(n - 1)))
    pw = (F.col("_hi") + 0.1 - (F.col("_lo") - 0.1)) / F.col("_nd")
    pbin = F.least(F.ceil((a - (F.col("_lo") - 0.1)) / pw) - 1, F.col("_nd") - 1)
    b = (F.when(quant, qbin).when(F.col("_nd") >= n, ebin).when(F.col("_nd") >= 2, pbin)).cast("int")
    g = j.withColumn("level", b).where(F.col("level").isNotNull()).groupBy(*keys, "level").agg(
        F.avg("actual").alias("mean_actual"), F.avg("predicted").alias("mean_predicted"), F.avg("error").alias("mean_error"))
    multi = g.groupBy(*keys).agg(F.count("*").alias("_nb")).where(F.col("_nb") > 1).select(*keys)
    return g.join(multi, keys, "left_semi")


def error_histogram(errs: DataFrame, keys: Sequence[str], bins: int = 30, value: str = "error") -> DataFrame:
    """Equal-width histogram of the errors per key (numpy rules: last bin closed,
    a constant column spans value +- 0.5)."""
    keys = list(keys)
    st = errs.groupBy(*keys).agg(F.min(value).alias("_mn"), F.max(value).alias("_mx"))
    lo = F.when(F.col("_mx") == F.col("_mn"), F.col("_mn") - 0.5).otherwise(F.col("_mn"))
    hi = F.when(F.col("_mx") == F.col("_mn"), F.col("_mx") + 0.5).otherwise(F.col("_mx"))
    st = st.select(*keys, lo.alias("_lo"), ((hi - lo) / bins).alias("_w"))
    j = errs.join(st, keys)
    b = F.least(F.floor((F.col(value) - F.col("_lo")) / F.col("_w")), F.lit(bins - 1)).cast("int")
    return j.groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("count"))


def cumulative_accuracy(errs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key, sorted absolute errors and the share of samples at or below each."""
    w = Window.partitionBy(*keys).orderBy("abs_error", "sale_date")
    n = F.count("*").over(Window.partitionBy(*keys))
    return errs.select(*keys, "sale_date", "abs_error", (F.row_number().over(w) / n).alias("cum_share"))


def nearest_date_sample(df: DataFrame, keys: Sequence[str], date_col: str = "sale_date", n: int = 100) -> DataFrame:
    """For keys with more than n rows, the rows nearest to each of n targets spread
    evenly from the key's first to its last date (earlier row on ties); keys with <= n rows
    are kept whole. A target is a time of day between two dates, counted in seconds.

    An as-of lookup without a range join: the n target days are exploded per key,
    unioned with the key's dates, and the previous / next real date come from
    ``last``/``first(ignorenulls)`` windows inside the key."""
    keys = list(keys)
    st = df.groupBy(*keys).agg(F.min(date_col).alias("_d0"), F.max(date_col).alias("_d1"), F.count("*").alias("_n"))
    big = st.where(F.col("_n") > n)
    # whole numbers: days since the epoch times (n - 1)
    day = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date")).cast("long") * (n - 1)
    targets = big.select(*keys, F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (
        day(F.col("_d0")) + i * F.datediff("_d1", "_d0")))).alias("_t"))
    real = df.join(big.select(*keys), keys, "left_semi").select(*keys, day(F.col(date_col)).alias("_t"),
                                                                  F.col(date_col).alias("_real"))
    u = targets.withColumn("_real", F.lit(None).cast("date")).unionByName(real)
    # among equal times the real date stands first, so that it is the previous one of its target
    w = Window.partitionBy(*keys).orderBy("_t", F.col("_real").asc_nulls_last())
    prev = F.last("_real", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    nxt = F.first("_real", True).over(w.rowsBetween(0, Window.unboundedFollowing))
    pick = (u.select(*keys, "_t", "_real", prev.alias("_p"), nxt.alias("_x")).where(F.col("_real").isNull())
              .select(*keys, F.when(F.col("_p").isNull(), F.col("_x")).when(F.col("_x").isNull(), F.col("_p"))
                      .when(F.col("_t") - day(F.col("_p")) <= day(F.col("_x")) - F.col("_t"), F.col("_p")).otherwise(F.col("_x"))
                      .alias(date_col)).distinct())
    small = df.join(st.where(F.col("_n") <= n).select(*keys), keys, "left_semi")
    return small.unionByName(df.join(pick, keys + [date_col], "left_semi"))


METRIC_DIRECTION = {"rmse": "low", "mae": "low", "mape": "low", "r2": "high"}


def rank_models(metrics: DataFrame, model: str = "model") -> DataFrame:
    """W11 + W12 + T7: per metric the model's rank (average rank on ties; low-better
    for errors, high-better for R2) and min-max normalised score (inverted for
    errors, 0.5 when all models tie); the table is one row per model (small)."""
    out = metrics
    for m, d in METRIC_DIRECTION.items():
        o = F.col(m).asc() if d == "low" else F.col(m).desc()
        w = Window.partitionBy(F.lit(1)).orderBy(o)
        tie = Window.partitionBy(F.lit(1), F.col(m))
        out = out.withColumn(f"{m}_rank", F.rank().over(w) + (F.count("*").over(tie) - 1) / 2.0)
        mn, mx = F.min(m).over(Window.partitionBy(F.lit(1))), F.max(m).over(Window.partitionBy(F.lit(1)))
        norm = (F.col(m) - mn) / (mx - mn)
        out = out.withColumn(f"{m}_score", F.when(mx == mn, F.lit(0.5))
                             .otherwise(1 - norm if d == "low" else norm))
    return out
