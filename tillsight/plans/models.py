"""Evaluation queries (E1-E9, V6, J7, J8, T5, T7, W11-W13) and model queries.

Evaluation reports are checked on deterministic moving-average forecasts of
the daily product series (so DuckDB can reproduce them); MLlib fits are
rows-only queries in ``ml_queries``.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evaluate as EV
from .registry import REGISTRY, register
from .sales import DAILY_SQL, daily_product_sales
from .sqlparts import dates_cte, out_cols, out_sql, r, tx_cte, with_

NAIVE = {"last_value": (1, 1), "ma7": (7, 1), "ma14": (14, 1), "ma30": (30, 1)}
W = "PARTITION BY product_code ORDER BY sale_date"


def naive_predictions(spark, d):
    """Moving-average forecasts of the daily product series: prediction for a day =
    mean of the previous n days' rows (rows with no history are dropped)."""
    daily = daily_product_sales(spark, d).select("product_code", "sale_date", F.col("qty").alias("actual"))
    w = Window.partitionBy("product_code").orderBy("sale_date")
    wide = daily.select("*", *(F.avg("actual").over(w.rowsBetween(-n, -1)).alias(name) for name, (n, _) in NAIVE.items()))
    long = wide.unpivot(["product_code", "sale_date", "actual"], list(NAIVE), "model", "predicted")
    return long.where(F.col("predicted").isNotNull())


NAIVE_SQL = "pred AS (" + " UNION ALL ".join(
    f"SELECT * FROM (SELECT '{m}' AS model, product_code, sale_date, qty AS actual, "
    f"avg(qty) OVER ({W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) AS predicted FROM daily) WHERE predicted IS NOT NULL"
    for m, (n, _) in NAIVE.items()) + ")"
ERR_SQL = """errs AS (SELECT *, actual - predicted AS error, abs(actual - predicted) AS abs_error,
                 (actual - predicted) / CASE WHEN actual <> 0 THEN actual ELSE 1.0 END * 100 AS rel_error_pct,
                 least(greatest((actual - predicted) / CASE WHEN actual <> 0 THEN actual ELSE 1.0 END * 100, -100.0), 100.0)
                   AS rel_error_clipped FROM pred)"""
BASE = [tx_cte(), DAILY_SQL, NAIVE_SQL, ERR_SQL]


def errors(spark, d, model=None):
    p = naive_predictions(spark, d)
    if model:
        p = p.where(F.col("model") == model)
    return EV.row_errors(p)


ROW_SPEC = ("model:s product_code:s sale_date:d actual:f predicted:f error:f abs_error:f rel_error_pct:f "
            "rel_error_clipped:f key_mean_actual:f key_mean_predicted:f")


@register("forecast_error_rows", "E3 J8", sql=with_(*BASE) + f"""
SELECT {out_sql(ROW_SPEC)} FROM (
  SELECT e.*, m.key_mean_actual, m.key_mean_predicted FROM errs e
  JOIN (SELECT model, product_code, avg(actual) AS key_mean_actual, avg(predicted) AS key_mean_predicted
        FROM errs GROUP BY ALL) m ON m.model = e.model AND m.product_code = e.product_code)
""")
def q_forecast_error_rows(spark, d):
    return EV.with_key_means(errors(spark, d), ["model", "product_code"]).select(*out_cols(ROW_SPEC))


MET_SPEC = "n:l mse:f mae:f rmse:f r2:f mape:f mape_nonzero:f smape:f rating:s quality_warning:s"


def metrics_sql(keys: str) -> str:
    return f"""SELECT {out_sql(keys + ' ' + MET_SPEC)} FROM (
  SELECT *, CASE WHEN r2 > 0.8 THEN 'excellent' WHEN r2 > 0.6 THEN 'good' WHEN r2 > 0 THEN 'needs_improvement'
                 ELSE 'negative_r2' END AS rating,
            CASE WHEN n < 10 THEN 'too_few_samples' WHEN close THEN 'identical_predictions' WHEN r2 < 0 THEN 'negative_r2'
                 WHEN r2 < 0.3 THEN 'low_r2' END AS quality_warning
  FROM (
    SELECT {keys.replace(':s', '').replace(' ', ', ')}, count(*) AS n, avg((actual - predicted) * (actual - predicted)) AS mse,
           avg(abs(actual - predicted)) AS mae, sqrt(avg((actual - predicted) * (actual - predicted))) AS rmse,
           CASE WHEN var_pop(actual) > 0 THEN 1 - sum((actual - predicted) * (actual - predicted)) / (var_pop(actual) * count(*)) END AS r2,
           avg(abs((actual - predicted) / CASE WHEN actual <> 0 THEN actual ELSE 1.0 END)) * 100 AS mape,
           coalesce(avg(abs((actual - predicted) / actual)) FILTER (WHERE actual <> 0) * 100, 0.0) AS mape_nonzero,
           coalesce(avg(abs(predicted - actual) / (abs(actual) + abs(predicted))) FILTER (WHERE abs(actual) + abs(predicted) <> 0) * 200, 0.0) AS smape,
           bool_and(abs(actual - predicted) <= 1e-8 + 1e-5 * abs(predicted)) AS close
    FROM pred GROUP BY ALL))"""


@register("forecast_metrics_by_model", "E1 E2 E9 V6", sql=with_(*BASE) + metrics_sql("model:s"))
def q_forecast_metrics_by_model(spark, d):
    return EV.regression_metrics(naive_predictions(spark, d), ["model"]).select(*out_cols("model:s " + MET_SPEC))


@register("forecast_metrics_by_product", "E1 E2 V6", sql=with_(*BASE) + metrics_sql("model:s product_code:s"))
def q_forecast_metrics_by_product(spark, d):
    return EV.regression_metrics(naive_predictions(spark, d), ["model", "product_code"]) \
             .select(*out_cols("model:s product_code:s " + MET_SPEC))


BAND_SPEC = ("model:s within_10:f within_20:f within_30:f over_prediction:f under_prediction:f perfect:f "
             "band_10_20:f band_20_50:f band_over_50:f")


@register("accuracy_bands", "E4 E5", sql=with_(*BASE) + f"""
SELECT {out_sql(BAND_SPEC)} FROM (
  SELECT model, {", ".join(f"avg(CAST({c} AS DOUBLE)) * 100 AS {n}" for n, c in [
      ("within_10", "abs(rel_error_pct) <= 10"), ("within_20", "abs(rel_error_pct) <= 20"),
      ("within_30", "abs(rel_error_pct) <= 30"), ("over_prediction", "error < 0"), ("under_prediction", "error > 0"),
      ("perfect", "error = 0"), ("band_10_20", "abs(rel_error_pct) > 10 AND abs(rel_error_pct) <= 20"),
      ("band_20_50", "abs(rel_error_pct) > 20 AND abs(rel_error_pct) <= 50"), ("band_over_50", "abs(rel_error_pct) > 50")])}
  FROM errs GROUP BY model)
""")
def q_accuracy_bands(spark, d):
    return EV.accuracy_bands(errors(spark, d), ["model"]).select(*out_cols(BAND_SPEC))


ACC_SPEC = "model:s product_code:s samples:l mean_actual:f mean_predicted:f mae:f mean_rel_error:f accuracy:f"
ACC_SQL = """acc AS (SELECT model, product_code, count(*) AS samples, avg(actual) AS mean_actual, avg(predicted) AS mean_predicted,
                avg(abs_error) AS mae, avg(abs(rel_error_pct)) AS mean_rel_error,
                least(greatest(1 - avg(abs_error) / CASE WHEN avg(actual) > 0 THEN avg(actual) ELSE 1.0 END, 0.0), 1.0) AS accuracy
         FROM errs GROUP BY ALL)"""


@register("product_accuracy", "E6", sql=with_(*BASE, ACC_SQL) + f"SELECT {out_sql(ACC_SPEC)} FROM acc")
def q_product_accuracy(spark, d):
    return EV.key_accuracy(errors(spark, d), ["model", "product_code"]).select(*out_cols(ACC_SPEC))


@register("most_accurate_products", "T5 E6", sql=with_(*BASE, ACC_SQL) + f"""
SELECT {out_sql(ACC_SPEC)} FROM (
  SELECT * FROM (SELECT * FROM acc WHERE model = 'ma7' AND samples >= 5 ORDER BY samples DESC, product_code LIMIT 10)
  ORDER BY accuracy DESC, product_code LIMIT 3)
""")
def q_most_accurate_products(spark, d):
    acc = EV.key_accuracy(errors(spark, d, "ma7"), ["model", "product_code"])
    return EV.best_keys(acc).select(*out_cols(ACC_SPEC))


LEVEL_SPEC = "model:s level:i mean_actual:f mean_predicted:f mean_error:f"


@register("sales_level_bins", "E7", sql=with_(*BASE) + f"""
, st AS (SELECT model, quantile_cont(actual, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS q, min(actual) AS lo, max(actual) AS hi,
                count(DISTINCT actual) AS nd FROM errs GROUP BY model),
j AS (SELECT e.*, st.q, st.lo, st.hi, st.nd FROM errs e JOIN st USING (model)),
b AS (SELECT *, CAST(CASE WHEN len(list_distinct(q)) = 6 THEN len(list_filter(q[2:5], lambda x: x < actual))
                     WHEN nd >= 5 THEN CASE WHEN actual > lo THEN least(ceil((actual - lo) / ((hi - lo) / 5)) - 1, 4) END
                     WHEN nd >= 2 THEN least(ceil((actual - (lo - 0.1)) / ((hi + 0.1 - (lo - 0.1)) / nd)) - 1, nd - 1)
                END AS INT) AS level FROM j),
g AS (SELECT model, level, avg(actual) AS mean_actual, avg(predicted) AS mean_predicted, avg(error) AS mean_error
      FROM b WHERE level IS NOT NULL GROUP BY ALL)
SELECT {out_sql(LEVEL_SPEC)} FROM g WHERE model IN (SELECT model FROM g GROUP BY model HAVING count(*) > 1)
""")
def q_sales_level_bins(spark, d):
    return EV.level_bins(errors(spark, d), ["model"]).select(*out_cols(LEVEL_SPEC))


HIST_SPEC = "model:s bin:i count:l"


@register("error_histogram", "E8", sql=with_(*BASE) + f"""
, st AS (SELECT model, CASE WHEN max(error) = min(error) THEN min(error) - 0.5 ELSE min(error) END AS lo,
                (CASE WHEN max(error) = min(error) THEN max(error) + 0.5 ELSE max(error) END
                 - CASE WHEN max(error) = min(error) THEN min(error) - 0.5 ELSE min(error) END) / 30 AS w
         FROM errs GROUP BY model)
SELECT {out_sql(HIST_SPEC)} FROM (
  SELECT e.model, least(floor((error - lo) / w), 29) AS bin, count(*) AS count FROM errs e JOIN st USING (model) GROUP BY ALL)
""")
def q_error_histogram(spark, d):
    return EV.error_histogram(errors(spark, d), ["model"]).select(*out_cols(HIST_SPEC))


CUM_SPEC = "model:s product_code:s sale_date:d abs_error:f cum_share:f"


@register("cumulative_accuracy_curve", "W13", sql=with_(*BASE) + f"""
SELECT {out_sql(CUM_SPEC)} FROM (
  SELECT model, product_code, sale_date, abs_error,
         row_number() OVER (PARTITION BY model, product_code ORDER BY abs_error, sale_date)
           / count(*) OVER (PARTITION BY model, product_code) AS cum_share FROM errs)
""")
def q_cumulative_accuracy_curve(spark, d):
    return EV.cumulative_accuracy(errors(spark, d), ["model", "product_code"]).select(*out_cols(CUM_SPEC))


RANK_SPEC = "model:s rmse:f mae:f mape:f r2:f " + " ".join(f"{m}_rank:f {m}_score:f" for m in EV.METRIC_DIRECTION)


@register("model_comparison", "T7 W11 W12 M9", sql=with_(*BASE) + f"""
, m AS (SELECT model, sqrt(avg((actual - predicted) * (actual - predicted))) AS rmse, avg(abs(actual - predicted)) AS mae,
               avg(abs((actual - predicted) / CASE WHEN actual <> 0 THEN actual ELSE 1.0 END)) * 100 AS mape,
               CASE WHEN var_pop(actual) > 0 THEN 1 - sum((actual - predicted) * (actual - predicted)) / (var_pop(actual) * count(*)) END AS r2
        FROM pred GROUP BY model)
SELECT {out_sql(RANK_SPEC)} FROM (
  SELECT *, {", ".join(
      f"rank() OVER (ORDER BY {mm} {'ASC' if dd == 'low' else 'DESC'}) + (count(*) OVER (PARTITION BY {mm}) - 1) / 2.0 AS {mm}_rank, "
      f"CASE WHEN max({mm}) OVER () = min({mm}) OVER () THEN 0.5 ELSE "
      + (f"1 - ({mm} - min({mm}) OVER ()) / (max({mm}) OVER () - min({mm}) OVER ())" if dd == 'low'
         else f"({mm} - min({mm}) OVER ()) / (max({mm}) OVER () - min({mm}) OVER ())") + f" END AS {mm}_score"
      for mm, dd in EV.METRIC_DIRECTION.items())}
  FROM m)
""")
def q_model_comparison(spark, d):
    m = EV.regression_metrics(naive_predictions(spark, d), ["model"]).select("model", "rmse", "mae", "mape", "r2")
    return EV.rank_models(m).select(*out_cols(RANK_SPEC))


SAMPLE_SPEC = "product_code:s sale_date:d actual:f predicted:f"


@register("nearest_date_sample", "J7", sql=with_(*BASE) + f"""
, e AS (SELECT * FROM pred WHERE model = 'ma7'),
st AS (SELECT product_code, min(sale_date) AS d0, max(sale_date) AS d1, count(*) AS n FROM e GROUP BY product_code),
tg AS (SELECT product_code, d0, date_diff('day', d0, d1) * i AS t FROM st, range(100) r(i) WHERE n > 100),
pick AS (SELECT DISTINCT tg.product_code,
           (SELECT e2.sale_date FROM e e2 WHERE e2.product_code = tg.product_code
            ORDER BY abs(date_diff('day', tg.d0, e2.sale_date) * 99 - tg.t), e2.sale_date LIMIT 1) AS sale_date FROM tg)
SELECT {out_sql(SAMPLE_SPEC)} FROM (
  SELECT e.* FROM e JOIN st USING (product_code) WHERE st.n <= 100
  UNION ALL SELECT e.* FROM e JOIN pick ON pick.product_code = e.product_code AND pick.sale_date = e.sale_date)
""")
def q_nearest_date_sample(spark, d):
    p = naive_predictions(spark, d).where(F.col("model") == "ma7").drop("model")
    return EV.nearest_date_sample(p, ["product_code"]).select(*out_cols(SAMPLE_SPEC))


__all__ = ["naive_predictions", "r"]


# ---- model preparation (SQL-checked) and fits (rows-only) ---------------------------------------

from ..operators import forecast as FC  # noqa: E402
from ..operators import gram as GM  # noqa: E402
from ..operators import ml as ML  # noqa: E402
from ..session import compiled_methods, cut_lineage, cut_to_table, discard, run_folder  # noqa: E402
from ..sources.dims import holiday_days, holiday_sql  # noqa: E402
from .features import FEATURE_SQL, daily_features  # noqa: E402
from .reports import DENSE_SQL  # noqa: E402

PREP_NUM = ["qty_lag1", "qty_mean7", "discount_rate"]
PREP_SPEC = ("product_code:s sale_date:d season_idx:i temp_band_idx:i qty_lag1:f qty_mean7:f discount_rate:f "
             "position:l n_rows:l is_train:i block:i")


def training_matrix(spark, d):
    """M1 + M2 + M3 + M4 on the daily feature table."""
    f = daily_features(spark, d).select("product_code", "sale_date", "qty", "season", "temp_band", *PREP_NUM)
    f, _ = ML.label_encode(f, ["season", "temp_band"])
    f = ML.clip_standardize(f, PREP_NUM)
    f = ML.fold_blocks(ML.time_split(ML.time_positions(f)))
    return f


_FEAT_BODY = FEATURE_SQL[:FEATURE_SQL.rindex("SELECT ")]


@register("training_matrix_prep", "M1 M2 M3 M4 P33 P34", sql=_FEAT_BODY + f"""
, base AS (SELECT product_code, sale_date, qty, season, temp_band, {", ".join(f"coalesce(CASE WHEN isnan(CAST({c} AS DOUBLE)) OR isinf(CAST({c} AS DOUBLE)) THEN NULL ELSE CAST({c} AS DOUBLE) END, 0.0) AS {c}" for c in PREP_NUM)} FROM f2),
q AS (SELECT {", ".join(f"quantile_cont({c}, 0.01) AS lo_{c}, quantile_cont({c}, 0.99) AS hi_{c}" for c in PREP_NUM)} FROM base),
cl AS (SELECT base.* REPLACE ({", ".join(f"least(greatest({c}, lo_{c}), hi_{c}) AS {c}" for c in PREP_NUM)}) FROM base, q),
st AS (SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in PREP_NUM)} FROM cl),
sc AS (SELECT cl.* REPLACE ({", ".join(f"({c} - m_{c}) / CASE WHEN s_{c} > 0 THEN s_{c} ELSE 1.0 END AS {c}" for c in PREP_NUM)}) FROM cl, st),
enc AS (SELECT sc.*, dense_rank() OVER (ORDER BY season) - 1 AS season_idx, dense_rank() OVER (ORDER BY temp_band) - 1 AS temp_band_idx,
               row_number() OVER (ORDER BY sale_date, product_code) AS position, count(*) OVER () AS n_rows FROM sc)
SELECT {out_sql(PREP_SPEC)} FROM (
  SELECT *, CAST(position <= floor(n_rows * 0.8) AS INT) AS is_train,
         CAST(floor((position - 1) / greatest(floor(n_rows / 5), 1)) AS INT) AS block FROM enc)
""")
def q_training_matrix_prep(spark, d):
    return training_matrix(spark, d).select(*out_cols(PREP_SPEC))


FOLD_SPEC = "fold:i train_rows:l valid_rows:l train_mean:f valid_mean:f first_day:d last_day:d"
_PREP_BODY = REGISTRY["training_matrix_prep"].sql
_PREP_BODY = _PREP_BODY[:_PREP_BODY.rindex("SELECT " + out_sql(PREP_SPEC))]


@register("rejoined_search_folds", "U2 M3 M4", sql=_PREP_BODY + f"""
, train AS (SELECT * FROM enc WHERE position <= floor(n_rows * 0.8)), test AS (SELECT * FROM enc WHERE position > floor(n_rows * 0.8)),
al AS (SELECT *, CAST(floor((position - 1) / greatest(floor(n_rows / 5), 1)) AS INT) AS block FROM (SELECT * FROM train UNION ALL SELECT * FROM test)),
fd AS (SELECT unnest(range(0, 4)) AS fold)
SELECT {out_sql(FOLD_SPEC)} FROM (
  SELECT fold, count(*) FILTER (WHERE block <= fold) AS train_rows, count(*) FILTER (WHERE block = fold + 1) AS valid_rows,
         avg(qty) FILTER (WHERE block <= fold) AS train_mean, avg(qty) FILTER (WHERE block = fold + 1) AS valid_mean,
         min(sale_date) FILTER (WHERE block = fold + 1) AS first_day, max(sale_date) FILTER (WHERE block = fold + 1) AS last_day
  FROM al, fd GROUP BY fold)
""")
def q_rejoined_search_folds(spark, d):
    """The search's input: the parts of the time split united again, and the folds over all of it."""
    m = cut_lineage(training_matrix(spark, d))
    both = ML.rejoin(m.where("is_train = 1"), m.where("is_train = 0"))
    return ML.fold_sizes(both, "qty").select(*out_cols(FOLD_SPEC))


def positioned_features(spark, d):
    """Keys, label and P34 features of the daily feature table, split in time order (M3), and the numeric and categorical
    features' names. Rows are put in order as they are and stored so; what is made of them later is not sampled and
    shuffled for it."""
    f = daily_features(spark, d)
    num, cat = ML.feature_columns(f, exclude=["product_code", "sale_date"])
    # stored once before: the ranges' sample reads it too
    with compiled_methods(spark):
        f = cut_to_table(f.select("product_code", "sale_date", "qty", *num, *cat), "features")
        placed = []
        out = ML.time_split(ML.time_positions(f, keep=lambda x: placed.append(cut_to_table(x, "positions")) or placed[0]))
        discard(f)
        out.__dict__["_stored_at"] = placed[0].__dict__["_stored_at"]
        return out, num, cat


def model_matrix(spark, d):
    """Assembled matrix for the fits: every P34 feature of the daily feature table
    (categoricals label-encoded), label = daily quantity."""
    f, num, cat = positioned_features(spark, d)
    cols = num + [f"{c}_idx" for c in cat]
    with compiled_methods(spark):
        rows, _ = ML.label_encode(f, cat)
        rows = ML.fold_blocks(ML.clip_standardize(rows, num, exact=False))
        # one materialisation in the shared checkpoint folder, as columns; every fit and score reads it
        m = cut_to_table(rows.select("product_code", "sale_date", "qty", *cols, "is_train", "block"), "matrix")
        discard(f)
        return ML.assemble(m, cols, "qty").select("product_code", "sale_date", "features", "label", "is_train", "block"), cols


@register("model_training_metrics", "M5 M6 M7 M8 M9 E1 T7 P35")
def q_model_training_metrics(spark, d):
    """Fit linear / ridge / lasso / forest / boosting on the first 80 % (time order),
    evaluate on the rest; one metrics row per model, best (lowest RMSE) flagged."""
    m, _ = model_matrix(spark, d)
    metrics, _ = ML.train_models(m.where("is_train = 1"), m.where("is_train = 0"))
    best = F.min_by("model", "rmse").over(Window.partitionBy(F.lit(1)))
    return metrics.withColumn("is_best", (F.col("model") == best).cast("int"))


@register("ensemble_predictions", "M10 M11 U2")
def q_ensemble_predictions(spark, d):
    """Every model's prediction and the floored mean ensemble for the test rows."""
    m, _ = model_matrix(spark, d)
    _, models = ML.train_models(m.where("is_train = 1"), m.where("is_train = 0"),
                                names=["linear_regression", "ridge", "gbt"])
    return ML.ensemble_predict(models, m.where("is_train = 0"), ["product_code", "sale_date"])


@register("feature_importance_top10", "T6 M8")
def q_feature_importance_top10(spark, d):
    m, cols = model_matrix(spark, d)
    model = ML.model_specs()["gbt"].fit(m.where("is_train = 1"))
    return ML.feature_importance(model, cols, spark)


@register("hyperparameter_search", "M12 M4 S12")
def q_hyperparameter_search(spark, d):
    """All model kinds with their whole grids over the expanding folds: ridge and lasso from one pass of sums by block,
    forest and boosting by fits on the stored matrix; best trial of each kind and over all. Results are a table in a
    folder of this run (S12), read back."""
    m, _ = model_matrix(spark, d)
    res = ML.search_models(m.select("features", "label", "block"))
    path = run_folder(spark, "tuning") + "/tuning_results"
    res.write.parquet(path)
    return spark.read.parquet(path)


@register("model_persistence", "S11 M11")
def q_model_persistence(spark, d):
    """Fit encoder + assembler + boosting as one pipeline, save it under the shared
    checkpoint folder, load it back and score the test rows with the loaded model."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    f, num, cat = positioned_features(spark, d)
    f = f.fillna(0.0, subset=num).fillna("", subset=cat)
    stages = ML.encoders(cat)
    stages.append(VectorAssembler(inputCols=num + [f"{c}_idx" for c in cat], outputCol="features", handleInvalid="keep"))
    stages.append(ML.model_specs(label="qty")["gbt"].setMaxIter(20))
    with compiled_methods(spark):
        model = Pipeline(stages=stages).fit(f.where("is_train = 1").withColumn("qty", F.col("qty").cast("double")))
    path = run_folder(spark, "model") + "/best_model"
    ML.save_pipeline(model, path)
    loaded = ML.load_pipeline(path)
    return loaded.transform(f.where("is_train = 0")).select("product_code", "sale_date", "qty", "prediction")


def runs_with_holidays(spark, d):
    """Dense daily product series as runs, and (date, holiday_window): a +-2 day legal-holiday window flag."""
    from ..sources.dims import calendar_years_from
    from .calendar import year_range_dates
    from .reports import dense_daily
    cal = calendar_years_from(year_range_dates(spark, d)).select(F.col("ds").alias("sale_date"), "holiday_legal")
    w = Window.orderBy("sale_date").rowsBetween(-2, 2)   # calendar: one row per day
    cal = cal.select(F.col("sale_date").alias("date"), F.max("holiday_legal").over(w).cast("double").alias("holiday_window"))
    return dense_daily(spark, d, runs=True).select("product_code", "sale_date", "qty", "run_days"), cal


def forecast_inputs(spark, d):
    """Gap-free daily product series as runs (dense rows are many times the days that sold) with their regressors, and
    the holiday windows of their years and the horizon."""
    from .calendar import fact_dates
    from .reports import dense_daily
    daily = dense_daily(spark, d, last="last_date", runs=True).select(
        "product_code", "sale_date", "qty", "list_price", "promo_count", (F.col("promo_count") > 0).cast("int").alias("is_promo"),
        "run_days", "fill_list_price", "last_date")
    span = fact_dates(spark, d).agg(F.min("date").alias("a"), F.max("date").alias("b"))
    days = span.select(F.explode(F.sequence(F.col("a"), F.date_add("b", FC.HORIZON))).alias("date"))
    return daily, FC.holiday_window(days, holiday_days(days))


@register("seasonal_forecast", "M13 M14 A41")
def q_seasonal_forecast(spark, d):
    """Next 7 days per product with a 95 % interval: trend, waves, holiday window of the day, price, promotion and
    the last promotion count, fitted from sums of products per series."""
    daily, cal = forecast_inputs(spark, d)
    return FC.seasonal_forecast(daily, cal, numbers=["list_price"], flags=["is_promo"], last=["promo_count"], last_date="last_date", runs=True)


FUTURE_SPEC = "product_code:s ds:d list_price:f is_promo:f promo_count:f"


@register("future_regressor_values", "M14", sql=with_(tx_cte(), DAILY_SQL, DENSE_SQL) + f"""
, d AS (SELECT product_code, sale_date, list_price, promo_count, CAST(promo_count > 0 AS INT) AS is_promo FROM dense),
dr AS (SELECT *, row_number() OVER (PARTITION BY product_code ORDER BY sale_date DESC) AS rn FROM d),
fb AS (SELECT product_code, avg(list_price) FILTER (WHERE rn <= 7) AS recent_avg, count(*) AS n, max(sale_date) AS last,
              avg(is_promo) AS rate, arg_max(promo_count, sale_date) AS last_count FROM dr GROUP BY ALL),
wd AS (SELECT product_code, isodow(sale_date) - 1 AS weekday, avg(list_price) AS wm FROM d GROUP BY ALL),
pat AS (SELECT product_code, stddev_samp(wm) AS ws, avg(wm) AS wa FROM wd GROUP BY ALL),
fut AS (SELECT b.*, n >= 14 AND ws > wa * 0.3 AS use_wd,
               CAST(unnest(generate_series(CAST(last + 1 AS DATE), CAST(last + 7 AS DATE), INTERVAL 1 DAY)) AS DATE) AS ds
        FROM fb b LEFT JOIN pat ON pat.product_code = b.product_code)
SELECT {out_sql(FUTURE_SPEC)} FROM (
  SELECT fut.product_code, ds,
         coalesce(CASE WHEN use_wd THEN coalesce(wd.wm, recent_avg) ELSE recent_avg END, 0.0) AS list_price,
         CASE WHEN CAST('0x' || substr(md5(fut.product_code || '|' || CAST(ds AS VARCHAR) || '|is_promo'), 1, 7) AS BIGINT) / 268435456.0 < rate
              THEN 1.0 ELSE 0.0 END AS is_promo, CAST(last_count AS DOUBLE) AS promo_count
  FROM fut LEFT JOIN wd ON wd.product_code = fut.product_code AND wd.weekday = isodow(fut.ds) - 1)
""")
def q_future_regressor_values(spark, d):
    """Regressors of the horizon by kind: numbers, flags, last values."""
    daily, _ = forecast_inputs(spark, d)
    return FC.future_values(daily, ["list_price"], ["is_promo"], ["promo_count"], last_date="last_date", runs=True).select(*out_cols(FUTURE_SPEC))


def _three(c):
    """The constant and two columns as a design matrix."""
    import numpy as np
    x1, x2 = (c[k].astype(float) for k in c)
    return np.column_stack([np.ones(len(x1)), x1, x2])


def _cramer(sums: str, keys: str, ridge: float) -> str:
    """Coefficients of [1, x1, x2] on y with ``ridge`` on the squares of the last two, from a relation of sums
    (n, s1, s2, s11, s12, s22, sy, s1y, s2y), by determinants."""
    a = [["n", "s1", "s2"], ["s1", f"(s11 + {ridge})", "s12"], ["s2", "s12", f"(s22 + {ridge})"]]
    y = ["sy", "s1y", "s2y"]

    def det(m):
        (p, q, r), (u, v, w), (x, z, k) = m
        return f"({p} * ({v} * {k} - {w} * {z}) - {q} * ({u} * {k} - {w} * {x}) + {r} * ({u} * {z} - {v} * {x}))"
    cols = [f"{det([[y[i] if j == c else a[i][j] for j in range(3)] for i in range(3)])} / {det(a)} AS b{c}" for c in range(3)]
    return f"SELECT {keys}n, {', '.join(cols)} FROM {sums}"


_SUMS = ("count(*) AS n, sum(x1) AS s1, sum(x2) AS s2, sum(x1 * x1) AS s11, sum(x1 * x2) AS s12, sum(x2 * x2) AS s22, "
         "sum(y) AS sy, sum(x1 * y) AS s1y, sum(x2 * y) AS s2y")
COEF_SPEC = "product_code:s n:l b0:f b1:f b2:f"


@register("series_coefficients", "M13", sql=with_(tx_cte(), DAILY_SQL, DENSE_SQL, dates_cte(), holiday_sql("dates").strip()) + f"""
, hw AS (SELECT DISTINCT CAST(date + CAST(off AS INTEGER) AS DATE) AS date FROM legal, (VALUES (-2), (-1), (0), (1), (2)) o(off)),
r AS (SELECT dense.product_code, date_diff('day', min(sale_date) OVER (PARTITION BY dense.product_code), sale_date) / 365.25 AS x1,
             CASE WHEN hw.date IS NOT NULL THEN 1.0 ELSE 0.0 END AS x2, qty AS y, count(*) OVER (PARTITION BY dense.product_code) AS days
      FROM dense LEFT JOIN hw ON hw.date = dense.sale_date),
sums AS (SELECT product_code, {_SUMS} FROM r WHERE days >= 14 GROUP BY product_code)
SELECT {out_sql(COEF_SPEC)} FROM ({_cramer("sums", "product_code, ", 1.0)})
""")
def q_series_coefficients(spark, d):
    """Trend and holiday coefficients of each daily series, from sums of products."""
    daily, cal = forecast_inputs(spark, d)
    fits = GM.solve(FC.run_sums(daily, cal), ["product_code"], _ridge_on_terms(1.0))
    return fits.select("product_code", "n", *[F.col("beta")[i].alias(f"b{i}") for i in range(3)]).select(*out_cols(COEF_SPEC))


def _ridge_on_terms(ridge):
    def penalty(xtx, n):
        import numpy as np
        return np.r_[0.0, np.full(len(xtx) - 1, ridge)]
    return penalty


FIT_SPEC = "model:s n:l b0:f b1:f b2:f"


@register("linear_fit_coefficients", "M5 M6", sql=_FEAT_BODY + f"""
, r AS (SELECT qty AS y, coalesce(discount_rate, 0.0) AS x1, coalesce(qty_mean7, 0.0) / 10 AS x2 FROM f2),
sums AS (SELECT {_SUMS} FROM r)
SELECT {out_sql(FIT_SPEC)} FROM (
  SELECT 'linear_regression' AS model, * FROM ({_cramer("sums", "", 0.0)})
  UNION ALL SELECT 'ridge', * FROM ({_cramer("sums", "", 1000.0)}))
""")
def q_linear_fit_coefficients(spark, d):
    """Least squares and ridge of the daily quantity on discount rate and 7-row mean, from one pass of sums."""
    rows = daily_features(spark, d).select(F.lit(0).alias("all"), "qty", F.coalesce("discount_rate", F.lit(0.0)).alias("x1"),
                                           (F.coalesce("qty_mean7", F.lit(0.0)) / 10).alias("x2"))
    sums = GM.gram(rows, ["all"], ["x1", "x2"], _three, "qty")
    fits = [GM.solve(sums, ["all"], _ridge_on_terms(r)).withColumn("model", F.lit(n)) for n, r in (("linear_regression", 0.0), ("ridge", 1000.0))]
    both = fits[0].unionByName(fits[1])
    return both.select("model", "n", *[F.col("beta")[i].alias(f"b{i}") for i in range(3)]).select(*out_cols(FIT_SPEC))


@register("seasonal_backtest", "M15 E1")
def q_seasonal_backtest(spark, d):
    """Rolling-origin backtest per product (initial 180 d, period 15 d, horizon 7 d)."""
    return ML.backtest_series(*runs_with_holidays(spark, d))


@register("lof_outlier_cleaning", "M17")
def q_lof_outlier_cleaning(spark, d):
    """Daily quantities per product with LOF score, outlier flag, median-filled and z-scored value."""
    daily = daily_product_sales(spark, d).select("product_code", "sale_date", "qty")
    return ML.clean_all_series(ML.per_series(daily))
