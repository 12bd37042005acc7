"""Daily series at scale: the dense grid is made without moving its rows, and steps on it keep them where they are."""

import datetime as dt

from pyspark.sql import functions as F

from tillsight.operators import aggregate as AG
from tillsight.operators import reports as R

D = dt.date


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def daily(spark):
    rows = [("a", D(2024, 1, 1), 2.0, 10.0), ("a", D(2024, 1, 4), 3.0, 20.0), ("b", D(2024, 1, 2), 1.0, 5.0),
            (None, D(2024, 1, 1), 4.0, 7.0), (None, D(2024, 1, 3), 4.0, 9.0), ("a", None, 9.0, 30.0)]
    return spark.createDataFrame(rows, "product_code string, sale_date date, qty double, list_price double")


def test_grid_fills_gaps_without_a_join(spark):
    g = AG.daily_grid(daily(spark))
    assert "Join" not in plan(g)
    got = sorted((r.product_code or "", r.sale_date.day, r.qty, r.list_price) for r in g.collect())
    assert got == [("", 1, 0.0, 8.0), ("", 2, 0.0, 8.0), ("", 3, 0.0, 8.0), ("a", 1, 2.0, 10.0), ("a", 2, 0.0, 20.0),
                   ("a", 3, 0.0, 20.0), ("a", 4, 3.0, 20.0), ("b", 2, 1.0, 5.0)]


def test_steps_on_the_grid_do_not_shuffle_it(spark):
    g = AG.daily_grid(daily(spark))
    moves = plan(g).count("Exchange")
    assert plan(R.month_stats(g)).count("Exchange") == moves
    assert plan(R.value_distribution(g)).count("Exchange") == moves
    assert plan(R.weekday_stats(g)).count("Exchange") == moves
    week = {(r.product_code, r.weekday): (r.n, r.total) for r in R.weekday_stats(g).collect()}
    assert len(week) == 21 and week["a", 0] == (1, 2.0) and week["a", 6] == (0, 0.0) and week[None, 0] == (0, 0.0)


def test_grid_partitions_follow_the_dense_rows(spark, monkeypatch):
    monkeypatch.setattr(AG, "GRID_ROWS", 1)
    rows = daily(spark).where(F.col("sale_date").isNotNull())
    assert AG.grid_partitions(rows, ["product_code"], "sale_date") == 8 and AG.daily_grid(rows).rdd.getNumPartitions() == 8
    far = rows.unionByName(spark.createDataFrame([("a", D(2024, 1, 20), 1.0, 1.0)], rows.schema))
    assert AG.grid_partitions(far, ["product_code"], "sale_date") == 24


def test_median_sorts_positive_rows_only(spark):
    g = AG.daily_grid(daily(spark))
    assert "> 0.0" in plan(R.daily_series_stats(g)).split("median", 1)[1]
    got = {r.product_code: r for r in R.daily_series_stats(g).collect()}
    assert (got["a"].days, got["a"].sale_days, got["a"].pos_median) == (4, 2, 2.5)
    assert got[None].days == 3 and got[None].pos_median is None


def test_forecast_fit_leaves_only_coefficients(spark):
    from tillsight.operators import forecast as FC
    rows = [(p, D(2024, 1, 1) + dt.timedelta(days=i), float(i % 7 + k), 0.0, "x") for k, p in enumerate("abc") for i in range(40)]
    df = spark.createDataFrame(rows, "product_code string, sale_date date, qty double, holiday_window double, x string").select("product_code", "sale_date", "qty")
    cal = df.select(F.col("sale_date").alias("date")).distinct().withColumn("holiday_window", F.lit(0.0))
    fits = FC.fit_series(FC.series_rows(df, cal))
    assert "FlatMapGroupsInArrow" in plan(fits) and "z" not in fits.columns     # no matrix of a series is shuffled
    assert sorted((r.product_code, r.n, len(r.beta)) for r in fits.collect()) == [(p, 40, 19) for p in "abc"]


def test_regressor_of_gap_free_rows_needs_no_order(spark):
    from tillsight.operators import patterns as PT
    rows = daily(spark).where("product_code is not null and sale_date is not null")
    same = PT.future_regressor(AG.daily_grid(rows), ["product_code"]).collect()
    got = PT.future_regressor(AG.daily_grid(rows, last="end"), ["product_code"], last="end").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, same)) and len(got) == 14


def test_outlier_cleaning_takes_many_series_in_a_call(spark):
    from tillsight.operators import ml as ML
    rows = [(f"p{i % 40}", D(2024, 1, 1) + dt.timedelta(days=i // 40), float(i * 7 % 11) if i % 13 else None) for i in range(2400)]
    df = spark.createDataFrame(rows + [(None, D(2024, 1, 1), 1.0)], "product_code string, sale_date date, qty double")
    got = ML.clean_all_series(df)
    assert "FlatMapGroups" not in plan(got)
    key = lambda r: (r[0] or "", r[1])
    want = df.repartition(1).sortWithinPartitions("sale_date").groupBy("product_code").applyInPandas(ML.lof_fn(), ML.LOF_SCHEMA)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)


def write_tables(spark, folder):
    spark.sql("""SELECT id AS l_orderkey, id % 3 AS l_partkey, IF(id = 2, NULL, id) AS l_suppkey, CAST(1 AS INT) AS l_linenumber, 2.0D AS l_quantity,
        10.0D AS l_extendedprice, 0.1D AS l_discount, 0.0D AS l_tax, IF(id % 4 = 0, 'R', 'N') AS l_returnflag, 'O' AS l_linestatus,
        CAST('2024-01-01' AS TIMESTAMP) AS l_shipdate FROM range(12)""").write.parquet(f"{folder}/lineitem.parquet")
    spark.sql("SELECT id AS o_orderkey, IF(id = 1, NULL, id) AS o_custkey, '1-URGENT' AS o_orderpriority FROM range(10)").write.parquet(f"{folder}/orders.parquet")
    spark.sql("SELECT id AS p_partkey, 'x' AS p_name, 'Brand#1' AS p_brand, CAST(id AS INT) AS p_size FROM range(2)").write.parquet(f"{folder}/part.parquet")


def test_counts_of_nulls_shuffle_no_values(spark, tmp_path):
    from tillsight.plans import profiles as PP
    folder = str(tmp_path)
    write_tables(spark, folder)
    nulls = {r.column_name: r.nulls for r in PP.q_null_counts_by_column(spark, folder).collect()}
    assert (nulls["store_code"], nulls["member_id"], nulls["channel"], nulls["product_name"], nulls["qty"]) == (1, 3, 2, 4, 0)
    got = {r.product_code: r for r in PP.q_row_filters_by_product(spark, folder).collect()}
    assert [got[p].complete_rows for p in "012"] == [4, 2, 2] and got["0"].return_qty == -2.0
    moved = [line for line in plan(PP.q_row_filters_by_product(spark, folder)).splitlines() if "Project" in line and "l_orderkey" in line]
    assert not any("cast(l_suppkey" in line and "isnotnull" not in line for line in moved)


def test_slot_grid_is_dealt_by_product_once(spark, monkeypatch):
    rows = [("0", f"p{i % 4}", D(2024, 1, 1 + i % 5), 1 + i % 6, float(i), 1.0, 2.0, 2.0, 0.0, 1.0) for i in range(40)]
    df = spark.createDataFrame(rows, "store_code string, product_code string, sale_date date, slot int, qty double, gross_amount double, "
                                     "list_price double, avg_price double, promo_share double, discount_rate double").dropDuplicates(["product_code", "sale_date", "slot"])
    monkeypatch.setattr(AG, "GRID_ROWS", 5)
    g = AG.slot_grid(df)
    assert g.count() == 4 * 5 * 6 and g.rdd.getNumPartitions() >= 24


def test_few_groups_are_sent_to_the_rows(spark):
    from tillsight.operators import quantiles as QU
    rows = spark.range(100).select((F.col("id") % 2).alias("__g"), "id")
    few = spark.createDataFrame([(0, 1.0), (1, 2.0)], "__g long, lo double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" in plan(QU.join_groups(rows, few, "__g"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert QU.join_groups(rows, few, "__g").count() == 100


def uneven_series():
    """Series of many lengths with gaps, from several first days, and one without a key."""
    import random
    rng = random.Random(7)
    rows = []
    for k, n in enumerate((5, 14, 40, 100, 186, 187, 200, 366, 420, 800, 801)):
        d0 = D(2022, 1, 1) + dt.timedelta(days=rng.randrange(200))
        at = sorted({0, n - 1, *(rng.randrange(n) for _ in range(1 + n // 9))})
        rows += [(f"p{k}", d0 + dt.timedelta(days=i), float(rng.randrange(1, 50)), round(rng.uniform(1, 9), 2), rng.randrange(3)) for i in at]
    return rows + [(None, D(2022, 1, 1), 4.0, 2.0, 1), (None, D(2022, 3, 1), 4.0, 3.0, 0), ("p1", None, 9.0, 50.0, 1)]


def near(a, b):
    return a == b or (isinstance(a, float) and abs(a - b) <= 1e-7 * max(1.0, abs(a), abs(b)))


def test_backtest_of_runs_is_that_of_the_dense_rows(spark):
    from tillsight.operators import ml as ML
    df = spark.createDataFrame([r[:3] + (1.0,) for r in uneven_series()], "product_code string, sale_date date, qty double, list_price double")
    days = [D(2022, 1, 1) + dt.timedelta(days=i) for i in range(0, 1200)]
    cal = spark.createDataFrame([(d, float(d.day < 4 and d.month % 3 == 0)) for d in days], "date date, holiday_window double")
    runs = AG.daily_grid(df, runs=True)
    got = ML.backtest_series(runs, cal)
    assert "explode" not in plan(got).lower() and "Generate" not in plan(got)
    dense = AG.daily_grid(df).join(cal.withColumnRenamed("date", "sale_date"), "sale_date", "left").fillna(0.0, ["holiday_window"])
    want = dense.groupBy("product_code").applyInPandas(ML.backtest_fn(), ML.BACKTEST_SCHEMA).collect()
    got, want = ({r.product_code: tuple(r)[1:] for r in x} for x in (got.collect(), want))
    assert got.keys() == want.keys() and len(got) == 11 and got[None][1:] == (0.0, 0.0, 1.0)
    for k in want:
        assert all(map(near, got[k], want[k])), (k, got[k], want[k])


def test_runs_are_the_grid(spark):
    rows = daily(spark)
    got = {(r.product_code, r.sale_date + dt.timedelta(days=i), r.qty if i == 0 else 0.0, r.list_price if i == 0 else r.fill_list_price)
           for r in AG.daily_grid(rows, runs=True).collect() for i in range(r.run_days)}
    assert got == {tuple(r) for r in AG.daily_grid(rows).collect()}


def test_forecast_of_runs_is_that_of_the_dense_rows(spark):
    from tillsight.operators import forecast as FC
    df = spark.createDataFrame(uneven_series(), "product_code string, sale_date date, qty double, list_price double, promo_count int")
    cal = spark.createDataFrame([(d, float(d.day < 4 and d.month % 3 == 0)) for d in (D(2022, 1, 1) + dt.timedelta(days=i) for i in range(1200))],
                                "date date, holiday_window double")
    flag = (F.col("promo_count") > 0).cast("int").alias("is_promo")
    dense, runs = (AG.daily_grid(df, last="last_date", runs=r).select("*", flag) for r in (False, True))
    kinds = (["list_price"], ["is_promo"], ["promo_count"])
    key = lambda r: (r[0] or "", r.ds)
    for make in (lambda x, r: FC.future_values(x, *kinds, last_date="last_date", runs=r),
                 lambda x, r: FC.seasonal_forecast(x, cal, *kinds, last_date="last_date", runs=r)):
        want, got = (sorted(make(x, r).collect(), key=key) for x, r in ((dense, False), (runs, True)))
        assert len(want) == len(got) >= 70
        for a, b in zip(want, got):
            assert all(map(near, a, b)), (a, b)


def test_sums_of_runs_are_those_of_the_dense_rows(spark):
    import numpy as np
    from tillsight.operators import forecast as FC
    from tillsight.operators import gram as GM
    from tillsight.plans.models import _three
    df = spark.createDataFrame([r[:4] for r in uneven_series()], "product_code string, sale_date date, qty double, list_price double")
    cal = spark.createDataFrame([(d, float(d.day < 4)) for d in (D(2022, 1, 1) + dt.timedelta(days=i) for i in range(1200))], "date date, holiday_window double")
    got = FC.run_sums(AG.daily_grid(df, runs=True), cal)
    assert "Generate" not in plan(got)
    rows = FC.series_rows(AG.daily_grid(df), cal).withColumn("years", F.col("__t") / 365.25)
    want = {r.product_code: r.z for r in GM.gram(rows, ["product_code"], ["years", "holiday_window"], _three, "qty").collect()}
    got = {r.product_code: r.z for r in got.collect()}
    assert got.keys() == want.keys() and len(got) == 10
    for k in want:
        np.testing.assert_allclose(got[k], want[k], rtol=1e-9, atol=1e-9)


def test_centred_means_of_runs_are_those_of_the_dense_rows(spark):
    from pyspark.sql import Window
    from tillsight.operators import features as FT
    df = spark.createDataFrame([r[:4] for r in uneven_series()], "product_code string, sale_date date, qty double, list_price double")
    keys, order = ["product_code"], ["sale_date"]
    got = FT.centred_over_runs(FT.cumulative(AG.daily_grid(df, runs=True), keys, order), keys, order)
    g = AG.daily_grid(df).withColumn("n", F.count("*").over(Window.partitionBy(*keys)))
    for k in range(2, 8):
        g = FT.centred_moving_average(g, keys, order, window=k, out=f"c{k}")
    w = F.least(F.lit(7), F.floor(F.col("n") / 4))
    g = FT.cumulative(g.withColumn("qty_cma", F.coalesce(*[F.when(w == k, F.col(f"c{k}")) for k in range(2, 8)])), keys, order)
    cols = ["product_code", "sale_date", "qty", "qty_cma", "qty_cum"]
    key = lambda r: (r[0] or "", r[1])
    a, b = (sorted(x.select(*cols).collect(), key=key) for x in (got, g))
    assert len(a) == len(b) > 3000
    for x, y in zip(a, b):
        assert all(map(near, x, y)), (x, y)
    tree = plan(got)
    assert tree.index("Generate") < tree.index("Window")        # dense rows are made after the last sort
