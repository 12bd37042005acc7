"""Preparation of the training matrix: few passes over the rows, nothing computed again on reading."""
import numpy as np
from pyspark.sql import functions as F

from tillsight.operators import ml as ML
from tillsight.session import compiled_methods


def test_clip_standardize_is_a_projection(spark):
    rows = [(float(i), None if i % 7 == 0 else float(i % 50), 3.0) for i in range(2000)] + [(float("nan"), float("inf"), 3.0), (None, -float("inf"), 3.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    out = ML.clip_standardize(df, ["a", "b", "c"], exact=False)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = out.toPandas()
    for i, c in enumerate("abc"):
        x = np.array([r[i] if r[i] is not None and np.isfinite(r[i]) else 0.0 for r in rows])
        lo, hi = np.quantile(x, [0.01, 0.99], method="inverted_cdf")
        x = np.clip(x, lo, hi)
        np.testing.assert_allclose(got[c], (x - x.mean()) / (x.std() or 1.0), atol=1e-9)
    assert ML.clip_standardize(df.limit(0), ["a", "b"], exact=False).count() == 0


def test_labels_of_all_columns_are_one_fit(spark):
    df = spark.createDataFrame([("b", "x"), ("a", None), (None, "w"), ("b", "w")], "p string, q string")
    out, model = ML.label_encode(df, ["p", "q"])
    assert len(model.stages) == 1
    assert [(r.p_idx, r.q_idx) for r in out.collect()] == [(1, 1), (0, 2), (2, 0), (1, 0)]
    assert ML.label_encode(df, [])[0].columns == df.columns


def test_compiled_methods_leaves_the_session_as_it_was(spark):
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    df = spark.range(10).select(*[(F.col("id") * i).alias(f"c{i}") for i in range(5)])
    with compiled_methods(spark):
        assert spark.conf.get(name) == "8000" and df.count() == 10
    assert spark.conf.get(name) == before


def test_the_search_tries_the_whole_grids(spark, monkeypatch):
    from tillsight.plans import models
    rows = spark.createDataFrame([(0,)], "features int").select("features", F.lit(1.0).alias("label"), F.lit(0).alias("block"))
    tried = []
    monkeypatch.setattr(models, "model_matrix", lambda s, d: (rows, []))

    def fits(matrix, grids, n_splits=5, **more):
        tried.extend((k, tuple(sorted(p.items()))) for k, g in grids.items() for p in g)
        return [(k, p, 1.0, 4) for k, g in grids.items() for p in g]
    monkeypatch.setattr(ML, "tune_by_fits", fits)
    monkeypatch.setattr(ML, "tune_from_sums", fits)
    got = models.q_hyperparameter_search(spark, "").collect()
    assert sorted(tried) == sorted((k, tuple(sorted(p.items()))) for k, g in ML.GRIDS.items() for p in g) and len(got) == len(tried)


def test_a_table_is_one_compressed_copy(spark):
    from pathlib import Path

    from tillsight.session import cut_to_table, discard
    df = spark.range(20000).select((F.col("id") % 3).cast("double").alias("a"), F.lit(None).cast("string").alias("b"))
    t = cut_to_table(df, "tiny")
    at = Path(t.__dict__["_stored_at"].removeprefix("file:"))
    assert t.count() == 20000 and t.schema == df.schema and sum(f.stat().st_size for f in at.iterdir()) < 160000
    discard(t)
    assert not at.exists()
