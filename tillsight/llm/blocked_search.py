"""Queries against all rows, in blocks: rows and queries are dealt into blocks of bounded size, each
pair of blocks is searched by one task, and the best of each task are merged per query."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

ROW_BLOCK = 1 << 15
QUERY_BLOCK = 1 << 12


def search_blocks(rows: DataFrame, queries: DataFrame, run, schema: str,
                  row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``run(queries, rows)``, two Arrow tables, over every pair of blocks. Both frames have a column
    ``deal`` by whose hash they are dealt; the number of blocks follows from their counts."""
    n, m = rows.count(), queries.count()
    nr, nq = max(1, -(-n // row_block)), max(1, -(-m // query_block))
    block = lambda k: F.pmod(F.xxhash64("deal"), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = queries.withColumn("qb", block(nq)).withColumn("rb", every(nr)).drop("deal")
    right = rows.withColumn("rb", block(nr)).withColumn("qb", every(nq)).drop("deal")
    return left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInArrow(run, schema)


def rank_best(found: DataFrame, k: int, best_first) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): the k best of each query by ``best_first`` (score
    order) and then the smaller id; each query has at most k rows a block here."""
    least = found.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct(best_first.alias("o"), "vec_id", "score"))), 1, k).alias("b"))
    return least.select("query_id", F.posexplode("b").alias("p", "m")).select(
        "query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("m.vec_id").alias("vec_id"), F.col("m.score").alias("score"))


def flat_vectors(column, dim: int) -> np.ndarray:
    """An Arrow list column as a matrix."""
    whole = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    return whole.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
