"""Approximate nearest neighbours by largest inner product with collision-counting hashing.

Vectors get one more component that makes all of them equally long, so the largest inner product is
the least distance. A block keeps one sorted array for each random projection. A query opens a
window around its own projection in every array; the window grows (virtual rehashing), and vectors
that collide with the query in enough arrays are verified, until the window is so wide that a vector
at the kth verified distance would have collided; those are ranked by the exact product."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .blocked_search import flat_vectors, rank_best, search_blocks

PROJECTIONS = 64
THRESHOLD = 0.5         # share of the projections in which a vector must collide
REACH = 0.82            # half width at which the windows stop, in kth verified distances: a vector at that distance
                        # collides in an array with probability erf(0.82 / sqrt 2) = 0.588, in half of 64 with 0.92
FIRST_WINDOW = 0.6      # half width of the first window in standard deviations of the projections
GROWTH = 1.05
QUERIES_AT_ONCE = 128   # queries whose collision counts are held at a time


def usable_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<double>, dim) of the vectors that take part: no null id, not null, empty or zero,
    no null or non-finite component; repeated rows count once."""
    v = F.col("v")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return (vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).distinct()
            .filter(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~odd & F.exists(v, lambda x: x != 0))
            .withColumn("dim", F.size("v")))


class WindowIndex:
    """One sorted array of projections for each random direction, over lengthened vectors."""

    def __init__(self, vectors: np.ndarray, longest: float, seed: int = 7):
        n, dim = vectors.shape
        rng = np.random.default_rng(seed)
        directions = rng.standard_normal((dim + 1, PROJECTIONS))
        rest = np.sqrt(np.maximum(0.0, longest ** 2 - (vectors ** 2).sum(axis=1)))
        places = np.hstack([vectors, rest[:, None]]) @ directions
        order = np.argsort(places, axis=0, kind="stable")
        self.sorted = np.take_along_axis(places, order, 0).T.copy()
        self.order = order.T.copy()
        self.directions, self.n, self.vectors, self.longest = directions[:dim], n, vectors, longest
        self.spread = float(places.std()) or 1.0
        # single precision sorts out most of the vectors that collide, where lengths leave room for it
        self.short = vectors.astype(np.float32) if longest ** 2 < 1e30 else vectors
        self.unsure = 4 * dim * float(np.finfo(self.short.dtype).eps) * longest

    def _verify(self, query: np.ndarray, hit: np.ndarray, k: int):
        """(indices, exact products) of the colliding vectors that can be among the k best."""
        if len(hit) > k:
            rough = self.short[hit] @ query.astype(self.short.dtype)
            kth = np.partition(rough, len(rough) - k)[len(rough) - k]
            hit = hit[rough >= kth - self.unsure * np.sqrt((query ** 2).sum())]
        return hit, (self.vectors[hit] * query).sum(axis=1)

    def _bounds(self, values: np.ndarray, side: str) -> np.ndarray:
        """Places of ``values`` (projection, query) in the sorted arrays."""
        return np.stack([np.searchsorted(row, v, side) for row, v in zip(self.sorted, values)])

    def search(self, queries: np.ndarray, k: int):
        """For each row of ``queries`` (its place, indices, inner products): the verified vectors that can
        be among the k best, at least k if the block has them."""
        need = int(np.ceil(THRESHOLD * PROJECTIONS))
        for start in range(0, len(queries), QUERIES_AT_ONCE):
            some = queries[start:start + QUERIES_AT_ONCE]
            length = np.sqrt((some ** 2).sum(axis=1))
            centre = ((some * (self.longest / length)[:, None]) @ self.directions).T    # queries as long as the vectors
            asked = some.astype(self.short.dtype)
            counts, verified = np.zeros((len(some), self.n), np.uint8), np.zeros((len(some), self.n), bool)
            best = [np.empty(0, self.short.dtype)] * len(some)                          # the k largest products so far
            open_, half = np.arange(len(some)), FIRST_WINDOW * self.spread
            left = right = self._bounds(centre, "left")
            while len(open_):
                lo, hi = self._bounds(centre[:, open_] - half, "left"), self._bounds(centre[:, open_] + half, "right")
                left, right = np.maximum(left, lo), np.minimum(right, hi)
                more = np.ones(len(open_), bool)
                for i, q in enumerate(open_):
                    wider = [row[a:b] for row, a, b in zip(self.order, lo[:, i], left[:, i])]   # what the wider window adds
                    wider += [row[a:b] for row, a, b in zip(self.order, right[:, i], hi[:, i])]
                    counts[q] += np.bincount(np.concatenate(wider), minlength=self.n).astype(np.uint8)
                    new = np.flatnonzero((counts[q] >= need) & ~verified[q])
                    verified[q, new] = True
                    near = np.concatenate([best[q], self.short[new] @ asked[q]])
                    best[q] = near if len(near) <= k else np.partition(near, len(near) - k)[len(near) - k:]
                    covered = len(best[q]) == k and half >= REACH * self._distance(best[q].min(), length[q])
                    if covered or (lo[:, i] == 0).all() and (hi[:, i] == self.n).all():
                        more[i] = False
                        yield start + q, *self._verify(some[q], np.flatnonzero(verified[q]), k)
                open_, left, right = open_[more], lo[:, more], hi[:, more]
                half *= GROWTH

    def _distance(self, product: float, length: float) -> float:
        """Between the lengthened vectors of a query of this length and of a vector with this product."""
        return float(np.sqrt(max(0.0, 2 * self.longest * (self.longest - float(product) / length))))


def _searcher(dim: int, longest: float, k: int):
    def run(queries, rows):
        q, v, s, rid = [], [np.empty(0, np.int64)], [np.empty(0)], [np.empty(0, np.int64)]
        if queries.num_rows and rows.num_rows:
            ids, row, asked = rows.column("vec_id").to_numpy(), rows.column("row").to_numpy(), queries.column("query_id").to_numpy()
            index = WindowIndex(flat_vectors(rows.column("v"), dim), longest)
            # repeated ids with other vectors are other rows; all of the query's own id may be in its way
            own = Counter(ids[np.isin(ids, asked)].tolist())
            most = k + max(own.values(), default=0)
            for i, at, score in index.search(flat_vectors(queries.column("v"), dim), most):
                other = ids[at] != asked[i]
                at, score = at[other], score[other]
                best = np.lexsort((ids[at], -score))[:k]
                q.extend([asked[i]] * len(best))
                v.append(ids[at[best]])
                rid.append(row[at[best]])
                s.append(score[best])
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(np.concatenate(v)), "row": pa.array(np.concatenate(rid)),
                         "score": pa.array(np.concatenate(s))})

    return run


def inner_product_topk(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each id divisible by ``every``, the k nearest other rows found
    (all others, if fewer), by largest inner product in double precision, ties to the smaller id.

    Null, zero and non-finite vectors take no part (see ``usable_vectors``); rows that repeat id and vector count
    once and a row with the query's id is never its answer. An id with several vectors is several rows, each an
    answer of its own; as a query it is one, whose nearness to a row is that of its nearest vector. Vectors are compared with those of the same
    number of components. An empty table gives no row; other columns are not read. Every row is
    indexed; recall against brute force is measured in the tests."""
    own = usable_vectors(vectors, id_col, vec_col)
    longest = {r[0]: float(r[1]) for r in own.groupBy("dim").agg(F.max(F.sqrt(F.aggregate(
        "v", F.lit(0.0), lambda s, x: s + x * x)))).collect()}      # a row for each number of components
    deal = F.struct("vec_id", "v")
    queries = own.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "v", deal.alias("deal"))
    rows = own.select("vec_id", "v", F.xxhash64("v").alias("row"), deal.alias("deal"))
    found = None
    for dim, far in sorted(longest.items()):
        part = search_blocks(rows.filter(F.size("v") == dim), queries.filter(F.size("v") == dim), _searcher(dim, far, k),
                             "query_id long, vec_id long, row long, score double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id", "row").agg(F.max("score").alias("score"))
    return rank_best(best, k, -F.col("score"))
