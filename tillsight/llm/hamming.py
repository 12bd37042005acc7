"""Exact top-k search over binary codes by multi-index hashing.

A code is cut into segments; per segment the codes are kept sorted by their value. A query probes
the values within a growing radius of its own, segment after segment, and stops once the kth
verified distance is covered: when radius r has been searched in the first s of m segments and
radius r - 1 in the others, every code within m r + s - 1 has been met in some segment."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType

from .blocked_search import rank_best, search_blocks

SEGMENT_BITS = 16
WORD_BITS = 64


def sign_codes(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, code array<long>): one bit for each component, set where it is above 0; the last component is the
    lowest bit of the first word, and every 64 components take a word. Null vectors and ids, empty vectors and
    vectors with null components have no code; a NaN component counts as above 0."""
    v = F.col(vec_col)
    bits = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda s, x: F.shiftleft(s, 1).bitwiseOR(
        F.when(x > 0, F.expr("1L")).otherwise(F.expr("0L"))))
    words = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / WORD_BITS).cast("int")), lambda j: bits(
        F.slice(v, F.greatest(F.lit(1), F.size(v) - WORD_BITS * (j + 1) + 1), F.least(F.lit(WORD_BITS), F.size(v) - WORD_BITS * j))))
    return (vectors.filter(F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull()))
            .select(F.col(id_col).cast("long").alias("vec_id"), words.alias("code")))


def _masks(bits: int) -> list[np.ndarray]:
    """For each radius the masks that flip so many of a segment's bits."""
    return [np.array([sum(1 << i for i in c) for c in combinations(range(bits), r)], np.uint64) for r in range(bits + 1)]


class SegmentIndex:
    """Distinct codes, a row of 64-bit words each, by the values of their segments."""

    def __init__(self, codes: np.ndarray, segment: int = SEGMENT_BITS):
        self.codes, self.segment, self.in_word = codes, segment, WORD_BITS // segment
        self.parts = self.in_word * codes.shape[1]
        self.values, self.order = [], []
        for s in range(self.parts):
            v = self._value(codes, s)
            o = np.argsort(v, kind="stable")
            self.order.append(o)
            self.values.append(v[o])
        self.masks: list[np.ndarray] = []

    def _value(self, codes, s):
        word, at = divmod(s, self.in_word)
        return (codes[..., word] >> np.uint64(at * self.segment)) & np.uint64((1 << self.segment) - 1)

    def search(self, query: np.ndarray, holds: np.ndarray, k: int):
        """(indices, distances) of codes that together hold the k nearest rows, all codes at the kth
        distance included; ``holds`` is how many rows each code stands for, 0 if none of them counts."""
        self.masks = self.masks or _masks(self.segment)
        seen = np.zeros(len(self.codes), bool)
        found, dist, k = np.empty(0, np.int64), np.empty(0, np.int64), min(k, int(holds.sum()))
        for r in range(self.segment + 1):
            for s in range(self.parts):
                probe = self._value(query, s) ^ self.masks[r]
                lo, hi = (np.searchsorted(self.values[s], probe, side) for side in ("left", "right"))
                n = hi - lo
                if n.any():
                    at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                    new = self.order[s][at]
                    new = new[~seen[new]]
                    seen[new] = True
                    found = np.concatenate([found, new])
                    dist = np.concatenate([dist, np.bitwise_count(self.codes[new] ^ query).sum(axis=1, dtype=np.int64)])
                covered = self.parts * r + s            # all codes up to this distance are verified
                near = dist <= covered
                if holds[found[near]].sum() >= k:
                    kth = np.sort(np.repeat(dist[near], holds[found[near]]))[k - 1] if k else -1
                    keep = dist <= kth
                    return found[keep], dist[keep]
        return found, dist


def _code_words(column, width: int) -> np.ndarray:
    """An Arrow column of word lists as rows of ``width`` words; shorter lists end in zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    many = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(many), width), np.uint64)
    out[np.arange(width) < many[:, None]] = lists.flatten().to_numpy().view(np.uint64)
    return out


def hamming_topk(codes: DataFrame, k: int = 10, every: int = 50) -> DataFrame:
    """query_id, rank, vec_id, distance: for each id divisible by ``every``, the k other rows of least
    Hamming distance, ties to the smaller id; all others if fewer than k.

    ``codes``: vec_id, code (long, or array<long> of any number of words; where codes differ in their words, the
    missing ones are zeros). Null ids or codes take no part; repeated rows count once, and a row
    with the query's id is never its answer: the search leaves the rows of that id out, however many
    codes it has. An id with several codes is several rows, as a query and as an answer: each pair of
    codes counts. Rows with one code are one entry of the index, which carries their ids, the smallest
    k + 1 of them: a code lists the query's id once at most, so k others are left to each query.
    An empty table gives no row; other columns are not read."""
    words = F.col("code") if isinstance(codes.schema["code"].dataType, ArrayType) else F.when(F.col("code").isNotNull(), F.array("code"))
    own = codes.select(F.col("vec_id").cast("long").alias("vec_id"), words.cast("array<long>").alias("code")).filter("vec_id is not null and code is not null").distinct()
    first = (own.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64))).groupBy("code", "salt")
             .agg(F.slice(F.sort_array(F.collect_set("vec_id")), 1, k + 1).alias("ids")))
    classes = first.groupBy("code").agg(F.slice(F.sort_array(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids"))
    queries = own.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "code", F.col("vec_id").alias("deal"))

    def run(queries, rows):
        width = max((len(c) for t in (rows, queries) for c in t.column("code").to_pylist()), default=0)
        if not width:
            return pa.table({n: pa.array([], pa.int64()) for n in ("query_id", "vec_id", "score")})
        index = SegmentIndex(_code_words(rows.column("code"), width))
        lists = rows.column("ids").combine_chunks() if isinstance(rows.column("ids"), pa.ChunkedArray) else rows.column("ids")
        ids, holds = lists.to_pylist(), np.diff(lists.offsets.to_numpy())
        flat, owner = lists.flatten().to_numpy(), np.repeat(np.arange(len(holds)), holds)
        by_id = np.argsort(flat, kind="stable")
        flat, owner = flat[by_id], owner[by_id]
        nearest: dict[int, list] = {}
        for qid, code in zip(queries.column("query_id").to_pylist(), _code_words(queries.column("code"), width)):
            own = owner[np.searchsorted(flat, qid, "left"):np.searchsorted(flat, qid, "right")]
            holds[own] -= 1                                     # the query's own rows are no answers
            at, dist = index.search(code, holds, k)
            holds[own] += 1
            new = ((x, i) for a, x in zip(at.tolist(), dist.tolist()) for i in ids[a] if i != qid)
            nearest[qid] = sorted([*nearest.get(qid, ()), *new])[:k]
        q = [qid for qid, best in nearest.items() for _ in best]
        d, v = ([x[j] for best in nearest.values() for x in best] for j in (0, 1))
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(d, pa.int64())})

    found = search_blocks(classes.withColumn("deal", F.col("code")), queries, run, "query_id long, vec_id long, score long")
    return rank_best(found, k, F.col("score")).withColumnRenamed("score", "distance")


def oracle(k: int = 10, every: int = 50) -> str:
    return f"""
WITH c AS (SELECT DISTINCT vec_id, list_transform(range(0, (len(embedding) + 63) // 64), lambda j:
    list_reduce(list_prepend(0::UBIGINT, list_transform(embedding[greatest(1, len(embedding) - 64 * j - 63) : len(embedding) - 64 * j],
      lambda x: CASE WHEN x > 0 THEN 1::UBIGINT ELSE 0::UBIGINT END)), lambda a, b: ((a & 9223372036854775807::UBIGINT) << 1) | b)) AS code
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL)) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, greatest(len(q.code), len(c.code)) + 1), lambda j:
    bit_count(xor(coalesce(q.code[j], 0::UBIGINT), coalesce(c.code[j], 0::UBIGINT))))) AS BIGINT) AS distance
  FROM c q, c WHERE q.vec_id % {every} = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INT) AS rank FROM p)
SELECT query_id, rank, vec_id, distance FROM r WHERE rank <= {k}
"""
