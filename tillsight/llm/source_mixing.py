"""Mixing sources to target weights by whole documents.

The words that a source should give are its share by weight, at most ``MOST`` times what it has. A source gives
all its documents as often as its target holds them, and the rest of the budget is fitted as a subset sum: documents are counted by
exact length, each length gives its share of the rest but for a last part, and a bounded-knapsack dynamic
program over the lengths left fills that part as nearly as they can. Of each length then the documents that a seeded hash puts
first are taken. Texts are read once; only counts by (source, length) meet in a task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tillsight.operators.positions import numbered

from .common import stored

WEIGHTS = (5, 2, 1)
MOST = 3                    # times that a document's words may be taken
EXACT_WORDS = 1 << 16       # words of a source's budget that the dynamic program fills, about
SEED = 42
_PICKS = "key string, size long, picked long"


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, key (the source marked by a first character, so that null has a key of its own and comes last) and size in words."""
    words = F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+"))
    source = F.col(source_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("0"), source), F.lit("1")).alias("key"),
                       F.coalesce(words, F.lit(0)).cast("long").alias("size"))


def targets(totals: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """key, source_size and target of each source, given (key, source_size).

    Weights repeat over the sources in the order of their keys. The level, words for each unit of weight, rises
    until no source is above ``most`` times its size: every round the sources that the level fills hand the rest on."""
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    own = numbered(totals, "key", name="place").withColumn("weight", w)
    level, full = 0.0, -1
    while True:
        filled = F.lit(most) * F.col("source_size") < F.lit(level) * F.col("weight")
        now = own.agg(F.sum("source_size"), F.sum(F.when(filled, F.lit(most) * F.col("source_size"))),
                      F.sum(F.when(~filled, F.col("weight"))), F.count(F.when(filled, 1))).first()
        if now[3] == full or not now[0] or not now[2]:
            break
        full, level = now[3], (now[0] - (now[1] or 0)) / now[2]
    target = F.least(F.lit(most) * F.col("source_size"), F.lit(level) * F.col("weight")).cast("double")
    return own.select("key", "source_size", target.alias("target"))


def fit(sizes, counts, budget: float, exact: int = EXACT_WORDS):
    """How many documents of each size (all above 0, distinct) to take, so that their words come as near as the
    fit finds to ``budget`` (from 0 to all words).

    Beyond about ``exact`` words each size gives its share, from the largest down, what one size leaves going over to the
    next. The rest is a bounded knapsack over the documents left: sizes are split into one, two, four ... of them, ``way``
    holds for each sum the part by which it was first reached, and the nearest sum, the lower of two, is read back."""
    sizes, counts = np.asarray(sizes, np.int64), np.asarray(counts, np.int64)
    order = np.argsort(-sizes)
    taken = np.zeros(len(sizes), np.int64)
    total = int((sizes * counts).sum())
    share, spent = max(0, int(budget) - exact), 0
    if share and total:
        seen = 0
        for i in order.tolist():
            seen += int(sizes[i] * counts[i])
            x = min(int(counts[i]), (seen * share // total - spent) // int(sizes[i]))
            taken[i] = x
            spent += x * int(sizes[i])
    rest = budget - spent
    top = int(2 * rest)             # a sum beyond it is farther away than none
    parts = []
    for i in order.tolist():
        left, step = min(int(counts[i] - taken[i]), top // int(sizes[i])), 1
        while left > 0:
            n = min(step, left)
            parts.append((i, n, n * int(sizes[i])))
            left, step = left - n, 2 * step
    way = np.full(top + 1, -1, np.int64)
    reached = np.zeros(top + 1, bool)
    reached[0] = True
    for k, (_, _, words) in enumerate(parts):
        new = np.flatnonzero(reached[:top + 1 - words] & ~reached[words:]) + words
        way[new] = k
        reached[new] = True
        if reached[int(rest)] and rest == int(rest):
            break
    sums = np.flatnonzero(reached)
    at = int(sums[np.argmin(np.abs(sums - rest))])
    while at:
        i, n, words = parts[way[at]]
        taken[i] += n
        at -= words
    return taken


def _fitted(table: pa.Table) -> pa.Table:
    """One source's counts by size -> the documents of each size that are taken once more."""
    size, count, budget = (table.column(c).to_numpy() for c in ("size", "n", "budget"))
    picked = fit(size, count, float(budget[0]))
    return pa.table({"key": table.column("key"), "size": table.column("size"), "picked": pa.array(picked, pa.int64())})


def mix_sources(docs: DataFrame, weights=WEIGHTS, most: int = MOST, seed: int = SEED, id_col: str = "doc_id",
                text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target and taken (words of the document that the mix takes, repeats counted) of every document.

    Null texts have size 0 and nothing is taken of them; so have blank ones. A null source is a source of its own, the last; an empty name is
    another. Repeated rows are documents each; rows alike in id, source and size cannot be told apart, and the mix may take some of them.
    Null ids stay. Without any word all targets are 0; an empty table gives no row; very long texts count as a whole; other columns
    are not read. The choice hangs on ids and ``seed`` alone, not on the table's order."""
    own = stored(sized(docs, id_col, text_col, source_col), "mix-sizes")
    by_size = stored(own.groupBy("key", "size").agg(F.count("*").alias("n")), "mix-counts")
    totals = by_size.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goal = stored(targets(totals, weights, most), "mix-targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goal = goal.withColumn("whole", F.least(whole, F.lit(most)).cast("long"))
    goal = goal.withColumn("budget", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    counts = by_size.filter("size > 0").join(goal, "key")
    picks = counts.select("key", "size", "n", "budget").groupBy("key").applyInArrow(_fitted, _PICKS)
    # each document's place among those of its source and size: whole hash buckets first, then the rows of the last one
    buckets = F.floor(F.sqrt("n")).cast("long")        # as many buckets as documents in one, about
    plan = by_size.join(picks, ["key", "size"], "left").join(goal.drop("budget"), "key").select(
        "key", "size", "source_size", "target", "whole", F.coalesce("picked", F.lit(0)).alias("picked"), buckets.alias("buckets"))
    plan = stored(plan, "mix-plan")
    mark = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("key"))
    alike = own.groupBy("doc_id", "key", "size").agg(F.count("*").alias("m"))
    marked = stored(alike.join(plan, ["key", "size"]).withColumn("mark", mark).withColumn("bucket", F.pmod("mark", "buckets")), "mix-marked")
    held = marked.groupBy("key", "size", "bucket").agg(F.sum("m").alias("held"))
    before = Window.partitionBy("key", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("base", F.coalesce(F.sum("held").over(before), F.lit(0)))
    placed = marked.join(held, ["key", "size", "bucket"])
    edge = (F.col("base") < F.col("picked")) & (F.col("base") + F.col("held") > F.col("picked"))
    inside = Window.partitionBy("key", "size", "bucket").orderBy("mark", F.col("doc_id").asc_nulls_first())
    first = F.coalesce(F.sum("m").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = placed.filter(edge).withColumn("once", F.greatest(F.lit(0), F.least(F.col("m"), F.col("picked") - F.col("base") - first)))
    outside = placed.filter(~edge).withColumn("once", F.when(F.col("base") < F.col("picked"), F.col("m")).otherwise(F.lit(0)))
    chosen = within.unionByName(outside)
    rows = chosen.select("doc_id", "size", "source_size", "target", "whole", "once", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))).alias("copy"))
    taken = F.col("size") * (F.col("whole") + F.when(F.col("copy") <= F.col("once"), 1).otherwise(0))
    return rows.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))
