"""Best-fit packing into sequences of several permitted lengths.

Texts are counted, longer ones than the longest sequence are cut, and the pieces of each partition
are packed by best-fit decreasing: a piece goes to the open sequence that it fills best, else the
sequence length of least cost a token, with what the pieces left can fill it, is opened. Every
sequence is finally downsized to the shortest length that holds its contents. Plans that open one
length throughout are compared, and the cheapest plan of the partition stands."""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .token_counts import count_tokens

LENGTHS = (512, 1024, 2048, 4096)
SEQUENCE_COST = 64      # cost of a sequence beyond its length, in tokens
PIECES = 200_000        # pieces packed together, at most: bounds a task's memory
_SCHEMA = "doc_id long, piece int, start long, n_tokens long, shard int, sequence long, capacity long, offset long"


class _Left:
    """The pieces not yet placed, by size."""

    def __init__(self, sizes):
        self.sizes, self.many = (x.tolist() for x in np.unique(np.array(sizes, np.int64), return_counts=True))

    def take_largest(self):
        self.many[-1] -= 1
        if not self.many[-1]:
            self.sizes.pop()
            self.many.pop()

    def fill(self, room):
        """How much of ``room`` these pieces take, the largest that fit first."""
        used, end = 0, len(self.sizes)
        while room > 0 and (end := bisect.bisect_right(self.sizes, room, 0, end) - 1) >= 0:
            n = min(self.many[end], room // self.sizes[end]) * self.sizes[end]
            used, room = used + n, room - n
        return used


def _packed(sizes, lengths, cost, length_for):
    """(total cost, sequence of each piece, capacity of each sequence) by best-fit decreasing, where
    ``length_for(piece, pieces left)`` says what to open."""
    place, used, free, by_free, rest = [], [], [], {}, _Left(sizes)
    for n in sizes:
        rest.take_largest()
        at = bisect.bisect_left(free, n)
        if at < len(free):                           # the open sequence with the least room that is enough
            room = free[at]
            s = by_free[room].pop()
            if not by_free[room]:
                del by_free[room]
                free.pop(at)
        else:
            room = length_for(n, rest)
            s = len(used)
            used.append(0)
        used[s] += n
        place.append(s)
        if room > n:
            left = room - n
            if left not in by_free:
                bisect.insort(free, left)
                by_free[left] = []
            by_free[left].append(s)
    caps = [lengths[bisect.bisect_left(lengths, u)] for u in used]
    return sum(map(cost, caps)), place, caps


def best_fit(sizes, lengths, cost):
    """(sequence of each piece, capacity of each sequence) for pieces of these sizes, given from the largest to the
    smallest.

    What is opened for a piece is the length of least cost a token, with the tokens that the pieces left can fill it
    with and the length it can be downsized to then. Packing with one largest length throughout is tried as well,
    for each length; the cheapest plan stands."""
    lengths = sorted(lengths)

    def least_cost(n, rest):
        def price(c):
            held = n + rest.fill(c - n)
            return cost(lengths[bisect.bisect_left(lengths, held)]) / held, -c
        return min((c for c in lengths if c >= n), key=price)

    def upto(top):
        return lambda n, rest: max(top, lengths[bisect.bisect_left(lengths, n)])

    plans = [_packed(sizes, lengths, cost, choice) for choice in (least_cost, *map(upto, reversed(lengths)))]
    _, place, caps = min(plans, key=lambda p: p[0])
    return place, caps


def pack_tokens(docs: DataFrame, model_path: str, lengths=LENGTHS, sequence_cost: float = SEQUENCE_COST) -> DataFrame:
    """``pack`` by the tokens of the SentencePiece model at ``model_path``: n_tokens and start count its
    tokens of the whole text, so no sequence holds more of them than its capacity. The counts come
    from ``count_tokens`` in the same scan, without a shuffle."""
    return pack(count_tokens(docs, model_path), lengths, sequence_cost, tokens_col="n_tokens")


def pack(docs: DataFrame, lengths=LENGTHS, sequence_cost: float = SEQUENCE_COST, id_col: str = "doc_id", text_col: str = "text",
         tokens_col: str | None = None) -> DataFrame:
    """A row for each piece: doc_id, piece (from 0), start (its first token in the document), n_tokens,
    shard and sequence (together the packed sequence), capacity (its length), offset (the piece's
    place in it).

    Tokens are counted by ``tokens_col`` or else as words: runs without ASCII white space, of which a
    tokenizer makes several tokens each (see ``pack_tokens`` for real counts). Documents
    longer than the longest length are cut into whole pieces of that length and a rest; no token is
    dropped. Null, empty and blank texts have no token, take no room and give no row. Repeated rows are packed
    each on its own; null ids stay; an empty table gives no row; other columns are not read. Only
    the counts leave the scan; each partition is a shard, packed by its own task in runs of at
    most ``PIECES`` pieces."""
    lengths = tuple(sorted(set(lengths)))
    n = F.col(tokens_col) if tokens_col else F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+"))
    counted = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(n, F.lit(0)).cast("long").alias("n"))
    counted = counted.filter("n > 0").withColumn("shard", F.spark_partition_id())
    longest = lengths[-1]

    def plan(docs, shard, base):
        ids, piece, start, size = docs
        order = np.lexsort((piece, ids, -size))
        place, caps = best_fit(size[order].tolist(), lengths, lambda c: c + sequence_cost)
        place, caps = np.array(place, np.int64), np.array(caps, np.int64)
        by = np.argsort(place, kind="stable")                 # pieces of a sequence, the largest first
        own, many = size[order][by], np.bincount(place)
        before = np.cumsum(own) - own
        first = np.repeat(before[np.cumsum(many) - many], many)
        rows = order[by]
        out = [piece[rows].astype(np.int32), start[rows], own, np.full(len(rows), shard, np.int32), place[by] + base, caps[place[by]], before - first]
        return rows, out, len(caps)

    def run(batches):
        held, count, base, shard = [], 0, 0, 0

        def flush():
            nonlocal held, count, base
            table = pa.Table.from_batches(held)
            n = table.column("n").to_numpy()
            k = -(-n // longest)
            doc = np.repeat(np.arange(len(n)), k)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(k) - k, k)
            start = piece * longest
            size = np.minimum(n[doc] - start, longest)
            ids = table.column("doc_id").combine_chunks()
            whole = ids.take(pa.array(doc))
            for a in range(0, len(doc), PIECES):
                b = slice(a, a + PIECES)
                rows, cols, sequences = plan((whole[b].fill_null(-1).to_numpy(), piece[b], start[b], size[b]), shard, base)
                base += sequences
                yield pa.RecordBatch.from_arrays([whole[b].take(pa.array(rows)), *map(pa.array, cols)],
                                                 ["doc_id", "piece", "start", "n_tokens", "shard", "sequence", "capacity", "offset"])
            held, count = [], 0

        for batch in batches:
            if not batch.num_rows:
                continue
            shard = batch.column("shard")[0].as_py()
            held.append(batch.select(["doc_id", "n"]))
            count += batch.num_rows
            if count >= PIECES:
                yield from flush()
        if held:
            yield from flush()

    return counted.mapInArrow(run, _SCHEMA)
