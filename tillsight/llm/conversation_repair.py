"""Repair of the turn structure of conversations by a cheapest edit script.

The edits of a conversation are paths through a lattice of (rows done, role last written). A bidirectional
Dijkstra search grows a heap from either end until no cheaper crossing can follow, finishes all
crossings of equal cost and takes the one whose joined audit is least.

Conversations of at most ``MOST_ROWS`` rows are dealt by id and searched one by one. Longer ones are cut into
segments by a range partitioning over (conversation, turn); each segment is searched between every two roles that it
may begin and end with, the small tables of segments are joined pairwise in order, and the chosen script
goes back to the segments, which write their part of the repaired text. Only the last step, the one digest
of a conversation's whole text, reads its parts in sequence; it holds one part at a time."""

from __future__ import annotations

import hashlib
import heapq
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import stored

MOST_ROWS = 512             # rows of a conversation, or of a segment, that one search treats
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
# Role last written: none, s, u, a; the role that follows may be kept where its initial is listed.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
COMPLETE = (0, 3)
LEGAL = {"su", "ua", "au"}
_WRITTEN = {"u": "user", "a": "assistant"}
_SPACE = r"[\x20\x09-\x0D]"


class Item(NamedTuple):
    """A row, or ``n`` rows alike that must all go (``gone``)."""
    role: str
    text: str
    n: int
    gone: bool
    cut: bool       # truncated


def _edges(items):
    """Lattice edges out of (i, state): (i, state, cost, edits) after it; and the same backwards."""
    m = len(items)
    out = [[[] for _ in NEXT] for _ in range(m + 1)]
    for i in range(m + 1):
        for s, follow in enumerate(NEXT):
            own = out[i][s]
            for role in "ua":
                if role in follow:
                    own.append((i, follow[role], INSERT, "I"))
            if i == m:
                continue
            row = items[i]
            own.append((i + 1, s, DELETE * row.n, "D" * row.n))
            if not row.gone:
                more = TRUNCATED if row.cut else 0
                if row.role[:1] in follow:
                    own.append((i + 1, follow[row.role[:1]], more, "K"))
                for role in "ua":
                    if role in follow:
                        own.append((i + 1, follow[role], REROLE + more, "R"))
    back = [[[] for _ in NEXT] for _ in range(m + 1)]
    for i, states in enumerate(out):
        for s, own in enumerate(states):
            for j, t, c, e in own:
                back[j][t].append((i, s, c, e))
    return out, back


def search(edges, begin: int, ends) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest edits from state ``begin`` before the first row to one of ``ends`` after the last;
    of equal costs the ASCII-least audit. None where no script leads there.

    Nodes of one cost are taken in the order of their place: edits of cost 0 only lead to later places, so a node's
    audit is final when it is taken. Two scripts of one cost between the same nodes never are prefixes of each
    other, so that the least script is made of least parts."""
    out, back = edges
    m = len(out) - 1
    best = ({(0, begin): (0, "")}, {(m, t): (0, "") for t in ends})
    heaps = ([(0, 0, begin)], [(0, 0, t) for t in ends])
    done, least = (set(), set()), None
    while heaps[0] and heaps[1] and (least is None or heaps[0][0][0] + heaps[1][0][0] <= least):
        side = 0 if heaps[0][0][0] <= heaps[1][0][0] else 1
        cost, at, s = heapq.heappop(heaps[side])
        i = at if side == 0 else m - at
        if (i, s) in done[side]:
            continue
        done[side].add((i, s))
        audit = best[side][i, s][1]
        if (i, s) in best[1 - side]:
            total = cost + best[1 - side][i, s][0]
            least = total if least is None else min(least, total)
        for j, t, c, e in (out if side == 0 else back)[i][s]:
            new = (cost + c, audit + e if side == 0 else e + audit)
            old = best[side].get((j, t))
            if old is None or new < old:
                best[side][j, t] = new
                if old is None or new[0] < old[0]:
                    heapq.heappush(heaps[side], (new[0], j if side == 0 else m - j, t))
                other = best[1 - side].get((j, t))
                if other is not None and (least is None or new[0] + other[0] < least):
                    least = new[0] + other[0]
    if least is None:
        return None
    found = []
    for i, s in done[0]:
        cost, audit = best[0][i, s]
        # nodes that the reverse search has seen but not taken add real scripts of the same cost, no lesser ones
        for j, t, c, e in [(i, s, 0, ""), *out[i][s]]:
            after = best[1].get((j, t))
            if after is not None and cost + c + after[0] == least:
                found.append(audit + e + after[1])
    return least, min(found)


def rewritten(items, audit: str, state: int) -> list[str]:
    """The lines ``role:text`` that the edits of ``audit`` write, from ``state`` on."""
    lines, at = [], 0
    left = items[0].n if items else 0
    for edit in audit:
        if edit in "IR":
            role = "u" if "u" in NEXT[state] else "a"
            lines.append(f"{_WRITTEN[role]}:{items[at].text if edit == 'R' else ''}")
            state = NEXT[state][role]
        elif edit == "K":
            lines.append(f"{items[at].role}:{items[at].text}")
            state = NEXT[state][items[at].role[:1]]
        if edit != "I":
            left -= 1
            if not left:
                at += 1
                left = items[at].n if at < len(items) else 0
    return lines


class _Faults:
    """Counts over rows in order: turns, first faults, pairs of roles; and the lattice's items."""

    def __init__(self, seen: bool):
        self.items, self.seen = [], set() if seen else None
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = self.rows = 0
        self.first = self.last = None               # turns
        self.left = self.right = None               # initials

    def add(self, turn, role, text, blank, cut, n, again):
        """``n`` rows alike; ``again``: the same role and text stand earlier."""
        if turn is not None and turn != self.last:
            self.turns += 1
            self.first = turn if self.first is None else self.first
            self.last = turn
        initial = role[:1]
        self.illegal += (self.right is not None and self.right + initial not in LEGAL) + n - 1
        self.left = initial if self.left is None else self.left
        self.right = initial
        self.rows += n
        if self.seen is not None and not blank:
            key = hashlib.sha256(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass")).digest()
            again = key in self.seen
            self.seen.add(key)
        gone = n if blank or again else n - 1
        self.blank += n if blank else 0
        self.duplicate += 0 if blank else gone
        if gone < n:
            self.truncated += bool(cut)
            self.items.append(Item(role, text, 1, False, bool(cut)))
        if gone:
            self.items.append(Item(role, text, gone, True, False))


_FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_SCHEMA = "conv_id long, " + ", ".join(f"{c} long" for c in _FIELDS) + ", audit string, repaired_sha256 string"
_SEGMENT = ("conv_id long, part int, seg long, n_rows long, blank long, duplicate long, truncated long, illegal long, turns long, "
            "first long, last long, left string, right string, costs array<long>, audits array<string>, "
            "items array<struct<role:string,text:string,n:long,gone:boolean,cut:boolean>>")
_PIECE = "conv_id long, part int, seg long, state int, piece string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_INPUT = ["conv_id", "turn", "role", "text", "blank", "cut", "n", "again"]


def _rows(batches, names=None):
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in (names or batch.schema.names)]
        yield from zip(*columns)


def _arrow(rows, target, most=1 << 23):
    """Record batches of ``rows``, of about ``most`` characters each."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 100 + sum(len(v) for v in row if isinstance(v, str))
        if size > most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), target)], schema=target)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), target)], schema=target)


def _sha(lines) -> str:
    return hashlib.sha256("\n".join(lines).encode("utf-8", "surrogatepass")).hexdigest()


def _whole(target):
    """Rows sorted by conversation and place -> a result row for each conversation."""
    def result(conv, faults):
        gaps = faults.last - faults.first + 1 - faults.turns if faults.turns else 0
        cost, audit = search(_edges(faults.items), 0, COMPLETE)
        return (conv, gaps, faults.blank, faults.duplicate, faults.truncated, faults.illegal, cost, audit,
                _sha(rewritten(faults.items, audit, 0)))

    def results(batches):
        conv, faults = None, None
        for own, turn, role, text, blank, cut, n, again in _rows(batches, _INPUT):
            if faults is None or own != conv:
                if faults is not None:
                    yield result(conv, faults)
                conv, faults = own, _Faults(seen=True)
            if role is not None:
                faults.add(turn, role, text, blank, cut, n, again)
        if faults is not None:
            yield result(conv, faults)

    return lambda batches: _arrow(results(batches), target)


def _segments(target, most):
    """The same for long conversations: a row for each segment of ``most`` items or somewhat more."""
    def result(conv, part, seg, f):
        edges = _edges(f.items)
        found = [search(edges, a, (b,)) for a in range(4) for b in range(4)]
        return (conv, part, seg, f.rows, f.blank, f.duplicate, f.truncated, f.illegal, f.turns, f.first, f.last, f.left, f.right,
                [x and x[0] for x in found], [x and x[1] for x in found], [x._asdict() for x in f.items])

    def results(batches):
        part, seg, conv, faults = TaskContext.get().partitionId(), 0, None, None
        for own, turn, role, text, blank, cut, n, again in _rows(batches, _INPUT):
            if faults is None or own != conv or len(faults.items) >= most:
                if faults is not None:
                    yield result(conv, part, seg, faults)
                    seg += 1
                conv, faults = own, _Faults(seen=False)
            if role is not None:
                faults.add(turn, role, text, blank, cut, n, again)
        if faults is not None:
            yield result(conv, part, seg, faults)

    return lambda batches: _arrow(results(batches), target)


def joined(left, right):
    """The table (cost, audit) by begin and end state of two neighbouring stretches of rows together."""
    out = []
    for a in range(4):
        for b in range(4):
            ways = [(x[0] + y[0], x, y) for x, y in ((left[4 * a + k], right[4 * k + b]) for k in range(4)) if x and y]
            cost = min((w[0] for w in ways), default=None)
            out.append(cost is not None and (cost, min(x[1] + y[1] for c, x, y in ways if c == cost)) or None)
    return out


def _plans(target):
    """Segments sorted by conversation and place, without their items -> each with its part of the chosen script."""
    names = _SEGMENT.split(", ")[:-1]
    names = [c.split()[0] for c in names]

    def result(conv, held, tables):
        while len(tables) > 1:                       # what the pairwise joining left
            right = tables.pop()
            tables[-1] = (tables[-1][0], joined(tables[-1][1], right[1]))
        cost, audit = min(tables[0][1][b] for b in COMPLETE if tables[0][1][b])
        blank = duplicate = truncated = illegal = turns = 0
        first = last = right = None
        for s in held:
            blank, duplicate, truncated = blank + s["blank"], duplicate + s["duplicate"], truncated + s["truncated"]
            illegal += s["illegal"] + (right is not None and s["left"] is not None and right + s["left"] not in LEGAL)
            right = right if s["right"] is None else s["right"]
            turns += s["turns"] - (last is not None and s["first"] == last)
            first = s["first"] if first is None else first
            last = last if s["last"] is None else s["last"]
        gaps = last - first + 1 - turns if turns else 0
        at, state = 0, 0
        for k, s in enumerate(held):
            end, rows, begin = at, s["n_rows"], state
            while end < len(audit) and (rows or k == len(held) - 1):
                rows -= audit[end] != "I"
                end += 1
            piece = audit[at:end]
            yield (conv, s["part"], s["seg"], begin, piece) + (
                (gaps, blank, duplicate, truncated, illegal, cost, audit) if k == len(held) - 1 else (None,) * 7)
            state = s["after"](piece, begin)
            at = end

    def results(batches):
        conv, held, tables = None, None, None
        for row in _rows(batches, names + ["initials"]):
            s = dict(zip(names + ["initials"], row))
            if held is None or s["conv_id"] != conv:
                if held is not None:
                    yield from result(conv, held, tables)
                conv, held, tables = s["conv_id"], [], []
            table = [None if c is None else (c, e) for c, e in zip(s.pop("costs"), s.pop("audits"))]
            initials = s.pop("initials")
            s["after"] = lambda piece, state, initials=initials: _after(piece, state, initials)
            held.append(s)
            size = 1
            while tables and tables[-1][0] == size:      # stretches of equal size are joined: each row moves log times
                table, size = joined(tables.pop()[1], table), 2 * size
            tables.append((size, table))
        if held is not None:
            yield from result(conv, held, tables)

    return lambda batches: _arrow(results(batches), target)


def _after(piece, state, initials):
    """The state after the edits of ``piece``; ``initials`` holds each row's initial, in order."""
    at = 0
    for edit in piece:
        if edit in "IR":
            state = NEXT[state]["u" if "u" in NEXT[state] else "a"]
        elif edit == "K":
            state = NEXT[state][initials[at]]
        at += edit != "I"
    return state


def _written(target):
    """Segments with their part of the script -> their lines, joined."""
    def results(batches):
        names = ["conv_id", "part", "seg", "state", "piece", "items", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
        for conv, part, seg, state, piece, items, *last in _rows(batches, names):
            lines = rewritten([Item(**x) for x in items], piece, state)
            yield (conv, part, seg, "\n".join(lines) if lines else None, *last)
    return lambda batches: _arrow(results(batches), target)


def _digested(target):
    """Parts of texts sorted by conversation and place -> a result row for each conversation."""
    def results(batches):
        sha, begun = hashlib.sha256(), False
        for conv, part, seg, text, *last in _rows(batches):
            if text is not None:
                sha.update((("\n" if begun else "") + text).encode("utf-8", "surrogatepass"))
                begun = True
            if last[-1] is not None:
                yield (conv, *last, sha.hexdigest())
                sha, begun = hashlib.sha256(), False
    return lambda batches: _arrow(results(batches), target)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and n (rows alike) after the damage by the CRC of ``conv_id:turn``, null parts as
    one space: of 20 remainders 0 drops the row (role, text and turn null: a mark of its conversation), 1
    empties the text, 2 removes its full stops, exclamation and question marks, 3 doubles the row, 4 sets the role user."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.pmod(F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))), F.lit(20))
    own = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                               space("role").alias("role"), space("text").alias("text"), how.alias("how"))
    kept = F.col("how") != 0
    return own.select(
        "conv_id", F.when(kept, F.col("turn")).alias("turn"),
        F.when(F.col("how") == 4, F.lit("user")).when(kept, F.col("role")).alias("role"),
        F.when(F.col("how") == 1, F.lit("")).when(F.col("how") == 2, F.translate("text", ".!?", "")).when(kept, F.col("text")).alias("text"),
        F.when(F.col("how") == 3, 2).otherwise(1).cast("long").alias("n"))


def repair(rows: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of each conversation of ``rows``
    (conv_id, turn, role, text, n: how many such rows stand there).

    Rows stand by turn, nulls first; ties by role, then text, so that rows alike are neighbours and the result does
    not hang on the table's order. A row with a null role only marks that its conversation exists: one without
    other rows has zeros, an empty audit and the digest of nothing. Rows without a conv_id are one conversation. Roles
    whose initial is not s, u or a are never kept as they are. Long texts are treated whole; an empty table gives
    no row; other columns are not read."""
    spark = rows.sparkSession
    flags = rows.select("conv_id", "turn", "role", "text", (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"),
                        (~F.col("text").rlike(rf"[.!?]{_SPACE}*\z")).alias("cut"), "n")
    sizes = rows.groupBy("conv_id").agg(F.sum("n").alias("__n")).filter(F.col("__n") > most_rows).select(F.col("conv_id").alias("__long"))
    long_ids = stored(sizes, "repair-long")
    short = flags.join(long_ids, F.col("conv_id").eqNullSafe(F.col("__long")), "left_anti").withColumn("again", F.lit(False))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    # the order of a task's rows is not the order of conversations, only that of rows within each
    result = (short.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(_whole(_target(_SCHEMA)), _SCHEMA))
    if long_ids.isEmpty():
        return result
    long = flags.join(long_ids, F.col("conv_id").eqNullSafe(F.col("__long")), "left_semi")
    # rows alike become one with their number, so that no key of the range partitioning is too heavy
    alike = stored(long.groupBy("conv_id", "turn", "role", "text", "blank", "cut").agg(F.sum("n").alias("n")), "repair-rows")
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    digest = F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256)
    keyed = alike.withColumn("__place", place).withColumn("__key", F.when(~F.col("blank"), digest))
    first = (keyed.filter("__key is not null").groupBy("conv_id", "__key").agg(F.min("__place").alias("__first"), F.count("*").alias("__k"))
             .filter("__k > 1").select(F.col("conv_id").alias("__conv"), F.col("__key").alias("__same"), "__first"))
    seen = keyed.join(first, F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("__key") == F.col("__same")), "left")
    own = seen.withColumn("again", F.coalesce(F.col("__first") < F.col("__place"), F.lit(False))).select(*_INPUT)
    segments = stored(own.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_segments(_target(_SEGMENT), most_rows), _SEGMENT),
                      "repair-segments")
    initials = F.aggregate("items", F.lit(""), lambda a, x: F.concat(a, F.repeat(F.when(x["role"] == "", F.lit(" ")).otherwise(F.substring(x["role"], 1, 1)), x["n"].cast("int"))))
    at = ["conv_id", "part", "seg"]
    plans = stored(segments.withColumn("initials", initials).drop("items").repartition("conv_id").sortWithinPartitions(*at)
                   .mapInArrow(_plans(_target(_PIECE)), _PIECE), "repair-plans")
    written_schema = "conv_id long, part int, seg long, text string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    held = segments.select("part", "seg", "items").join(plans, ["part", "seg"])
    written = stored(held.mapInArrow(_written(_target(written_schema)), written_schema), "repair-written")
    digests = written.repartition("conv_id").sortWithinPartitions(*at).mapInArrow(_digested(_target(_SCHEMA)), _SCHEMA)
    return result.unionByName(digests)


def _target(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string
    return to_arrow_schema(_parse_datatype_string(schema))


def damage_and_repair(conversations: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """``repair`` of the ``damaged`` conversations: a row for every conv_id of the table."""
    return repair(damaged(conversations), most_rows)
