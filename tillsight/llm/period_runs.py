"""Runs of periodic words by grammar compression.

Inside a task the word ids of a batch of texts become one binary grammar: Re-Pair replaces the pairs
that repeat (per text, the most frequent of its neighbours first, all such pairs of a round at
once), then what no pair repeats in any more is paired by place until one symbol a text is left.
Each nonterminal's runs across its boundary are computed once, at its first place, carried over to all
places that derive it, and merged to maximal stretches. Common extensions are read from exact names
of the words' powers of two, so no hash can deceive. No shuffle; a task holds one batch, or one text
where that is longer."""

from __future__ import annotations

import hashlib
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import byte_slices

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LEAST = 12                  # words of a run, at least
BATCH_BYTES = 4 << 20       # bytes of texts whose grammar is built together
PAIRS = 1 << 20             # candidates looked at together
_SCHEMA = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, "
           "collapsed_sha256 string")
_SPANS = "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _names(key):
    """Dense names of ``key`` (from 0) and the count of each."""
    order = np.argsort(key)
    own = key[order]
    at = np.cumsum(np.r_[True, own[1:] != own[:-1]][:len(own)]) - 1
    name = np.empty(len(key), np.int64)
    name[order] = at
    return name, np.bincount(at)


@dataclass
class Grammar:
    """Nonterminals by number: at its first place the text [lo, hi) with the boundary ``cut``; and
    (rule, place) for each place in the texts that derives a nonterminal."""
    lo: np.ndarray
    cut: np.ndarray
    hi: np.ndarray
    rule: np.ndarray
    place: np.ndarray


def repair(ids: np.ndarray, text: np.ndarray) -> Grammar:
    """The grammar of word ids that are distinct between texts; ``text`` is each word's text, in order."""
    sym, at, own = ids.astype(np.int64), np.arange(len(ids)), text
    end = np.arange(1, len(ids) + 1)
    rules, places, made = [], [], 0
    top = int(sym.max()) + 1 if len(sym) else 0

    def replace(take, rule):
        """Put the symbol of ``rule`` (numbers from 0 of this round) for each pair that starts at ``take``."""
        nonlocal sym, at, end, own, made, top
        first = np.full(int(rule.max()) + 1, len(ids))
        np.minimum.at(first, rule, take)
        rules.append((at[first], end[first], end[first + 1]))
        places.append((rule + made, at[take]))
        sym[take] = top + rule
        end[take] = end[take + 1]
        made, top = made + len(first), top + len(first)
        keep = np.ones(len(sym), bool)
        keep[take + 1] = False
        sym, at, end, own = sym[keep], at[keep], end[keep], own[keep]

    while len(sym) > 1:
        # a pair repeats only if both its symbols do
        count = np.bincount(sym, minlength=top)
        many = count[sym] > 1
        may = np.flatnonzero(many[:-1] & many[1:] & (own[:-1] == own[1:]))
        if not len(may):
            break
        key = sym[may] * top + sym[may + 1]
        # of a pair that overlaps itself (aaa) every other place
        again = np.r_[False, (key[1:] == key[:-1]) & (may[1:] == may[:-1] + 1)]
        begin = np.maximum.accumulate(np.where(again, 0, np.arange(len(may))))
        odd = (np.arange(len(may)) - begin) % 2 == 1
        may, key = may[~odd], key[~odd]
        name, count = _names(key)
        good = count[name] > 1
        if not good.any():
            break
        may, name = may[good], name[good]
        # most frequent first; among equals mixed, so that no long chain of pairs waits for its neighbour
        mixed = (np.arange(len(count), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
        rank = np.empty(len(count), np.int64)
        rank[np.lexsort((mixed, count))] = np.arange(1, len(count) + 1)
        weight = np.zeros(len(sym) + 1, np.int64)
        weight[may] = rank[name]
        best = (weight[may] > weight[may - 1]) & (weight[may] > weight[may + 1])       # weight[-1] is 0
        take, rule = may[best], _names(name[best])[0]
        replace(take, rule)
    while len(sym) > 1:
        # what is left, by place: the first with the second of each text, and so on
        begin = np.maximum.accumulate(np.where(np.r_[True, own[1:] != own[:-1]], np.arange(len(own)), 0))
        take = np.flatnonzero(((np.arange(len(own)) - begin) % 2 == 0)[:-1] & (own[1:] == own[:-1]))
        if not len(take):
            break
        replace(take, np.arange(len(take)))
    join = lambda xs: np.concatenate(xs) if xs else np.zeros(0, np.int64)
    return Grammar(*(join([r[i] for r in rules]) for i in range(3)), *(join([p[i] for p in places]) for i in range(2)))


class Extensions:
    """Longest common extensions between places of one text, by names of stretches of 1, 2, 4 ... words.
    A stretch that nothing equals needs no name: its number is below 0 and its own."""

    def __init__(self, ids: np.ndarray, stop: np.ndarray):
        n = len(ids)
        self.names = [_single(ids)]
        size = 1
        while True:
            last = self.names[-1]
            may = np.flatnonzero((last >= 0) & (np.arange(n) + 2 * size <= stop))
            may = may[last[may + size] >= 0]
            name, count = _names(last[may] * (n + 1) + last[may + size])
            good = count[name] > 1
            if not good.any():
                break
            level = -1 - np.arange(n)
            level[may[good]] = name[good]
            self.names.append(level)
            size *= 2

    def forward(self, i, j, room):
        """How many words from ``i`` on equal those from ``j`` on, at most ``room``; i and j differ, so no level
        is taken twice."""
        done = np.zeros(len(i), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            go = np.flatnonzero(done + (1 << k) <= room)
            go = go[self.names[k][i[go] + done[go]] == self.names[k][j[go] + done[go]]]
            done[go] += 1 << k
        return done

    def backward(self, i, j, room):
        """How many words before ``i`` equal those before ``j``, at most ``room``."""
        done = np.zeros(len(i), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            go = np.flatnonzero(done + (1 << k) <= room)
            back = done[go] + (1 << k)
            go = go[self.names[k][i[go] - back] == self.names[k][j[go] - back]]
            done[go] += 1 << k
        return done


def _single(ids):
    """Names of the words; those that stand once get their own number below 0."""
    name, count = _names(ids)
    return np.where(count[name] > 1, name, -1 - np.arange(len(ids)))


def _ranges(lo, count):
    """(owner, lo[owner] + 0 .. count[owner] - 1) of each entry."""
    owner = np.repeat(np.arange(len(lo)), count)
    return owner, lo[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)


def boundary_runs(ids, stop, grammar: Grammar):
    """(rule, start, end, period), places relative to the rule's own start: the stretches of LEAST words and two
    periods, at least, that hold the rule's boundary or come from a candidate there.

    Such a stretch has q matches of words q apart on one side of the boundary, so that three words there stand again
    q words on or back: the candidates are the places in the rule's text of the three words after the
    boundary and of the three before it."""
    ext = Extensions(ids, stop)
    n = len(ids)
    wide = np.flatnonzero(grammar.hi - grammar.lo >= LEAST)
    if not len(wide):
        return (np.zeros(0, np.int64),) * 4
    # names of three words, where they stand twice in the text
    three = -1 - np.arange(n)
    if len(ext.names) > 1:
        may = np.flatnonzero((ext.names[1][:-1] >= 0) & (ext.names[1][1:] >= 0) & (np.arange(n - 1) + 3 <= stop[:-1]))
        name, _ = _names(ext.names[1][may] * (n + 1) + ext.names[1][may + 1])
        three[may] = name
    listed = np.flatnonzero(three >= 0)
    posting = np.sort(three[listed] * n + listed)
    out = []
    for shift in (0, -3):
        at = grammar.cut[wide] + shift
        fit = (at >= grammar.lo[wide]) & (at + 3 <= grammar.hi[wide])
        rule, at = wide[fit], at[fit]
        name = three[at]
        rule, at, name = rule[name >= 0], at[name >= 0], name[name >= 0]
        lo = np.searchsorted(posting, name * n + grammar.lo[rule])
        count = np.searchsorted(posting, name * n + grammar.hi[rule] - 3, side="right") - lo
        for a, b in _pieces(count):
            owner, where = _ranges(lo[a:b], count[a:b])
            r, p, q = rule[a:b][owner], at[a:b][owner], posting[where] % n
            far = p != q
            out.append(_extend(ext, grammar, r[far], np.minimum(p, q)[far], np.maximum(p, q)[far]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 4


def _pieces(count):
    """Consecutive (a, b) whose counts make up PAIRS or so together, one entry at least."""
    total = np.cumsum(count)
    a = 0
    while a < len(count):
        before = total[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(total, before + PAIRS, side="right")))
        yield a, b
        a = b


def _extend(ext, grammar, rule, i, j):
    q = j - i
    lo, hi = grammar.lo[rule], grammar.hi[rule]
    start = i - ext.backward(i, j, i - lo)
    end = j + ext.forward(i, j, hi - j)
    good = end - start >= np.maximum(LEAST, 2 * q)
    rule, start, end, q = rule[good], start[good], end[good], q[good]
    return rule, start - grammar.lo[rule], end - grammar.lo[rule], q


def find_runs(ids: np.ndarray, text: np.ndarray):
    """(start, end, period) of all runs, by start and period, places counted over all texts together."""
    empty = (np.zeros(0, np.int64),) * 3
    if not len(ids):
        return empty
    last = np.r_[text[1:] != text[:-1], True]
    ends = np.flatnonzero(last) + 1
    stop = ends[np.cumsum(np.r_[False, last[:-1]])]
    grammar = repair(ids, text)
    rule, start, end, period = boundary_runs(ids, stop, grammar)
    if not len(rule):
        return empty
    # of one rule the same stretch may come from several candidates
    order = np.lexsort((period, end, start, rule))
    rule, start, end, period = rule[order], start[order], end[order], period[order]
    new = np.r_[True, (rule[1:] != rule[:-1]) | (start[1:] != start[:-1]) | (end[1:] != end[:-1]) | (period[1:] != period[:-1])]
    rule, start, end, period = rule[new], start[new], end[new], period[new]
    order = np.argsort(grammar.rule, kind="stable")
    lo = np.searchsorted(grammar.rule[order], rule)
    count = np.searchsorted(grammar.rule[order], rule, side="right") - lo
    owner, where = _ranges(lo, count)
    base = grammar.place[order][where]
    start, end, period = start[owner] + base, end[owner] + base, period[owner]
    # a stretch that ends at its rule's edge lies inside the whole one, found where a rule holds it
    order = np.lexsort((-end, start, period))
    start, end, period = start[order], end[order], period[order]
    reach = np.maximum.accumulate(end + period * (len(ids) + 1))
    keep = np.r_[True, (end + period * (len(ids) + 1))[1:] > reach[:-1]]
    start, end, period = start[keep], end[keep], period[keep]
    # of one stretch the least period
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    keep = np.r_[True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])]
    start, end, period = start[keep], end[keep], period[keep]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def repeated_index(doc_id: int | None, n: int) -> np.ndarray | None:
    """The word numbers of a text of ``n`` words with a planted period, or None where it has none."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a, i = g % n, np.arange(n)
    p = 1 + (n - a) // (3 + g % 8)
    return np.where(i < a, i, a + (i - a) % p)


def _runs_of(ids, texts, plant):
    """(words, n, first word, runs) of a batch: the words of all texts, in order, and all runs."""
    found = [WORD.findall(t) for t in texts]
    if plant:
        for k, (doc, words) in enumerate(zip(ids, found)):
            index = repeated_index(doc, len(words))
            if index is not None:
                found[k] = [words[i] for i in index.tolist()]
    n = np.array([len(w) for w in found], np.int64)
    text = np.repeat(np.arange(len(n)), n)
    code, numbers = {}, []
    for words in found:
        numbers += [code.setdefault(w, len(code)) for w in words]
    own = np.array(numbers, np.int64) + text * max(len(code), 1)      # distinct between texts
    return found, n, np.cumsum(n) - n, find_runs(_names(own)[0], text)


def _collapsed(words, runs):
    """The words without those that repeat the first period of a run."""
    if not runs:
        return " ".join(words)
    drop = np.zeros(len(words) + 1, np.int64)
    for s, e, q in runs:
        drop[s + q] += 1
        drop[e] -= 1
    return " ".join([w for w, d in zip(words, np.cumsum(drop).tolist()) if not d])


def _batches(docs, id_col, text_col, plant, schema, row):
    def run(batches):
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for a, b in byte_slices(texts, list(map(len, texts)), BATCH_BYTES):
                found, n, first, (start, end, period) = _runs_of(ids[a:b], texts[a:b], plant)
                lo = np.searchsorted(start, first).tolist()
                hi = np.searchsorted(start, first + n).tolist()
                out = []
                for k, words in enumerate(found):
                    s = slice(lo[k], hi[k]) if n[k] else slice(0, 0)
                    own = list(zip((start[s] - first[k]).tolist(), (end[s] - first[k]).tolist(), period[s].tolist()))
                    out.append(row(ids[a + k], words, own))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _TYPES[schema])], names=_NAMES[schema])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return own.mapInArrow(run, schema)


_NAMES = {_SCHEMA: [c.split()[0] for c in _SCHEMA.split(", ")], _SPANS: ["doc_id", "runs", "collapsed"]}
_TYPES = {_SCHEMA: [pa.int64()] * 6 + [pa.string()] * 2,
          _SPANS: [pa.int64(), pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])), pa.string()]}


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, runs (array of start, length, period, in words, by start and period) and collapsed (the text's words
    without the repeats, joined by one space) of every text.

    A run is a stretch of LEAST words and two periods, at least, that no neighbouring word extends; its period is the
    smallest. Null, empty and blank texts have no run and an empty collapsed text; repeated rows and null ids stay; an
    empty table gives no row; very long texts are treated whole, in one task; other columns are not read."""
    def row(doc, words, runs):
        return doc, [{"start": s, "length": e - s, "period": q} for s, e, q in runs], _collapsed(words, runs)
    return _batches(docs, id_col, text_col, False, _SPANS, row)


def run_digests(docs: DataFrame, plant: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same as digests: n_runs; start, length, period and exponent_milli (1000 * length / period, rounded down)
    of the longest run (ties: least start, then period; four nulls without a run); runs_sha256 of the
    lines ``start,length,period`` and collapsed_sha256 of the collapsed text.

    ``plant`` first makes one text of ten periodic, by the CRC of its id (see ``repeated_index``); a text without an id stays
    as it is. Other cases as in ``periodic_runs``."""
    def row(doc, words, runs):
        lines = "".join(f"{s},{e - s},{q}\n" for s, e, q in runs)
        best = (None,) * 4
        if runs:
            s, e, q = min(runs, key=lambda r: (r[0] - r[1], r[0], r[2]))
            best = (s, e - s, q, 1000 * (e - s) // q)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        return doc, len(runs), *best, sha(lines), sha(_collapsed(words, runs))
    return _batches(docs, id_col, text_col, plant, _SCHEMA, row)
