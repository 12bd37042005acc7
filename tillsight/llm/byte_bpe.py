"""Byte-level BPE encoding and decoding with numpy matrices.

Texts stay in their partition (no shuffle). Inside a task the pattern's matches are gathered over
some megabytes of text, each distinct match is merged once, and matches of similar length share a
padded matrix: every round, each row merges its leftmost pair of least rank.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import byte_slices, vocabulary_bytes, whole_texts

CHUNK_BYTES = 4 << 20       # text gathered before the distinct matches are merged
LENGTHS = (4, 8, 12, 16, 24, 32, 64, 128)   # widths of the padded matrices; longer matches use a heap
KEPT_MATCHES = 400_000      # ids kept between chunks for at most so many distinct matches
_NONE = np.int64(1) << 40   # rank of a pair that does not merge
_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class ByteBpe:
    """Encoder and decoder over ranks given as lines "base64(token) rank"."""

    def __init__(self, data: bytes, pattern: str):
        import regex
        self.pattern = regex.compile(pattern)
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}
        self.tokens = {r: t for t, r in self.ranks.items()}
        self.byte_rank = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        self.base = max(self.tokens) + 1
        self._build_pairs()
        self.width = [next(w for w in LENGTHS if n <= w) for n in range(LENGTHS[-1] + 1)]
        self.decimal = {r: str(r) for r in self.tokens}
        self.bytes_of = {str(r): t for r, t in self.tokens.items()}
        self.single = {t: str(r) for t, r in self.ranks.items()}
        self.known: dict[str, str] = {}                       # match -> its ids in decimal, joined by one space

    def _build_pairs(self):
        """Every way to write a token as two tokens, in an open hash table: pair key -> rank."""
        keys, ranks = [], []
        for tok, r in self.ranks.items():
            for i in range(1, len(tok)):
                a, b = self.ranks.get(tok[:i]), self.ranks.get(tok[i:])
                if a is not None and b is not None:
                    keys.append(a * self.base + b)
                    ranks.append(r)
        self.pair_rank = dict(zip(keys, ranks))
        self.shift = 64 - max(4, int(len(keys) * 4).bit_length())
        size = 1 << (64 - self.shift)
        self.slot_key, self.slot_rank = np.full(size, -1, np.int64), np.full(size, _NONE, np.int64)
        keys, ranks = np.array(keys, np.int64), np.array(ranks, np.int64)
        at, self.probes = self._slot(keys), 0
        while len(keys):        # one probe step a pass: the first of each free slot gets it, the rest move on
            free = self.slot_key[at] == -1
            first = np.zeros(len(keys), bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = free & first
            self.slot_key[at[put]], self.slot_rank[at[put]] = keys[put], ranks[put]
            keys, ranks, at = keys[~put], ranks[~put], (at[~put] + 1) & (size - 1)
            self.probes += 1

    def _slot(self, keys):
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(self.shift)).astype(np.int64)

    def _lookup(self, keys):
        """Ranks of pair keys; _NONE where the pair is no token."""
        at = self._slot(keys)
        got = self.slot_key[at]
        out = np.where(got == keys, self.slot_rank[at], _NONE)
        open_ = np.flatnonzero((got != keys) & (got != -1))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & (len(self.slot_key) - 1)
            got = self.slot_key[at[open_]]
            hit = got == keys[open_]
            out[open_[hit]] = self.slot_rank[at[open_[hit]]]
            open_ = open_[~hit & (got != -1)]
        return out

    def _merge_rows(self, words: list[bytes], width: int) -> list[str]:
        n = len(words)
        lens = np.fromiter(map(len, words), np.int64, n)
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        ids = self.byte_rank[raw]
        cols = np.arange(width)
        rank = np.full((n, width), _NONE)
        inside = cols[None, :-1] + 1 < lens[:, None]
        rank[:, :-1][inside] = self._lookup((ids[:, :-1] * self.base + ids[:, 1:])[inside])
        out: list = [None] * n
        rows, decimal = np.arange(n), self.decimal
        while len(rows):
            where = rank.argmin(axis=1)                       # the first, so the leftmost, of least rank
            least = rank[np.arange(len(rows)), where]
            done = least == _NONE
            if done.any():
                for r, m, row in zip(rows[done].tolist(), lens[done].tolist(), ids[done].tolist()):
                    out[r] = " ".join([decimal[i] for i in row[:m]])
                live = ~done
                rows, ids, rank, lens, where, least = rows[live], ids[live], rank[live], lens[live], where[live], least[live]
                if not len(rows):
                    break
            # the merged token takes the pair's place and all behind it move one to the left
            src = cols[None, :] + (cols[None, :] > where[:, None])
            np.minimum(src, width - 1, out=src)
            ids, rank = np.take_along_axis(ids, src, 1), np.take_along_axis(rank, src, 1)
            k = np.arange(len(rows))
            ids[k, where] = least
            lens = lens - 1
            rank[:, -1] = _NONE
            left, right = np.flatnonzero(where > 0), np.flatnonzero(where + 1 < lens)
            rank[k, where] = _NONE
            w = where[left]
            rank[left, w - 1] = self._lookup(ids[left, w - 1] * self.base + ids[left, w])
            w = where[right]
            rank[right, w] = self._lookup(ids[right, w] * self.base + ids[right, w + 1])
        return out

    def _merge_long(self, word: bytes) -> str:
        """The same rule for one long match: a heap of (rank, place) over a linked list."""
        ids = [int(x) for x in self.byte_rank[np.frombuffer(word, np.uint8)]]
        n = len(ids)
        nxt, prv = list(range(1, n)) + [-1], list(range(-1, n - 1))
        get, base = self.pair_rank.get, self.base
        heap = [(r, i) for i in range(n - 1) if (r := get(ids[i] * base + ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = nxt[i] if ids[i] >= 0 else -1
            if j < 0 or get(ids[i] * base + ids[j]) != r:
                continue                                      # one of the two was merged meanwhile
            ids[i], ids[j] = r, -1
            nxt[i] = nxt[j]
            if nxt[j] >= 0:
                prv[nxt[j]] = i
                if (x := get(r * base + ids[nxt[i]])) is not None:
                    heapq.heappush(heap, (x, i))
            if prv[i] >= 0 and (x := get(ids[prv[i]] * base + r)) is not None:
                heapq.heappush(heap, (x, prv[i]))
        return " ".join(str(x) for x in ids if x >= 0)

    def _learn(self, matches):
        """Ids of matches not yet known, by matrices of similar length."""
        buckets: dict[int, tuple[list, list]] = {w: ([], []) for w in (*LENGTHS, 0)}
        known, single, width = self.known, self.single, self.width
        for m in matches:
            raw = m.encode()
            if (r := single.get(raw)) is not None:
                known[m] = r
            else:
                names, raws = buckets[width[len(raw)] if len(raw) < len(width) else 0]
                names.append(m)
                raws.append(raw)
        for w, (names, raws) in buckets.items():
            if w:
                step = max(1, (1 << 20) // w)
                for a in range(0, len(names), step):
                    known.update(zip(names[a:a + step], self._merge_rows(raws[a:a + step], w)))
            else:
                known.update(zip(names, map(self._merge_long, raws)))

    def encode_decimal(self, texts: list[str]) -> list[str]:
        """Each text's ids in decimal, joined by one space."""
        found = [self.pattern.findall(t) for t in texts]
        new = set().union(*found)
        if len(self.known) + len(new) > KEPT_MATCHES:
            self.known = {}
        self._learn(new - self.known.keys())
        return [" ".join(map(self.known.__getitem__, f)) for f in found]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [list(map(int, x.split())) for x in self.encode_decimal(texts)]

    def decode(self, ids) -> bytes:
        """Bytes of ids given in decimal."""
        return b"".join(map(self.bytes_of.__getitem__, ids))


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array of ranks), decoded (bytes) of every whole text, as ``byte_bpe_frame`` with
    full outputs; null and empty texts give no ids and empty bytes."""
    return _frame(docs, ranks_path, pattern, False)


def byte_bpe_frame(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of decimal ids joined by one space), decoded_sha256 (of the
    bytes that the ids decode to) of every whole text.

    Null and empty texts have 0 tokens and the digests of empty input; repeated rows stay; an
    empty table gives no row; matches of any length are encoded whole; other columns are not read."""
    return _frame(docs, ranks_path, pattern, True)


def _frame(docs: DataFrame, ranks_path: str, pattern: str, digests: bool) -> DataFrame:
    ranks = docs.sparkSession.sparkContext.broadcast(vocabulary_bytes(ranks_path))

    def run(batches):
        bpe = ByteBpe(ranks.value, pattern)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in byte_slices(texts, map(len, texts), CHUNK_BYTES):
                joined = bpe.encode_decimal(texts[a:b])
                if digests:
                    rows = []
                    for x in joined:
                        ids = x.split()
                        rows.append((len(ids), hashlib.sha256(x.encode()).hexdigest(),
                                     hashlib.sha256(bpe.decode(ids)).hexdigest()))
                    cols = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string()))]
                    names = ["n_tokens", "ids_sha256", "decoded_sha256"]
                else:
                    ids = [x.split() for x in joined]
                    cols = [pa.array([list(map(int, x)) for x in ids], pa.list_(pa.int32())),
                            pa.array([bpe.decode(x) for x in ids], pa.binary())]
                    names = ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *cols], ["doc_id", *names])

    schema = _SCHEMA if digests else "doc_id long, ids array<int>, decoded binary"
    return whole_texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
