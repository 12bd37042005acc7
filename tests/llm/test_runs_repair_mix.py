"""Periodic runs, conversation repair and source mixing against brute force."""

import hashlib
import itertools
import random
import re
import sys
import zlib

import numpy as np
import pytest

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

from tillsight.llm import conversation_repair as CR, period_runs as PR, source_mixing as SM  # noqa: E402

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# ---- periodic runs

def brute_runs(w):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(12, 2 * q):
                found.setdefault((s, i + q), q)         # the least period comes first
    return sorted((s, e - s, q) for (s, e), q in found.items())


def brute_digest(doc, text, plant=True):
    w = WORD.findall(text or "")
    n, h = len(w), zlib.crc32(str(doc).encode())
    if plant and doc is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = sorted(brute_runs(w), key=lambda r: (r[0], r[2]))
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    return (doc, len(runs), *best, None if not runs else 1000 * best[1] // best[2],
            sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in drop)))


def strange_words(rng):
    kind = rng.randrange(6)
    if kind == 0:
        a, b = "a", "ab"
        while len(b) < 150:
            a, b = b, b + a
        return list(b[:rng.randint(0, 150)])
    if kind == 1:
        return [str(bin(i).count("1") % 2) for i in range(rng.randint(1, 150))]
    if kind == 2:
        return [rng.choice("ab") for _ in range(rng.randint(0, 120))]
    out = []
    for _ in range(rng.randint(1, 5)):
        p = [rng.choice("abcdefgh") for _ in range(rng.randint(1, 12))]
        out += p * rng.randint(1, 9) + p[:rng.randint(0, len(p))] + [rng.choice("abcdefgh") for _ in range(rng.randint(0, 10))]
    return out


def test_period_runs(spark):
    rng = random.Random(3)
    texts = [(i, " ".join(strange_words(rng))) for i in range(300)]
    texts += [(1, None), (2, ""), (3, " \t\n"), (None, "x " * 40), (5, "é a b " * 9), (5, "é a b " * 9), (6, "\x0ba " * 12),
              (7, "once upon a time " * 30), (-8, "z " * 13)]
    texts += [(1000 + i, " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200))) for i in range(60)]    # some planted
    docs = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 AS start", "'x' AS runs").repartition(3)
    want = [brute_digest(i, t) for i, t in texts]
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, t in texts) > 20
    assert rows(PR.run_digests(docs)) == sorted(want, key=str)
    got = {(r.doc_id, r.collapsed): [tuple(x) for x in r.runs] for r in PR.periodic_runs(docs.filter("doc_id = 7 or doc_id is null")).collect()}
    assert got[None, "x"] == [(0, 40, 1)] and got[7, "once upon a time"] == [(0, 120, 4)]
    assert PR.run_digests(docs.limit(0)).count() == 0


@pytest.mark.parametrize("name, words", [
    ("one word", ["a"] * 40_000), ("period 10", [f"w{i % 10}" for i in range(40_000)]), ("distinct", [f"w{i}" for i in range(40_000)]),
    ("long period", [f"w{i % 15_000}" for i in range(40_000)])])
def test_long_texts(name, words):
    found, n, first, (start, end, period) = PR._runs_of([1], [" ".join(words)], False)
    want = {"one word": [(0, 40_000, 1)], "period 10": [(0, 40_000, 10)], "distinct": [], "long period": [(0, 40_000, 15_000)]}
    assert list(zip(start.tolist(), end.tolist(), period.tolist())) == want[name]


def test_grammar_derives_its_texts():
    """Each place that derives a nonterminal holds the words of its first place; one symbol a text is left."""
    rng = random.Random(8)
    ids = np.array([rng.randrange(3) for _ in range(400)] + [3 + rng.randrange(2) for _ in range(300)])
    text = np.repeat([0, 1], [400, 300])
    g = PR.repair(ids, text)
    for r, p in zip(g.rule.tolist(), g.place.tolist()):
        assert ids[g.lo[r]:g.hi[r]].tolist() == ids[p:p + g.hi[r] - g.lo[r]].tolist() and g.lo[r] < g.cut[r] < g.hi[r]
    assert len(g.rule) == 698 and len(g.lo) < 600          # n - 1 pairs a text; rules are shared


# ---- conversation repair

def brute_conversation(conv, given):
    """All paths, by a table of least (cost, audit, lines) over (row, state)."""
    damaged = []
    for turn, role, text in sorted(given, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or " ", r[2] or " ")):
        how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if how == 0:
            continue
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        role = "user" if how == 4 else role
        damaged += [(turn, role, text)] * (2 if how == 3 else 1)
    damaged.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    turns = {t for t, _, _ in damaged if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    faults = []
    for k, (_, role, text) in enumerate(damaged):
        seen = [c for c in text if c not in "\x20\x09\x0a\x0b\x0c\x0d"]
        faults.append("blank" if not seen else "duplicate" if any((role, text) == d[1:] for d in damaged[:k])
                      else "truncated" if seen[-1] not in ".!?" else "")
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(damaged))
    best = {0: (0, "", ())}
    for k in range(len(damaged) + 1):
        for _ in range(3):                              # insertions before the row
            for s in list(best):
                for role, word in (("u", "user"), ("a", "assistant")):
                    if role in CR.NEXT[s]:
                        t, new = CR.NEXT[s][role], (best[s][0] + 3, best[s][1] + "I", best[s][2] + (word + ":",))
                        best[t] = min(best.get(t, new), new, key=lambda x: x[:2])
        if k == len(damaged):
            break
        (_, role, text), fault, after = damaged[k], faults[k], {}

        def put(t, new):
            after[t] = min(after.get(t, new), new, key=lambda x: x[:2])

        for s, (c, a, lines) in best.items():
            put(s, (c + 4, a + "D", lines))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                if role[:1] in CR.NEXT[s]:
                    put(CR.NEXT[s][role[:1]], (c + more, a + "K", lines + (f"{role}:{text}",)))
                for r, word in (("u", "user"), ("a", "assistant")):
                    if r in CR.NEXT[s]:
                        put(CR.NEXT[s][r], (c + 3 + more, a + "R", lines + (f"{word}:{text}",)))
        best = after
    cost, audit, lines = min((best[s] for s in (0, 3) if s in best), key=lambda x: x[:2])
    return (conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha("\n".join(lines)))


def some_conversations(seed, n, longest):
    rng = random.Random(seed)
    out = []
    for conv in range(n):
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant"]) if rng.random() < .3 else ("user", "assistant")[turn % 2]
            role = "system" if turn == 0 and rng.random() < .4 else rng.choice(["tool", "", None, "sys", "ux"]) if rng.random() < .06 else role
            text = rng.choice(["Yes.", "No!", "why?", "cut off", "and then", "a. b ", "", " \t", None, f"text {rng.random()}.", "…", "ends.\n", "end.\u0085"])
            at = None if rng.random() < .05 else turn + rng.choice([0, 0, 0, 3])
            out += [(conv, at, role, text)] * (1 + (rng.random() < .05))
    return out


def by_conversation(given):
    found = {}
    for conv, *row in given:
        found.setdefault(conv, []).append(tuple(row))
    return found


CONVERSATION = "conv_id long, turn long, role string, text string"


def test_conversation_repair(spark):
    given = some_conversations(1, 400, 14) + [(None, 1, "user", "Hi."), (None, None, "assistant", "Ho."), (None, 2, None, None)]
    lone = [c for c in range(1000, 1400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    given += [(c, 0, "user", "x.") for c in lone]                           # nothing left after damage
    want = [brute_conversation(c, r) for c, r in by_conversation(given).items()]
    df = spark.createDataFrame(given, CONVERSATION).selectExpr("*", "7 AS n", "true AS blank", "0 AS cost").repartition(4)
    assert rows(CR.damage_and_repair(df)) == sorted(want, key=str)
    assert lone and (lone[0], 0, 0, 0, 0, 0, 0, "", sha("")) in rows(CR.damage_and_repair(df))
    assert CR.damage_and_repair(df.limit(0)).count() == 0


@pytest.mark.parametrize("most", [3, 17])
def test_long_conversations_in_segments(spark, most):
    """One conversation holds most rows, with heavy repeats, ties in turn and null turns; segments of few rows."""
    rng = random.Random(most)
    given = some_conversations(2, 30, 8)
    given += [(77, rng.choice([None, *range(150)]), rng.choice(["user", "assistant", "assistant", "system"]),
               rng.choice([f"t{rng.randrange(40)}.", "cut", "same text."])) for _ in range(300)]
    given += [(77, 33, "user", "again and again.")] * 60 + [(None, t, "user", f"{t}?") for t in range(25)]
    want = [brute_conversation(c, r) for c, r in by_conversation(given).items()]
    df = spark.createDataFrame(given, CONVERSATION).repartition(5)
    assert rows(CR.damage_and_repair(df, most_rows=most)) == sorted(want, key=str)


def test_search_finds_the_least_script():
    rng = random.Random(6)
    for _ in range(300):
        items = []
        for _ in range(rng.randint(0, 6)):
            gone = rng.random() < .2
            items.append(CR.Item(rng.choice(["user", "assistant", "system", "tool"]), "", rng.randint(1, 2) if gone else 1, gone, rng.random() < .3))
        edges = CR._edges(items)
        for begin in range(4):
            # Bellman-Ford over (cost, audit)
            best = {(0, begin): (0, "")}
            for _ in range(4 * len(items) + 8):
                for (i, s), (c, a) in list(best.items()):
                    for j, t, x, e in edges[0][i][s]:
                        best[j, t] = min(best.get((j, t), (c + x, a + e)), (c + x, a + e))
            for end in range(4):
                assert CR.search(edges, begin, (end,)) == best.get((len(items), end))


# ---- source mixing

def test_fit():
    rng = random.Random(5)
    for _ in range(200):
        sizes = rng.sample(range(1, 40), rng.randint(1, 5))
        counts = [rng.randint(0, 3) for _ in sizes]
        total = sum(s * c for s, c in zip(sizes, counts))
        budget = rng.random() * total
        sums = {sum(s * x for s, x in zip(sizes, xs)) for xs in itertools.product(*(range(c + 1) for c in counts))}
        got = SM.fit(sizes, counts, budget)
        assert all(0 <= x <= c for x, c in zip(got, counts))
        assert abs(sum(s * x for s, x in zip(sizes, got)) - budget) == min(abs(x - budget) for x in sums)
    # beyond the exact part each length gives its share, and the budget is still met to the word
    sizes, counts = list(range(1, 2000)), [rng.randint(1, 50) for _ in range(1999)]
    total = sum(s * c for s, c in zip(sizes, counts))
    for share in (0.1, 0.5, 0.9, 0.999):
        got = SM.fit(sizes, counts, int(total * share), exact=5000)
        assert sum(s * x for s, x in zip(sizes, got.tolist())) == int(total * share) and (got <= counts).all()
        assert abs(got[1000:].sum() / sum(counts[1000:]) - share) < 0.05
    assert SM.fit([10_000_019], [3], 20_000_000.5).tolist() == [2]


def brute_targets(sizes, weights=(5, 2, 1)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        open_ = [s for s in order if s not in full]
        target = {s: 3 * sizes[s] if s in full else left * w[s] / sum(w[x] for x in open_) for s in order}
        new = {s for s in open_ if target[s] > 3 * sizes[s]}
        if not new:
            return target
        full |= new


def test_targets_and_taken(spark):
    rng = random.Random(9)
    docs = []
    for k, (source, n) in enumerate([("web", 300), ("books", 8), ("", 5), (None, 40), ("éa", 30), ("Zed", 1), ("code", 60)]):
        docs += [(1000 * k + i, source, " ".join("w" * rng.randint(1, 3) for _ in range(rng.choice([0, 1, 5, 20, 77, 200])))) for i in range(n)]
    docs += [(1, "web", "same words here")] * 40 + [(None, "web", "no id"), (None, "web", "no id"), (5, "web", None), (6, None, " \t")]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string").selectExpr("*", "1 AS size", "2 AS key", "3 AS place")
    got = SM.mix_sources(df.repartition(5)).collect()
    sizes, per = {}, {}
    for _, s, t in docs:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    want = brute_targets(sizes)
    assert sorted((r.doc_id, r["size"]) for r in got if r.doc_id is not None) == sorted((i, len(WORD.findall(t or ""))) for i, _, t in docs if i is not None)
    assert sum(r.doc_id is None for r in got) == 2
    source = {sizes[s]: s for s in sizes}
    assert len(source) == len(sizes)
    for r in got:
        s = source[r.source_size]
        assert abs(r.target - want[s]) <= 1e-9 * max(1, want[s]) and 0 <= r.taken <= 3 * r["size"]
        per[s] = per.get(s, 0) + r.taken
    smallest = {s: min((len(WORD.findall(t or "")) or 10**9) for _, x, t in docs if x == s) for s in sizes}
    assert all(abs(per[s] - want[s]) <= max(0.5, smallest[s] / 2) for s in sizes), (per, want)
    assert rows(SM.mix_sources(df.repartition(2))) == sorted(map(tuple, got), key=str)          # reruns agree
    assert rows(SM.mix_sources(df, seed=1)) != sorted(map(tuple, got), key=str)
    assert SM.mix_sources(df.limit(0)).count() == 0
    none = SM.mix_sources(df.filter("text is null")).collect()
    assert [(r.doc_id, r.target, r.taken) for r in none] == [(5, 0.0, 0)]
