"""Toxicity by a support vector machine over a gap-weighted subsequence kernel.

Words are compared by their common subsequences, where each letter in between costs a factor, so an
insult stays near its landmark when letters are inserted or marks are strewn in. Nyström landmarks
turn the kernel into short vectors; a linear machine is trained on labelled sentences, each
represented by its words; of a toxic text's sentences only those with marked words count, because a
toxic text is toxic for some of its sentences. A document scores as its worst word.
"""

from __future__ import annotations

import multiprocessing
import pickle
import re
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterable
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import in_parts, whole_texts

SAMPLE = 1500           # labelled documents of each class that the machine is trained on, at most
LANDMARKS = 32          # a quarter of them are common words of clean texts
ORDER = 3               # length of the subsequences compared
DECAY = 0.6             # factor for each place that a subsequence spans
WORD = 8                # letters of a unit; longer words give overlapping units
THRESHOLD = 0.7
KEPT_WORDS = 100_000     # words whose margins a task remembers
_TEXTS = 200            # texts whose words are looked at together
_SIZE = 1 << 10         # units compared with the landmarks in one matrix
_SWAPPED = str.maketrans("013457@$!", "oieastasi")
_NOT_LETTERS = re.compile(r"[\W_]+")
_SPACED = re.compile(r"(?<!\S)(?:\w[^\w\s]*\s+){2,}\w(?!\w)")


def units(word: str) -> list[str]:
    """A lower-cased word as the strings that are compared: look-alike digits read as letters, marks
    left out, long ones in overlapping windows."""
    w = word if word.isalpha() else _NOT_LETTERS.sub("", word.translate(_SWAPPED))
    if len(w) <= WORD:
        return [w] if len(w) >= ORDER else []
    return [w[i:i + WORD] for i in range(0, len(w) - WORD, 2)] + [w[-WORD:]]


def text_words(text: str) -> set[str]:
    """Distinct words; single letters set apart by blanks also count as one word."""
    low = text.lower()
    found = set(low.split())
    found.update("".join(m.group().split()) for m in _SPACED.finditer(low))
    return found


# places of the letters of a subsequence in a unit of so many letters, and its span in places
_PLACES = {n: np.array(list(combinations(range(n), ORDER))) for n in range(ORDER, WORD + 1)}
_SPANS = {n: p[:, -1] - p[:, 0] + 1 for n, p in _PLACES.items()}
_WEIGHTS = np.array([0.0, *(DECAY ** n for n in range(1, WORD + 1))], np.float32)     # by span; 0 is no subsequence
_DIMENSIONS = 64 ** ORDER


def _codes(strings: list[str]) -> np.ndarray:
    """A row for each unit, as long as the longest one: a-z are 1 to 26, all other characters share 37
    more symbols; 0 is no letter."""
    width = max(ORDER, max(map(len, strings), default=ORDER))
    raw = np.frombuffer("".join(s.ljust(width, "\0") for s in strings).encode("utf-32-le", "surrogatepass"), np.uint32)
    raw = raw.reshape(len(strings), width).astype(np.int32)
    return np.where((raw >= 97) & (raw <= 122), raw - 96, np.where(raw == 0, 0, 27 + raw % 37))


def subsequence_weights(codes: np.ndarray):
    """(subsequence numbers, weights, norms) of units: the kernel of two units is the sum over common
    subsequences of the products of their weights, so this is its feature map, written sparsely."""
    places, spans = _PLACES[codes.shape[1]], _SPANS[codes.shape[1]].astype(np.int32)
    number = codes[:, places[:, 0]]
    for i in range(1, ORDER):
        number = number * 64 + codes[:, places[:, i]]
    # letters stand before the filling, so a subsequence is whole if its last letter is one
    key = number * 16 + np.where(codes[:, places[:, -1]] > 0, spans, 0)
    key.sort(axis=1)
    n, w = key >> 4, _WEIGHTS[key & 15]
    # norm: equal subsequences of a unit add up before they are squared
    first = np.ones(n.shape, bool)
    first[:, 1:] = n[:, 1:] != n[:, :-1]
    sums = np.add.reduceat(w.ravel().astype(np.float64), np.flatnonzero(first.ravel())) if len(n) else np.empty(0)
    rows = np.repeat(np.arange(len(n)), first.sum(axis=1))
    norm = np.sqrt(np.bincount(rows, sums ** 2, minlength=len(n)))
    return n, w, np.maximum(norm, 1e-9)


class SubsequenceMachine:
    """Landmarks, the map to Nyström features, the linear machine and the scale of its margins."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        number, weight, norm = subsequence_weights(_codes(landmarks))
        self.dense = np.zeros((_DIMENSIONS, len(landmarks)), np.float32)
        np.add.at(self.dense, (number, np.arange(len(landmarks))[:, None]), weight / norm[:, None])
        self.used = np.unique(number)       # the few subsequences that any landmark has
        value, vector = np.linalg.eigh(self.similarities(landmarks).astype(np.float64))
        keep = value > 1e-3
        self.to_features = vector[:, keep] / np.sqrt(value[keep])
        self.slope, self.shift = 4.0, 0.0
        self.margins: dict[str, float] = {}
        self.set_weights(np.zeros(int(keep.sum())), 0.0)

    def set_weights(self, weight: np.ndarray, bias: float):
        """The machine as one weight for each subsequence: landmarks are no longer needed to score."""
        self.weight, self.bias, self.margins = weight, bias, {}
        self.scorer = np.zeros(_DIMENSIONS, np.float32)
        self.scorer[self.used] = self.dense[self.used] @ (self.to_features @ weight)

    def similarities(self, strings: list[str]) -> np.ndarray:
        """Normalised kernel of each unit with each landmark."""
        out = np.zeros((len(strings), self.dense.shape[1]), np.float32)
        for a in range(0, len(strings), _SIZE):
            number, weight, norm = subsequence_weights(_codes(strings[a:a + _SIZE]))
            out[a:a + _SIZE] = np.einsum("us,usl->ul", weight / norm[:, None], self.dense[number])
        return out

    def features(self, strings: list[str]) -> np.ndarray:
        return self.similarities(strings).astype(np.float64) @ self.to_features

    def unit_margins(self, strings: list[str]) -> np.ndarray:
        out = np.empty(len(strings))
        for a in range(0, len(strings), 4 * _SIZE):
            number, weight, norm = subsequence_weights(_codes(strings[a:a + 4 * _SIZE]))
            out[a:a + 4 * _SIZE] = (weight * self.scorer[number]).sum(axis=1) / norm
        return out + self.bias

    def forget_training(self):
        """Leaves only what scoring needs, so that little is broadcast."""
        self.dense, self.used, self.margins = None, None, {}

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 30, penalty: float = 0.001):
        """Linear machine by dual coordinate descent; ``weight`` is what each example's slack costs."""
        n = len(x)
        x = np.hstack([x, np.ones((n, 1))])
        cost = weight / penalty
        alpha, w, q = np.zeros(n), np.zeros(x.shape[1]), (x ** 2).sum(axis=1)
        rng = np.random.default_rng(3)
        for _ in range(rounds):
            for i in rng.permutation(n):
                g = y[i] * (x[i] @ w) - 1
                new = min(max(alpha[i] - g / q[i], 0.0), cost[i])
                if new != alpha[i]:
                    w += (new - alpha[i]) * y[i] * x[i]
                    alpha[i] = new
        self.set_weights(w[:-1], float(w[-1]))

    def margin(self, words: set[str]) -> float:
        """The worst margin among the words."""
        return max(map(self.margins.__getitem__, words), default=-2.0)

    def learn_words(self, words: set[str]):
        new = list(words.difference(self.margins))
        if len(self.margins) + len(new) > KEPT_WORDS:
            self.margins, new = {}, list(words)
        own = [units(w) for w in new]
        every = sorted(set().union(*own), key=len)      # units of one length share a narrow matrix
        score = dict(zip(every, self.unit_margins(every).tolist()))
        self.margins.update((w, max(map(score.__getitem__, us), default=-2.0)) for w, us in zip(new, own))

    def score(self, margin: float) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30))))


def _word_pieces(word: str) -> set[str]:
    return {u[i:i + n] for u in units(word) for n in (4, 5, 6) for i in range(len(u) - n + 1)}


def _numbered_pieces(words: Iterable[str]) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    """Number of each piece, the numbers of every word's pieces in one array, and where the words start in it."""
    number: dict[str, int] = {}
    held, starts = array("i"), array("q", [0])
    for w in words:
        held.extend([number.setdefault(p, len(number)) for p in _word_pieces(w)])
        starts.append(len(held))
    return number, np.array(held, np.int32), np.array(starts)


def _sentence_words(texts: Iterable[str]) -> set[str]:
    found: set[str] = set()
    for text in texts:
        for sentence in re.split(r"[.!?\n]+", text):
            found |= text_words(sentence)
    return found


def train(sample: list[tuple[str, int]]) -> SubsequenceMachine | None:
    """The machine for labelled texts (text, 0 or 1), or None unless both classes are there."""
    docs = [(text, label) for text, label in sample if label in (0, 1)]
    if len({label for _, label in docs}) < 2:
        return None
    # texts are held as numbers of their words, words as numbers of their pieces: a string is kept once
    number: dict[str, int] = {}
    texts = [np.array([number.setdefault(w, len(number)) for w in text_words(t)], np.int32) for t, _ in docs]
    toxic, clean = ([t for t, (_, own) in zip(texts, docs) if own == label] for label in (1, 0))
    pieces, held, starts = _numbered_pieces(number)

    def texts_with_piece(texts):
        n = np.zeros(len(pieces), np.int64)
        for t in texts:
            if len(t):
                n[np.unique(np.concatenate([held[starts[w]:starts[w + 1]] for w in t]))] += 1
        return n
    # pieces of words that mark toxic texts, by how much more of them hold the piece
    have, lack = texts_with_piece(toxic), texts_with_piece(clean)
    # a piece counts if toxic texts hold it 50 times as often as clean ones, and so often that not one
    # of all the pieces would do so by chance, nor by one text with many copies
    share = len(toxic) / len(docs)
    least = max(0.03 * len(toxic), np.log(20 * max(1, len(pieces))) / np.log(1 / share))
    marks_toxic = (have >= least) & (lack * len(toxic) * 50 <= have * len(clean))
    names = {i: p for p, i in pieces.items() if marks_toxic[i]}
    marks = set(names.values())
    marked_in: dict[int, set[str]] = defaultdict(set)       # by word
    at = np.flatnonzero(marks_toxic[held])
    for w, i in zip((np.searchsorted(starts, at, side="right") - 1).tolist(), held[at].tolist()):
        marked_in[w].add(names[i])
    del pieces, held, starts, have, lack
    # landmarks: piece by piece the most frequent one in words that no landmark explains yet
    open_ = [[marked_in[w] for w in t.tolist() if w in marked_in] for t in toxic]
    landmarks: list[str] = []
    while len(landmarks) < LANDMARKS * 3 // 4:
        have = Counter(p for words in open_ for p in set().union(*words))
        best = max(have, key=lambda p: (have[p] * (0.6 + 0.1 * len(p)), p), default=None)
        if best is None or have[best] < least:
            break
        landmarks.append(best)
        open_ = [[own for own in words if best not in own] for words in open_]
    if not landmarks:
        return None
    # the rest: common clean words, so that the features can tell them apart
    usual = Counter()
    for w, n in zip(number, np.bincount(np.concatenate(clean), minlength=len(number)).tolist()):
        for u in units(w) if n else ():
            usual[u] += n
    common = sorted(usual, key=lambda u: (-usual[u], u))
    landmarks += list(islice((u for u in common if not any(p in u for p in landmarks)), LANDMARKS - len(landmarks)))
    del common
    machine = SubsequenceMachine(landmarks)

    # sentences of toxic texts that hold a marked word, by those words; a word that clean texts use is
    # no reason. Sentences of clean texts count by all their words, the ones that look worst first
    marked = [p for p in landmarks if p in marks]
    positives = sorted({u for w in _sentence_words(t for t, label in docs if label) for u in units(w)
                        if usual[u] == 0 and any(p in u for p in marked)})
    if not positives:
        return None
    negatives = sorted({u for w in _sentence_words(t for t, label in docs if not label) for u in units(w)}, key=lambda u: (-usual[u], u))
    good, vectors = machine.features(positives), machine.features(negatives[:2000])
    # every marked piece weighs the same, however many words it is part of, and so do the classes
    kind = [next(p for p in marked if p in u) for u in positives]
    alike = Counter(kind)
    weight = np.array([1 / (len(alike) * alike[k]) for k in kind])
    for _ in range(4):
        machine.fit(np.vstack([good, vectors]), np.concatenate([np.ones(len(good)), -np.ones(len(vectors))]),
                    np.concatenate([weight, np.full(len(vectors), 1 / len(vectors))]) / 2)
        worst = np.argsort(-machine.unit_margins(negatives), kind="stable")[:1000]
        vectors = np.vstack([vectors, machine.features([negatives[i] for i in worst])])
    # margins to scores: halfway between what the classes reach lies at the threshold
    del usual, negatives
    machine.learn_words(set(number))
    margin = np.array([machine.margins[w] for w in number])
    worst = [np.array([margin[t].max() if len(t) else -2.0 for t in texts]) for texts in (clean, toxic)]
    cut = _best_cut(*worst)
    machine.shift = float(np.log(THRESHOLD / (1 - THRESHOLD)) - machine.slope * cut)
    machine.forget_training()
    return machine


def _best_cut(clean: np.ndarray, toxic: np.ndarray) -> float:
    """The cut between margins with the fewest errors, in the middle of its gap."""
    cuts = np.unique(np.concatenate([clean, toxic]))
    cuts = np.concatenate([[cuts[0] - 1], (cuts[1:] + cuts[:-1]) / 2, [cuts[-1] + 1]])
    wrong = [(clean >= c).mean() * 2 + (toxic < c).mean() for c in cuts]
    best = np.flatnonzero(np.array(wrong) <= min(wrong) + 1e-12)
    return float(cuts[best[len(best) // 2]])


def training_sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """(doc_id, text, toxic) of at most ``most`` labelled texts of each class, by a hash of the id, without the held-out
    ids (crc32 of the id as text, modulo 3, is 1). A document labelled twice is toxic if any label says so; of several
    texts under one id the least stands for it."""
    named = (labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
             .filter(F.crc32(F.col("doc_id").cast("string")) % 3 != 1))
    first = [named.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for c in (0, 1)]
    chosen = F.broadcast(first[0].unionByName(first[1]))        # 2 * most rows of two numbers at most
    return whole_texts(docs).join(chosen, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("toxic").alias("toxic"))


def _in_child(work) -> bytes:
    """The bytes that ``work`` returns, made in a child process: what it takes of memory is given back at its end,
    while a task's own process would keep it for the tasks after."""
    context = multiprocessing.get_context("fork")
    here, there = context.Pipe(duplex=False)
    child = context.Process(target=lambda: there.send_bytes(work()))
    child.start()
    there.close()
    try:
        return here.recv_bytes()
    except EOFError:
        raise RuntimeError("the machine could not be trained; the child process wrote why") from None
    finally:
        child.join()


def learned(docs: DataFrame, labels: DataFrame) -> SubsequenceMachine | None:
    """The machine trained on the sample. The bounded sample goes to one task, not to the driver: only the finished
    machine, one weight for each subsequence, comes back. A lost executor has the task run again."""
    def run(batches):
        sample = [row for b in batches for row in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist())]
        machine = _in_child(lambda: pickle.dumps(train([(text, int(label)) for text, label in sample])))
        yield pa.RecordBatch.from_arrays([pa.array([machine], pa.binary())], ["machine"])

    rows = training_sample(docs, labels).repartition(1).sortWithinPartitions("doc_id").select("text", "toxic")
    found = rows.mapInArrow(run, "machine binary").first()
    return pickle.loads(found[0]) if found else None


def _scores(machine: SubsequenceMachine | None, texts: pa.Array) -> list[float]:
    """Scores of a column of texts, read a few at a time."""
    scores = [0.0] * len(texts)
    if machine is not None:
        for a in range(0, len(texts), _TEXTS):
            words = [text_words(t or "") for t in texts.slice(a, _TEXTS).to_pylist()]
            machine.learn_words(set().union(*words))
            scores[a:a + _TEXTS] = [machine.score(machine.margin(w)) for w in words]
    return scores


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any other columns, all returned) that ``score_toxicity``
    does not predict as toxic; rows stay where they lie, nothing is shuffled. Null and empty texts stay."""
    held = docs.sparkSession.sparkContext.broadcast(learned(docs, labels))

    def run(batches):
        for batch in batches:
            scores = _scores(held.value, batch.column("text"))
            yield batch.filter(pa.array([x < THRESHOLD for x in scores], pa.bool_()))

    return docs.mapInArrow(in_parts(run), docs.schema)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.7) of every whole text.

    The machine learns from at most 2 * SAMPLE labelled texts that are not held out, and is
    broadcast; all texts are scored whole where they lie, without a shuffle. Null and empty texts, and texts without a word of three letters, get the least score;
    without texts of both classes every score is 0. held_out of a null doc_id is false. Repeated
    rows stay; an empty table gives no row; other columns are not read."""
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(learned(named, labels))

    def run(batches):
        for batch in batches:
            scores = _scores(held.value, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    scored = whole_texts(named).mapInArrow(in_parts(run), "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out"), "score",
                         F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"))
