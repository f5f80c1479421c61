"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

Kernel of two words: the gap-weighted subsequence kernel of order ORDER (DECAY for every character spanned),
normalised and raised to POWER. It is summed over all subsequences, nothing is screened or cut, so it is positive
semidefinite (a power of such a kernel is one). Kernel of two sentences: its sum over all pairs of their words.
A sentence ends with a word that ends in `.!?`, and after SENTENCE words at the latest.

Words are white-space runs, lower-cased, without characters that aren't letters or digits, between two marks.
Some words are also read otherwise: runs of three or more single letters as one word, a word whose every second
character is the same without those, and two neighbours of a sentence as one word (in addition to each) where
together they begin and end like a landmark and are as long. Characters that words of a landmark lack cost DECAY each.

Training, on the driver: at most `sample` labelled documents of each class and of at most `max_bytes` bytes
(documented bounds; rows in order of a hash of the identifier), never from the held-out fold. Landmarks are words
(as sentences of one word), at most `landmarks`, by their share of toxic documents times their log odds, none nearly
equal to another. Kernel values with the landmarks, whitened by the landmarks' own kernel matrix, are a sentence's
Nystroem features, on which a squared-hinge SVM is fitted in a few rounds: the sentence with the largest margin of
each toxic document is positive, as it is and with a letter or two put into each of its words, and the HARD largest of each
other document become negative and stay so. A logistic fit on three statistics of a document's margins (the largest, the sum of what exceeds OVER, and that sum by words)
gives the score.
As the sentence kernel is a sum over words, so is the margin: a word's part of it is one number, and words are
remembered by a bounded cache of their numbers that lives as long as the worker. Whole texts are scored.

Null and empty texts are scored as having no words. Rows keep null and repeated identifiers; other columns,
language, source and identifier are no inputs of a score. An empty table gives an empty result; without
labels of both classes every score is 0. A map over Arrow batches: no shuffle; labels are joined to the
sample by a broadcast of at most 4 * sample rows.
"""

from __future__ import annotations

import math
import random
import string
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import tidy
from .textnum import pieces

ORDER, DECAY, POWER = 3, 0.6, 4
OVER = -0.7  # margins count towards a document's statistics from here on
SENTENCE = 40  # words of a sentence at most
HARD = 4  # sentences that each round takes from a document that isn't toxic
WIDTH = 24  # longer words are compared in overlapping pieces of this length


def plain(word: str) -> str:
    """The word's letters and digits, without a filler at every second place, between a mark for its start and one for its end."""
    w = word if word.isalnum() else "".join(filter(str.isalnum, word))
    if len(w) > 6 and w[1] == w[3] and w[1::2] == w[1] * (len(w) // 2):
        w = w[::2]
    return f"\1{w}\2"


def codes(words: list[str]) -> np.ndarray:
    """Characters of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1).astype(np.int32)


@cache
def subsequences(n: int) -> tuple[np.ndarray, np.ndarray]:
    """All positions i < j < k of n characters, and their weights."""
    at = np.array(list(combinations(range(n), ORDER)), np.int64).reshape(-1, ORDER).T
    return at, (DECAY ** (at[-1] - at[0] + 1)).astype(np.float32)


class Words:
    """The kernel of words with fixed landmarks, by explicit features: weights of the landmarks' own subsequences."""

    def __init__(self, landmarks: list[str]) -> None:
        self.landmarks = landmarks
        self.alphabet = np.array(sorted({ord(c) for w in landmarks for c in w}), np.int32)
        self.kinds = len(self.alphabet) + 1  # kind 0: characters of no landmark
        features: list[dict[int, float]] = []
        for w in landmarks:
            of: dict[int, float] = {}
            (i, j, k), weight = subsequences(len(w))
            c = self._kinds(codes([w]))[0]
            for code, v in zip(((c[i] * self.kinds + c[j]) * self.kinds + c[k]).tolist(), weight.tolist()):
                of[code] = of.get(code, 0.0) + v
            features.append(of)
        known = sorted(set().union(*features))
        self.place = np.zeros(self.kinds**3, np.int32)
        self.place[known] = np.arange(1, len(known) + 1)  # row 0: subsequences of no landmark
        self.phi = np.zeros((len(known) + 1, len(landmarks)), np.float32)
        for m, of in enumerate(features):
            norm = math.sqrt(sum(v * v for v in of.values()))
            for code, v in of.items():
                self.phi[self.place[code], m] = v / norm

    def _kinds(self, chars: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.alphabet, chars), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == chars, at + 1, 0)

    @staticmethod
    def _pieces(w: str) -> list[str]:
        return [w] if len(w) <= WIDTH else [w[at : at + WIDTH] for at in range(0, len(w) - WIDTH // 2, WIDTH // 2)]

    def parts(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Kernel values (a row for each word of some, by number) of all words with ORDER characters and more; a long word has several rows."""
        by_len: dict[int, tuple[list[int], list[str]]] = {}
        for i, w in enumerate(words):
            for p in self._pieces(w):
                if len(p) > ORDER:
                    own, texts = by_len.setdefault(len(p), ([], []))
                    own.append(i)
                    texts.append(p)
        for n, (own, texts) in by_len.items():
            (i, j, k), weight = subsequences(n)
            step = max(16, 20_000 // len(weight))
            chars = codes(texts)
            kinds = self._kinds(chars)
            for at in range(0, len(own), step):
                c = kinds[at : at + step]
                place = self.place[(c[:, i] * self.kinds + c[:, j]) * self.kinds + c[:, k]]
                value = np.matmul(weight, self.phi[place])
                value /= np.sqrt(self._norms(chars[at : at + step]))[:, None]
                yield np.array(own[at : at + step]), value**POWER

    def rows(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.landmarks)), np.float32)
        for own, value in self.parts(words):
            np.add.at(out, own, value)
        return out

    def sums(self, words: list[str], weights: np.ndarray) -> np.ndarray:
        """Of each word, its kernel values times `weights`."""
        out, w = np.zeros(len(words)), weights.astype(np.float32)
        for own, value in self.parts(words):
            out += np.bincount(own, value @ w, len(words))
        return out

    @staticmethod
    def _norms(chars: np.ndarray) -> np.ndarray:
        """The kernel of each row with itself."""
        n, width = chars.shape
        weight = subsequences(width)[1]
        out = np.full(n, float((weight * weight).sum()), np.float32)  # of different characters
        order = np.sort(chars, axis=1)
        again = np.flatnonzero((order[:, 1:] == order[:, :-1]).any(1))
        if not len(again):
            return out
        lam = np.float32(DECAY)
        same = (chars[again, :, None] == chars[again, None, :]).transpose(1, 2, 0).astype(np.float32)  # words last: long inner loops
        prev = np.ones((width + 1, width + 1, len(again)), np.float32)
        for _ in range(ORDER - 1):
            hit = same * prev[:-1, :-1] * (lam * lam)
            ext = np.zeros((width, width + 1, len(again)), np.float32)
            for k in range(width):
                ext[:, k + 1] = lam * ext[:, k] + hit[:, k]
            now = np.zeros_like(prev)
            for j in range(width):
                now[j + 1] = lam * now[j] + ext[j]
            prev = now
        out[again] = (same * prev[:-1, :-1]).sum((0, 1)) * (lam * lam)
        return out


def tokens(text: str) -> list[str]:
    """Lower-cased words at white space, each run of three or more single characters joined to one."""
    words = text.lower().split()
    out, run = [], []
    for w in words:
        if len(w) == 1:
            run.append(w)
            continue
        if run:
            out += ["".join(run)] if len(run) > 2 else run
            run = []
        out.append(w)
    return out + (["".join(run)] if len(run) > 2 else run)


class Lexicon:
    """Numbers for words, and which words end a sentence or may be halves of a landmark. value_of: a word's value (a row or a number)."""

    def __init__(self, landmarks: list[str], value_of, keep: bool = False) -> None:
        self.value_of, self.keep = value_of, keep  # keep: the letters of all words, not only of those that may be halves
        self.halves = {(w[1], w[-2], len(w) - 2) for w in landmarks}
        self.firsts, self.lasts = {h[0] for h in self.halves}, {h[1] for h in self.halves}
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.bare: list[str] = []
        self.stop, self.begins, self.ends, self.values = np.zeros(0, bool), np.zeros(0, bool), np.zeros(0, bool), None

    def learn(self, new: set[str]) -> None:
        words = sorted(new)
        marked = [plain(w) for w in words]
        distinct = {w: k for k, w in enumerate(dict.fromkeys(marked))}
        value = self.value_of(list(distinct))[np.fromiter(map(distinct.__getitem__, marked), np.int64, len(marked))] if words else None
        if words:
            self.values = value if self.values is None else np.concatenate([self.values, value])
        self.stop = np.concatenate([self.stop, np.fromiter((w[-1] in ".!?" for w in words), bool, len(words))])
        self.begins = np.concatenate([self.begins, np.fromiter((w[1] in self.firsts for w in marked), bool, len(words))])
        self.ends = np.concatenate([self.ends, np.fromiter((w[-2] in self.lasts for w in marked), bool, len(words))])
        self.number.update(zip(words, range(len(self.bare), len(self.bare) + len(words))))
        new = np.flatnonzero(self.begins[-len(words) :] | self.ends[-len(words) :]).tolist() if words and not self.keep else range(len(words))
        letters = [""] * len(words)
        for k in new:
            letters[k] = marked[k][1:-1]
        self.bare += letters

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words' numbers; of each sentence its first word and its text; first words and values of neighbours read as one."""
        split = [t.lower().split() for t in texts]
        lengths = np.fromiter(map(len, chain.from_iterable(split)), np.int64)
        single = lengths == 1
        spelt = np.flatnonzero(single[:-2] & single[1:-1] & single[2:]) if len(lengths) > 2 else np.zeros(0, np.int64)
        if len(spelt):  # spelt out, perhaps: such runs are read as words
            bounds = np.cumsum([len(w) for w in split])
            for i in set(np.searchsorted(bounds, spelt, "right").tolist()):
                split[i] = tokens(texts[i])
        self.learn(set().union(*split).difference(self.number))
        ids = np.fromiter(map(self.number.__getitem__, chain.from_iterable(split)), np.int64)
        doc = np.repeat(np.arange(len(texts)), [len(w) for w in split])
        if not len(ids):
            return ids, doc, doc, doc, self.value_of([])
        first = np.concatenate([[True], (doc[1:] != doc[:-1]) | self.stop[ids[:-1]]])
        start = np.flatnonzero(first)
        place = np.arange(len(ids)) - start[np.cumsum(first) - 1]
        first = place % SENTENCE == 0
        near = np.flatnonzero(self.begins[ids[:-1]] & self.ends[ids[1:]] & (place[1:] != 0))
        bare, halves = self.bare, self.halves
        joined = [(x, f"\1{a}{b}\2") for x, a, b in zip(near.tolist(), map(bare.__getitem__, ids[near].tolist()), map(bare.__getitem__, ids[near + 1].tolist())) if a and b and (a[0], b[-1], len(a) + len(b)) in halves]
        start = np.flatnonzero(first)
        return ids, start, doc[start], np.array([x for x, _ in joined], np.int64), self.value_of([w for _, w in joined])


def squared_hinge(x: np.ndarray, y: np.ndarray, cost: float = 10.0, steps: int = 50) -> tuple[np.ndarray, float]:
    """Primal Newton steps on the active set; classes weigh alike."""
    z = np.hstack([x, np.ones((len(x), 1))])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y) * cost
    ridge = np.eye(z.shape[1])
    ridge[-1, -1] = 1e-6
    w = np.zeros(z.shape[1])
    active = np.ones(len(y), bool)
    for _ in range(steps):
        za = z[active] * weight[active, None]
        w = np.linalg.solve(z[active].T @ za + ridge, za.T @ y[active])
        now = y * (z @ w) < 1
        if (now == active).all():
            break
        active = now
    return w[:-1], float(w[-1])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 100) -> np.ndarray:
    """Weights and a last one for the constant: Newton steps on Platt's smoothed targets, a class of n weighing as the fourth root of n."""
    up, down = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    share = np.where(y > 0, up**-0.75, down**-0.75)
    share = share / share.mean()
    z, w = np.hstack([x, np.ones((len(x), 1))]), np.zeros(x.shape[1] + 1)
    damp = ridge * np.eye(len(w))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (share * (p * (1 - p) + 1e-9))[:, None]).T @ z + damp, z.T @ (share * (target - p)) - damp @ w)
        w = w + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-9:
            break
    return w


def statistics(margin: np.ndarray, doc: np.ndarray, words: np.ndarray, bias: float) -> np.ndarray:
    """Of each document: its largest margin, the sum of what exceeds OVER (a logarithm), and that by words (a logarithm)."""
    most = np.full(len(words), bias)
    np.maximum.at(most, doc, margin)
    over = np.bincount(doc, np.maximum(0, margin - OVER), len(words))
    return np.stack([np.clip(most, -2, 2), np.log1p(over), np.log(1e-3 + over / np.maximum(words, 1))], 1)


def longer(word: str, rng: random.Random) -> str:
    """The word between its marks, with a letter put into it, or two."""
    at = rng.randrange(1, len(word)) if len(word) > 1 else len(word)
    return f"\1{word[:at]}{''.join(rng.choices(string.ascii_lowercase, k=rng.choice((1, 1, 2))))}{word[at:]}\2"


class Model:
    def __init__(self, landmarks: list[str], weights: np.ndarray, bias: float, final: np.ndarray) -> None:
        self.landmarks, self.weights, self.bias, self.final = landmarks, weights, bias, final


def chosen_landmarks(texts: list[str], labels: list[int], landmarks: int, support: int) -> list[str]:
    bags = [set(map(plain, tokens(t))) for t in texts]
    up, down = Counter(), Counter()
    for bag, y in zip(bags, labels):
        (up if y else down).update(bag)
    p, n = sum(labels), len(labels) - sum(labels)
    least = min(support, max(2, p // 100))
    odds = {w: math.log((up[w] + 0.5) / (p + 1)) - math.log((down[w] + 0.5) / (n + 1)) for w in up if ORDER + 1 < len(w) <= WIDTH and up[w] >= least}
    worth = {w: up[w] / p * o for w, o in odds.items() if o > 1}
    ranked = sorted(worth, key=lambda w: (-worth[w], w)) or sorted(odds, key=lambda w: (-odds[w], w))
    ranked = ranked[: 8 * landmarks]
    if not ranked:
        return []
    chosen: list[str] = []
    like = Words(ranked).rows(ranked)
    for k in range(len(ranked)):
        if len(chosen) < landmarks and all(like[k, ranked.index(c)] < 0.6 for c in chosen):
            chosen.append(ranked[k])
    return chosen


def train(texts: list[str], labels: list[int], landmarks: int = 64, support: int = 5, rounds: int = 4) -> Model | None:
    if not any(labels) or all(labels):
        return None
    chosen = chosen_landmarks(texts, labels, landmarks, support)
    if not chosen:
        return None
    kernel = Words(chosen)
    lexicon = Lexicon(chosen, kernel.rows, keep=True)
    features, docs, counts, words_of = [], [], [], []
    for at in range(0, len(texts), 50):
        ids, start, doc, pair, extra = lexicon.read(texts[at : at + 50])
        counts.append(np.zeros(min(50, len(texts) - at)))
        if len(ids):
            x = np.add.reduceat(lexicon.values[ids], start, axis=0)
            np.add.at(x, np.searchsorted(start, pair, "right") - 1, extra)
            counts[-1] += np.bincount(doc, np.diff(np.append(start, len(ids))), len(counts[-1]))
            features.append(x)
            docs.append(at + doc)
            words_of += [of.astype(np.int32) if labels[at + k] else None for of, k in zip(np.split(ids, start[1:]), doc.tolist())]
    if not features:
        return None
    bare = lexicon.bare
    del lexicon  # the driver's memory is small
    x, doc, words = np.concatenate(features), np.concatenate(docs), np.concatenate(counts)
    del features
    y = np.where(np.array(labels) > 0, 1.0, -1.0)
    own = kernel.rows(chosen).astype(np.float64)
    value, vector = np.linalg.eigh((own + own.T) / 2)
    white = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-4 * value.max()))) @ vector.T
    margin = x.sum(1, dtype=np.float64)  # at first, the sentence likest to any landmark
    hard, rng = np.zeros(len(margin), bool), random.Random(0)
    for _ in range(rounds):
        order = np.lexsort((-margin, doc))
        begin = np.flatnonzero(np.concatenate([[True], doc[order][1:] != doc[order][:-1]]))
        rank = np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order))))
        toxic = y[doc[order]] > 0
        hard[order[~toxic & (rank < HARD)]] = True
        best = order[toxic & (rank == 0)]
        used = np.concatenate([best, np.flatnonzero(hard)])
        # each positive sentence once more, with letters put into every word
        bent = [[longer(bare[i], rng) for i in words_of[k].tolist()] for k in best.tolist()]
        flat = kernel.rows([w for words in bent for w in words])
        again = np.add.reduceat(flat, np.cumsum([0, *map(len, bent)])[:-1], axis=0) @ white
        w, b = squared_hinge(np.concatenate([x[used] @ white, again]), np.concatenate([y[doc[used]], np.ones(len(best))]))
        margin = x @ (white @ w).astype(np.float32) + b
    final = logistic(statistics(margin, doc, words, b), y)
    return Model(chosen, white @ w, b, final)


class Scorer:
    """Scores of texts. most: words remembered."""

    def __init__(self, model: Model, most: int = 500_000) -> None:
        self.model, self.most = model, most
        words = Words(model.landmarks)
        self.lexicon = Lexicon(model.landmarks, lambda new: words.sums(new, model.weights))

    def score(self, texts: list[str]) -> np.ndarray:
        m, x = self.model, self.lexicon
        if len(x.number) > self.most:  # between calls, so numbers stay valid within one
            x.clear()
        ids, start, doc, pair, extra = x.read(texts)
        words, margin = np.zeros(len(texts)), np.zeros(0)
        if len(ids):
            margin = np.add.reduceat(x.values[ids], start) + m.bias
            np.add.at(margin, np.searchsorted(start, pair, "right") - 1, extra)
            words += np.bincount(doc, np.diff(np.append(start, len(ids))), len(texts))
        z = statistics(margin, doc, words, m.bias) @ m.final[:-1] + m.final[-1]
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


_scorers: dict[bytes, Scorer] = {}


def scorer_of(model: Model) -> Scorer:
    """One scorer a worker, for all its tasks of one model."""
    key = model.weights.tobytes() + model.final.tobytes() + "".join(model.landmarks).encode()
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = Scorer(model)
    return _scorers[key]


def fold(id_col: str) -> F.Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


def fit(docs: DataFrame, labels: DataFrame, sample: int = 1500, max_bytes: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model | None:
    """Model from at most `sample` documents of each class outside the held-out fold."""
    usable = labels.select(F.col(id_col).cast("long").alias("i"), F.col(label_col).cast("int").alias("y")).filter("i is not null").filter(fold("i") != 0)
    picked = [usable.filter(F.col("y") == y).orderBy(F.xxhash64("i"), "i").limit(2 * sample) for y in (1, 0)]
    text = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).filter(F.octet_length("t") <= max_bytes)
    found = text.join(F.broadcast(picked[0].unionByName(picked[1])), "i").select("i", "y", "t")
    rows = [found.filter(F.col("y") == y).orderBy(F.xxhash64("i"), "i", "t").limit(sample).collect() for y in (1, 0)]
    return train([r["t"] for c in rows for r in c], [r["y"] for c in rows for r in c])


def toxicity(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score, predicted of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of(model) if model else None
        for batch in batches:
            for part in pieces(batch, 1):
                texts = [t or "" for t in part.column(1).to_pylist()]
                score = scorer.score(texts) if scorer else np.zeros(len(texts))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score, pa.float64())], [id_col, "score"])

    tidy(docs.sparkSession)
    scored = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"`{id_col}` long, score double")
    return scored.select(id_col, F.coalesce(fold(id_col) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that aren't predicted toxic, with their columns; scored and filtered in one map."""
    model = fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    if model is None:
        return docs
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of(model)
        for batch in batches:
            for part in pieces(batch, at):
                keep = scorer.score([t or "" for t in part.column(at).to_pylist()]) < 0.5
                yield part.filter(pa.array(keep))

    tidy(spark)
    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return toxicity(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


ORACLE = None
