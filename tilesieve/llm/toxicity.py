"""Toxicity by a counterfactual-regularised classifier.

A sparse logistic regression over words and word beginnings; a beginning that several words of a text
share is a feature of its own. Its loss has a term beside the labels': in each labelled sentence that
holds an identity term, the term is swapped for others of its kind, and a change of the score is
penalised by its square. A neutral mention of a group then scores as any other text, even where the
group is mentioned in toxic documents mostly.

The kinds of terms are a fixed list, and classes mined from the labelled sample (`mine`): words that
stand in clean documents often enough to be neutral, and in toxic ones too, whose swap would change
features that the labels favour or disfavour. A class holds words of about one frequency that keep
company with the same frequent word, so that a swap stays within a language.

The model is fitted on a bounded sample (`labelled.SAMPLE_ROWS` rows of each class). Features are
counted, chosen and the swaps are summed up in Spark; what comes to the driver is each sampled row's
chosen features, the mined words and the distinct swaps. The fit runs there by accelerated proximal
gradient steps; an L1 term leaves few features with a weight. All documents are scored in one pass
without a shuffle.

Defined results: a null or empty text has no features and gets the intercept's score. With labels of
one class only, or none, every score is that class's share (0 without labels). Rows with a null id
are scored, as not held out. Repeated rows are scored each. An empty table gives an empty result.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Container, Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilesieve.llm import labelled
from tilesieve.llm.common import cut_lineage, id_text_batches, with_id_and_text

FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.3

#: Terms for groups of people, by kind. A term is swapped for others of its kind.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("immigrants", "refugees", "citizens", "tourists"),
    ("deaf", "blind", "disabled"),
    ("old", "young", "elderly"),
    ("mujeres", "hombres"),
    ("femmes", "hommes"),
    ("frauen", "männer"),
)

_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?\n]+")
DIMENSIONS = 1 << 30
BEGINNINGS = (4, 5, 6, 7)

#: A feature has a weight only if so many sampled rows have it, and its shares in the classes are so many standard errors apart.
LEAST, APART = 3, 3.0

#: Mined terms stand in at least this share of the clean sampled rows and in so many rows of either class; a class of them has so many words, and its language is told by so many frequent words.
CLEAN_SHARE, CLEAN_ROWS, CLASS_WORDS, ANCHORS = 0.01, 5, 4, 16


#: Weight of the penalty on score changes under swaps.
COUNTERFACTUAL = 0.3


@lru_cache(maxsize=50_000)
def word_features(word: str) -> tuple[int, ...]:
    """Hashed features of a lower-case word: the word, and its beginnings."""
    return tuple(xxhash.xxh3_64_intdigest(x) % DIMENSIONS for x in (word, *("^" + word[:n] for n in BEGINNINGS if len(word) > n)))


def twice(feature: int) -> int:
    """The feature that two or more words of a text have this one."""
    return feature + DIMENSIONS


def counted(of: Iterable[Sequence[int]]) -> set[int]:
    """The features of a text, from those of its distinct words."""
    times = Counter(f for fs in of for f in fs)
    return {*times, *(twice(f) for f, n in times.items() if n > 1)}


def features(words: set[str]) -> set[int]:
    """Features of a set of lower-case words."""
    return counted(map(word_features, words))


def counterparts(terms: Sequence[Sequence[str]], chosen: Container[int] | None = None) -> dict[str, list[str]]:
    """For each term the others of its kinds; if only chosen features count, those with which a swap can change any."""
    kinds: dict[str, list[str]] = {}
    for group in terms:
        for t in group:
            kinds.setdefault(t, []).extend(o for o in group if o != t)
    if chosen is not None:
        told = {t: any(x in chosen for f in word_features(t) for x in (f, twice(f))) for t in kinds}
        kinds = {t: found for t, others in kinds.items() if (found := [o for o in others if told[t] or told[o]])}
    return kinds


def swaps(text: str, kinds: dict[str, list[str]], chosen: Container[int] | None = None) -> list[tuple[tuple[int, ...], tuple[int, ...]]]:
    """For each sentence with a term and each counterpart that it doesn't have: the features lost and won by the swap, of the chosen ones; swaps without any are left out."""
    out = []
    counts = (lambda f: True) if chosen is None else (lambda f: f in chosen or twice(f) in chosen)
    for sentence in _SENTENCE.split(text.lower()):
        words = set(_WORD.findall(sentence))
        terms = sorted(words & kinds.keys())
        if not terms:
            continue
        times = Counter(f for w in words for f in word_features(w) if counts(f))
        for term in terms:
            own = word_features(term)
            for other in kinds[term]:
                if other in words:
                    continue
                # only features of the two can change
                lost, won = [], []
                theirs = word_features(other)
                for f in {*own, *theirs}:
                    before = times.get(f, 0)
                    after = before - (f in own) + (f in theirs)
                    for name, least in ((f, 1), (twice(f), 2)):
                        if (chosen is None or name in chosen) and (before >= least) != (after >= least):
                            (won if after >= least else lost).append(name)
                if lost or won:
                    out.append((tuple(sorted(lost)), tuple(sorted(won))))
    return out


@dataclass
class Model:
    """Weights of the hashed features that have one."""

    intercept: float
    weights: dict[int, float] = field(default_factory=dict)

    def logit(self, found: set[int]) -> float:
        return self.intercept + sum(self.weights[f] for f in sorted(found))

    def score(self, found: set[int]) -> float:
        z = self.logit(found)
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def fit(rows: Sequence[tuple[int, Sequence[int]]], pairs: Sequence[tuple[Sequence[int], Sequence[int]]], odds: float, l1: float = 1e-3, counterfactual: float = COUNTERFACTUAL, steps: int = 400, least: int = LEAST, apart: float = APART, times_of: Sequence[float] | None = None) -> Model:
    """rows (label, features), pairs of swapped features and how often each stands, odds of label 1 among all labels.

    counterfactual weighs the mean squared change of the logit over the swaps. Features that fewer
    than `least` rows have, or whose shares in the classes differ by less than `apart` standard
    errors, get no weight. The others are scaled by their deviation, so that rare ones count.
    """
    y = np.array([r[0] for r in rows], dtype=float)
    lens = np.array([len(r[1]) for r in rows])
    flat = np.concatenate([np.asarray(r[1], dtype=np.int64) for r in rows]) if len(rows) else np.zeros(0, np.int64)
    names, index, times = np.unique(flat, return_inverse=True, return_counts=True)
    row_of = np.repeat(np.arange(len(rows)), lens)
    pos = max(1, int(y.sum()))
    neg = max(1, len(rows) - int(y.sum()))
    in_pos = np.bincount(index, y[row_of], len(names))
    share = times / max(1, len(rows))
    error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / pos + 1 / neg))
    ok = (times >= least) & (np.abs(in_pos / pos - (times - in_pos) / neg) >= apart * error)
    new = np.cumsum(ok) - 1
    keep = ok[index]
    row_of = row_of[keep]
    col = new[index[keep]]
    names = names[ok]
    scale = 1 / np.sqrt(np.maximum(share * (1 - share), 1 / max(1, len(rows))))[ok]
    k, n = len(names), len(rows)
    place = dict(zip(names.tolist(), range(k)))
    d_row, d_col, d_val = [], [], []
    for i, (lost, won) in enumerate(pairs):
        for fs, v in ((lost, 1.0), (won, -1.0)):
            for f in fs:
                if f in place:
                    d_row.append(i)
                    d_col.append(place[f])
                    d_val.append(v * scale[place[f]])
    d_row, d_col, d_val = np.array(d_row, dtype=np.int64), np.array(d_col, dtype=np.int64), np.array(d_val)
    m = max(1, len(pairs))
    often = np.ones(m) if times_of is None or not len(pairs) else np.asarray(times_of, dtype=float)
    part = counterfactual * often / often.sum()  # each swap's share of the penalty
    x = scale[col]
    weight = np.where(y == 1, 0.5 / pos, 0.5 / neg)  # classes count alike; the odds come back below

    def gradient(w: np.ndarray, b: float) -> tuple[np.ndarray, float]:
        z = np.bincount(row_of, x * w[col], n) + b
        r = weight * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y)
        g = np.bincount(col, x * r[row_of], k)
        if len(d_row):
            change = part * np.bincount(d_row, d_val * w[d_col], m)
            g += np.bincount(d_col, d_val * change[d_row], k)
        return g, float(r.sum())

    # a bound on the curvature by power iteration, so that steps are safe
    v = np.ones(k + 1)
    for _ in range(12):
        z = np.bincount(row_of, x * v[:k][col], n) + v[k]
        u = np.append(np.bincount(col, x * (0.25 * weight * z)[row_of], k), (0.25 * weight * z).sum())
        if len(d_row):
            u[:k] += np.bincount(d_col, d_val * (part * np.bincount(d_row, d_val * v[:k][d_col], m))[d_row], k)
        size = float(np.linalg.norm(u)) or 1.0
        v = u / size
    step = 1 / (1.1 * size)
    w, b = np.zeros(k), 0.0
    pw, pb, t = w, b, 1.0
    for _ in range(steps):
        g, gb = gradient(pw, pb)
        nw = pw - step * g
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * l1, 0)
        nb = pb - step * gb
        nt = (1 + math.sqrt(1 + 4 * t * t)) / 2
        pw, pb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    used = np.flatnonzero(w)
    return Model(b + math.log(odds), dict(zip(names[used].tolist(), (w * scale)[used].tolist())))


@dataclass
class Sample:
    """What the fit needs: rows (label, chosen features), the swaps with how often each stands, the mined classes and the odds of label 1."""

    rows: list[tuple[int, list[int]]]
    pairs: list[tuple[tuple[int, ...], tuple[int, ...]]]
    often: list[int]
    classes: list[tuple[str, ...]]
    odds: float


def _per_class(found: DataFrame, what, kind: str) -> DataFrame:
    """(it, pos, neg): in how many rows of either class each item of what(words) stands; combined in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            times: tuple[Counter, Counter] = (Counter(), Counter())
            for y, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                times[y].update(what(set(_WORD.findall(text.lower()))))
            for y in (0, 1):
                names = list(times[y])
                n, none = pa.array([times[y][k] for k in names], pa.int64()), pa.array([0] * len(names), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string() if kind == "string" else pa.int64()), n if y else none, none if y else n], names=["it", "pos", "neg"])

    return found.mapInArrow(run, f"it {kind}, pos long, neg long").groupBy("it").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def choose(found: DataFrame, pos: int, neg: int, least: int = LEAST, apart: float = APART) -> set[int]:
    """The features of the sampled rows (doc_id, label, text) that tell the classes apart."""
    share = (F.col("pos") + F.col("neg")) / (pos + neg)
    error = F.sqrt(F.greatest(share * (1 - share), F.lit(1e-12)) * (1 / pos + 1 / neg))
    told = (F.col("pos") + F.col("neg") >= least) & (F.abs(F.col("pos") / pos - F.col("neg") / neg) >= apart * error)
    return {r["it"] for r in _per_class(found, features, "long").where(told).select("it").collect()}


def mine(found: DataFrame, neg: int, chosen: Container[int], share: float = CLEAN_SHARE, rows: int = CLEAN_ROWS, words: int = CLASS_WORDS, anchors: int = ANCHORS) -> list[tuple[str, ...]]:
    """Classes of neutral words of the sampled rows, by company and frequency; at least one word of a class has a chosen feature.

    What comes to the driver is words that a fixed share of the clean rows hold, and how often they
    stand beside the most frequent of them.
    """
    least = max(rows, math.ceil(share * neg))
    known = {r["it"]: r["neg"] for r in _per_class(found, lambda x: x, "string").where((F.col("neg") >= least) & (F.col("pos") >= rows)).collect()}
    most = sorted(known, key=lambda w: (-known[w], w))[:anchors]
    if len(known) < 2:
        return []
    beside = {(r["term"], r["anchor"]): r["n"] for r in _company(found, set(known), most).collect()}
    # the anchor that a word stands beside more often than others do; of equals the most frequent
    of = {w: max(range(len(most)), key=lambda k: (beside.get((w, most[k]), 0) / (known[w] * known[most[k]]) ** 0.5, -k)) for w in known}
    out = []
    for k in range(len(most)):
        own = sorted((w for w in known if of[w] == k), key=lambda w: (-known[w], w))
        out += [tuple(own[i : i + words]) for i in range(0, len(own), words)]
    return [c for c in out if len(c) > 1 and any(f in chosen or twice(f) in chosen for w in c for f in word_features(w))]


def _company(found: DataFrame, terms: set[str], anchors: list[str]) -> DataFrame:
    """(term, anchor, n): in how many clean rows both stand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            times: Counter = Counter()
            for y, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if not y:
                    words = set(_WORD.findall(text.lower())) & terms
                    times.update((w, a) for a in anchors if a in words for w in words)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in times], pa.string()), pa.array([k[1] for k in times], pa.string()), pa.array(times.values(), pa.int64())], names=["term", "anchor", "n"])

    return found.mapInArrow(run, "term string, anchor string, n long").groupBy("term", "anchor").agg(F.sum("n").alias("n"))


def prepare(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", folds: int = FOLDS, held_out: int = HELD_OUT, rows: int = labelled.SAMPLE_ROWS, terms: Sequence[Sequence[str]] = IDENTITY_TERMS) -> Sample | float:
    """The fit's sample, or the share of label 1 where one class has no rows."""
    found, counts = labelled.sample(docs, labels, label, folds, held_out, rows, id_col, text_col)
    if not counts.get(0) or not counts.get(1):
        return 1.0 if counts.get(1) else 0.0
    found = cut_lineage(found)
    have = {r["label"]: r["count"] for r in found.groupBy("label").count().collect()}
    if len(have) < 2:  # labels whose documents are missing
        return counts[1] / (counts[0] + counts[1])
    chosen = choose(found, have[1], have[0])
    classes = mine(found, have[0], chosen)
    kinds = counterparts([*terms, *classes], chosen)
    longs = pa.list_(pa.int64())

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = [sorted(features(set(_WORD.findall(t.lower()))) & chosen) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(of, longs)], names=["doc_id", "label", "own"])

    def swapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            times = Counter(x for t in batch.column(2).to_pylist() for x in swaps(t, kinds, chosen))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in times], longs) for k in (0, 1)] + [pa.array(times.values(), pa.int64())], names=["lost", "won", "n"])

    got = sorted(found.mapInArrow(own, "doc_id long, label int, own array<long>").collect())
    pairs = sorted((tuple(r["lost"]), tuple(r["won"]), r["n"]) for r in found.mapInArrow(swapped, "lost array<long>, won array<long>, n long").groupBy("lost", "won").agg(F.sum("n").alias("n")).collect())
    return Sample([(r["label"], r["own"]) for r in got], [x[:2] for x in pairs], [x[2] for x in pairs], classes, counts[1] / counts[0])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", folds: int = FOLDS, held_out: int = HELD_OUT, rows: int = labelled.SAMPLE_ROWS, terms: Sequence[Sequence[str]] = IDENTITY_TERMS, **kw) -> Model:
    x = prepare(docs, labels, id_col, text_col, label, folds, held_out, rows, terms)
    if isinstance(x, float):
        return Model(700.0 if x == 1 else -700.0 if x == 0 else math.log(x / (1 - x)))
    return fit(x.rows, x.pairs, x.odds, times_of=x.often, **kw)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS, held_out: int = HELD_OUT, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, held_out, score and predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, ...]] = {}  # a word's features that can have a weight
        for ids, texts in id_text_batches(batches):
            out = []
            for data in texts:
                of = []
                for w in set(_WORD.findall(data.decode().lower())):
                    fs = known.get(w)
                    if fs is None:
                        if len(known) > 200_000:
                            known.clear()
                        fs = known[w] = tuple(f for f in word_features.__wrapped__(w) if f in model.weights or twice(f) in model.weights)
                    if fs:
                        of.append(fs)
                out.append(model.score(counted(of) & model.weights.keys()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(out, pa.float64())], names=["doc_id", "score"])

    found = with_id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")
    held = F.coalesce(labelled.fold(F.col("doc_id"), folds) == held_out, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, **kw) -> DataFrame:
    """Scores of all documents by a model that is fitted on the labels outside the held-out fold."""
    return score(docs, train(docs, labels, **kw))
