"""Quality by a regularised quadratic discriminant over document statistics.

Each document becomes a vector of transformed statistics. A class is a normal distribution whose
covariance is shrunk: towards the pooled one, and that towards its diagonal. The score is the
logistic function of the difference of the classes' log densities, prior included; densities come
from Mahalanobis distances by the inverse Cholesky factors, which are computed once.

The distributions are fitted on a bounded sample of labelled rows (`labelled.SAMPLE_ROWS` of each
class); priors come from all labels outside the held-out fold. All documents are scored in one pass
without a shuffle.

Defined results: a null or empty text is a vector like any other, that of no words. With labels of
one class only, or none, every score is that class's share (0 without labels). Rows with a null id
are scored, as not held out. Repeated rows are scored each. An empty table gives an empty result.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilesieve.llm import labelled
from tilesieve.llm.common import id_text_batches, with_id_and_text
from tilesieve.llm.quality_rules import SPACES, SYMBOLS, words_in_repeats

FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3

STATISTICS = ("words", "word_length", "symbols", "upper", "exclamations", "duplicate_lines", "repeated_windows", "top_word", "distinct_words", "line_length", "punctuation", "digits", "pipes")


def statistics(data: bytes) -> list[float]:
    """The raw statistics of a UTF-8 text, in the order of STATISTICS."""
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    text = data.decode()
    lower = text.lower()
    if len(lower) == len(text):
        a, b = (np.frombuffer(t.encode("utf-32-le"), dtype="<u4") for t in (text, lower))
        upper = int((a != b).sum())
    else:
        upper = sum(map(str.isupper, text))
    chars = len(data.translate(None, SPACES).decode())
    lines = [x for x in data.split(b"\n") if x.strip(SPACES)]
    times = Counter(words)
    count = lambda these: len(data) - len(data.translate(None, these))
    return [
        n,
        chars / n,
        count(SYMBOLS) / n,
        upper / chars,
        data.count(b"!") / n,
        (len(lines) - len(set(lines))) / len(lines),
        words_in_repeats(words) / n,
        max(times.values()) / n,
        len(times) / n,
        n / len(lines),
        count(b".,;:?") / n,
        count(b"0123456789") / chars,
        data.count(b"|") / n,
    ]


def transform(raw: np.ndarray) -> np.ndarray:
    """Counts by logarithm, shares by arcsine root, so that classes are nearer to normal distributions."""
    x = np.array(raw, dtype=float).reshape(-1, len(STATISTICS))
    logs = [STATISTICS.index(k) for k in ("words", "word_length", "line_length")]
    shares = [k for k in range(x.shape[1]) if k not in logs]
    x[:, logs] = np.log1p(x[:, logs])
    x[:, shares] = np.arcsin(np.sqrt(np.clip(x[:, shares], 0, 1)))
    return x


@dataclass
class Model:
    """Per class: mean, inverse Cholesky factor of the covariance, and log density's constant; None: a fixed score."""

    means: np.ndarray
    factors: np.ndarray
    constants: np.ndarray
    fixed: float | None = None

    def scores(self, raw: np.ndarray) -> np.ndarray:
        x = transform(raw)
        if self.fixed is not None:
            return np.full(len(x), self.fixed)
        logs = [c - 0.5 * (((x - m) @ f.T) ** 2).sum(axis=1) for m, f, c in zip(self.means, self.factors, self.constants)]
        return 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, priors: tuple[float, float], to_pooled: float = 0.1, to_diagonal: float = 0.1, floor: float = 1e-4) -> Model:
    """x: transformed statistics. Shrinkage grows where a class has few rows for its covariance."""
    d = x.shape[1]
    parts = [x[y == c] for c in (0, 1)]
    means = np.array([p.mean(axis=0) for p in parts])
    own = [np.atleast_2d(np.cov(p.T, bias=True)) if len(p) > 1 else np.zeros((d, d)) for p in parts]
    pooled = sum(len(p) * s for p, s in zip(parts, own)) / len(x)
    factors, constants = [], []
    for p, s, prior in zip(parts, own, priors):
        a = max(to_pooled, d / (d + len(p)))
        cov = (1 - a) * s + a * pooled
        cov = (1 - to_diagonal) * cov + to_diagonal * np.diag(np.diag(cov)) + floor * np.eye(d)
        low = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(low))
        constants.append(np.log(prior) - np.log(np.diag(low)).sum())
    return Model(means, np.array(factors), np.array(constants))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", folds: int = FOLDS, held_out: int = HELD_OUT, rows: int = labelled.SAMPLE_ROWS, **kw) -> Model:
    found, counts = labelled.sample(docs, labels, label, folds, held_out, rows, id_col, text_col)
    if not counts.get(0) or not counts.get(1):
        none = np.zeros(0)
        return Model(none, none, none, fixed=1.0 if counts.get(1) else 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [statistics(t or b"") for t in batch.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(raw, pa.list_(pa.float64()))], names=["doc_id", "label", "raw"])

    got = found.mapInArrow(run, "doc_id long, label int, raw array<double>").toArrow().sort_by("doc_id")
    x, y = transform(np.array(got["raw"].to_pylist())), got["label"].to_numpy()
    total = counts[0] + counts[1]
    if len(set(y.tolist())) < 2:  # labels whose documents are missing
        return Model(np.zeros(0), np.zeros(0), np.zeros(0), fixed=counts[1] / total)
    return fit(x, y, (counts[0] / total, counts[1] / total), **kw)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS, held_out: int = HELD_OUT, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, held_out, score and predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in id_text_batches(batches):
            yield pa.RecordBatch.from_arrays([ids, pa.array(model.scores(np.array([statistics(t) for t in texts])), pa.float64())], names=["doc_id", "score"])

    found = with_id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")
    held = F.coalesce(labelled.fold(F.col("doc_id"), folds) == held_out, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, **kw) -> DataFrame:
    """Scores of all documents by a model that is fitted on the labels outside the held-out fold."""
    return score(docs, train(docs, labels, **kw))
