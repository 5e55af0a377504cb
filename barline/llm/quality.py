"""Quality scores by a regularised quadratic discriminant over document statistics.

Each text becomes a short vector of transformed statistics. Spark adds up counts, sums and products of
the vectors of each class over all labelled rows (a few hundred numbers), from which come class means and
class covariances, shrunk towards the pooled covariance and its diagonal. A score is the logistic function
of the difference of log densities, half the difference of squared Mahalanobis distances and of log
determinants, with the class shares as prior; Cholesky factors are worked out once.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STATISTICS = (
    "words", "word_length", "word_spread", "distinct", "top_word", "adjacent", "upper", "digits", "symbols",
    "stops", "bars", "marks", "spaces", "line_words", "line_repeats", "byte_entropy", "wide",
)
#: Weight of the pooled covariance in each class's, and of its diagonal in that mixture.
SHRINK, DIAGONAL, FLOOR = 0.05, 0.05, 1e-4

_CLASS = np.zeros(256, np.int64)
_CLASS[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 1
_CLASS[list(b"0123456789")] = 2
_CLASS[list(b"#$%&*@^~_=+<>{}[]()\\/\"")] = 3
_CLASS[list(b".,;:")] = 4
_CLASS[list(b"|")] = 5
_CLASS[list(b"!?")] = 6
_CLASS[list(b" \t\n\r\x0b\x0c")] = 7
_CLASS[128:] = 8
CLASS_COUNT = np.zeros((9, 256))
CLASS_COUNT[_CLASS, np.arange(256)] = 1


def statistics(text: str) -> list[float]:
    """Transformed statistics of a whole text; shares as logits, sizes as logarithms. An empty text has zeros as its counts."""
    raw = text.encode("utf-8", "surrogatepass")
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    kinds, size = CLASS_COUNT @ hist, max(len(raw), 1)
    words = text.split()
    n = len(words)
    lengths = list(map(len, words))
    total = sum(lengths)
    mean = total / n if n else 0.0
    spread = (sum(x * x for x in lengths) / n - mean * mean) if n else 0.0
    common = Counter(words)
    lines = text.split("\n")
    p = hist[hist > 0] / size

    def share(part, whole, soft=1.0):
        return float(np.log((part + 0.1 * soft) / (max(whole - part, 0) + soft)))

    return [
        float(np.log1p(n)),
        float(np.log1p(mean)),
        float(np.log1p(max(spread, 0.0))),
        share(len(common), n),
        share(max(common.values(), default=0), n),
        share(sum(map(eq, words, words[1:])), n),
        *(share(kinds[k], size) for k in (1, 2, 3, 4, 5, 6, 7)),
        float(np.log1p(n / len(lines))),
        share(len(lines) - len(set(lines)), len(lines)),
        float(-(p * np.log(p)).sum()),
        share(kinds[8], size),
    ]


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the text, with a column ``x`` of its statistics (null text: as empty)."""
    keep = [c for c in docs.columns if c not in (text, "x")]

    def run(batches):
        for b in batches:
            x = [statistics(t or "") for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(x, pa.list_(pa.float64()))], names=[*keep, "x"])

    return docs.select(*keep, text).mapInArrow(run, docs.select(*keep).schema.add("x", T.ArrayType(T.DoubleType())))


def _statistics_of(docs: DataFrame) -> DataFrame:
    """Statistics as they are, or those of documents with a text."""
    return with_statistics(docs) if "text" in docs.columns else docs


@dataclass(frozen=True)
class Discriminant:
    means: np.ndarray
    factors: np.ndarray
    log_dets: np.ndarray
    log_odds: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 of each row."""
        density = []
        for mean, factor, log_det in zip(self.means, self.factors, self.log_dets):
            y = np.linalg.solve(factor, (x - mean).T)
            density.append(-0.5 * ((y * y).sum(axis=0) + log_det))
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0] + self.log_odds, -500, 500)))


def discriminant(counts, sums, products) -> Discriminant:
    """From each class's count, sum and sum of outer products. A class of fewer than two rows takes the pooled figures."""
    counts, sums, products = (np.asarray(a, float) for a in (counts, sums, products))
    d = sums.shape[1]
    every = max(counts.sum(), 1)
    centre = sums.sum(axis=0) / every
    means = np.array([s / n if n > 1 else centre for n, s in zip(counts, sums)])
    inner = [p - n * np.outer(m, m) if n > 1 else np.zeros((d, d)) for n, m, p in zip(counts, means, products)]
    pooled = sum(inner) / every
    pooled = (1 - DIAGONAL) * pooled + DIAGONAL * np.diag(np.diag(pooled)) + FLOOR * np.eye(d)
    factors = np.array([np.linalg.cholesky((1 - SHRINK) * c / n + SHRINK * pooled if n > 1 else pooled) for n, c in zip(counts, inner)])
    log_dets = 2 * np.log(np.diagonal(factors, axis1=1, axis2=2)).sum(axis=1)
    return Discriminant(means, factors, log_dets, float(np.log((counts[1] + 1) / (counts[0] + 1))))


def fit(docs: DataFrame, labels: DataFrame, allowed: Column) -> Discriminant:
    """From all labelled texts for which ``allowed`` (over doc_id) holds; labels other than 0 and 1 are not used.

    ``docs`` holds texts, or what :func:`with_statistics` made of them; statistics, not texts, meet the labels. Null doc_ids meet no
    label; rows of one doc_id count each, once per label; very long texts count as one row; without rows of a class
    its covariance is the pooled, shrunk one and an empty table gives a model of even odds. Other columns are ignored.
    """
    known = labels.select("doc_id", F.col("quality").cast("int").alias("y")).where(F.col("y").isin(0, 1) & allowed)
    found = known.join(_statistics_of(docs).select("doc_id", "x"), "doc_id").select("y", "x")
    d = len(STATISTICS)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    x = F.col("x")
    sums = found.groupBy("y").agg(F.count("*"), *(F.sum(x[i]) for i in range(d)), *(F.sum(x[i] * x[j]) for i, j in pairs)).collect()
    counts, first, second = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    for row in sums:
        y, n, *rest = row
        counts[y], first[y] = n, rest[:d]
        for (i, j), v in zip(pairs, rest[d:]):
            second[y, i, j] = second[y, j, i] = v
    return discriminant(counts, first, second)


def score(docs: DataFrame, model: Discriminant) -> DataFrame:
    """``docs`` (texts or statistics) with ``score`` in [0, 1] in their place, and of a column of that name.

    Null and empty texts have the score of the zero counts, equal texts and repeated rows equal ones; very long texts are
    read whole; an empty table gives no rows; other columns are carried as they are.
    """
    keep = [c for c in docs.columns if c not in ("text", "x", "score")]

    def run(batches):
        for b in batches:
            x = np.array(b.column("x").to_pylist(), float).reshape(b.num_rows, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(model.score(x), pa.float64())], names=[*keep, "score"])

    seen = _statistics_of(docs)
    return seen.select(*keep, "x").mapInArrow(run, seen.select(*keep).schema.add("score", "double"))
