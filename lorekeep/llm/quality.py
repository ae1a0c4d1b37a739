"""Quality: a regularised quadratic discriminant over document statistics.

Each text becomes a vector of transformed statistics (logarithms and logits of
lengths, shares of character classes, repetition of words, trigrams and lines).
The class covariances are shrunk towards the pooled covariance and its scaled
identity; their Cholesky factors are computed once.  A score is the logistic of
a line through the difference of the two Gaussian log-densities, which are
Mahalanobis distances under the cached factors; slope and offset of the line
are fitted to the training rows (Platt scaling).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled, textbuf
from .session import fold, map_batches

DEFAULT_THRESHOLD = 0.7

_UPPER, _LETTER, _DIGIT, _SYMBOL, _STOP = (np.zeros(256, np.int8) for _ in range(5))
_UPPER[65:91] = 1
_LETTER[65:91] = _LETTER[97:123] = _LETTER[0xC0:] = 1
_DIGIT[48:58] = 1
_SYMBOL[[*b"!\"#$%&()*+/:;<=>?@[\\]^_`{|}~"]] = 1
_STOP[[*b".,"]] = 1
FEATURES = ("words", "word_bytes", "upper", "symbol", "digit", "stops", "distinct_words", "distinct_trigrams", "distinct_lines", "line_words", "longest_word", "short_words", "non_ascii")


def _logit(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Log-odds of x out of n, smoothed."""
    return np.log((x + 0.5) / (n - x + 0.5))


def _distinct(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Different hashes of each document (40 bits of each hash count)."""
    key = np.sort((doc.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
    if not len(key):
        return np.zeros(n, np.int64)
    new = np.concatenate([[True], key[1:] != key[:-1]])
    return np.bincount((key[new] >> np.uint64(40)).astype(np.int64), minlength=n)


def statistics(s: textbuf.Slice) -> np.ndarray:
    """One row of transformed statistics for each document of the slice."""
    n, size = s.n, s.lengths()
    w = textbuf.words(s, textbuf.NON_SPACE)
    count = w.counts(n)
    length = w.end - w.start

    def total(table: np.ndarray) -> np.ndarray:
        return textbuf.per_doc(table[s.data].astype(np.int64), size)

    letters, visible = total(_LETTER), np.bincount(w.doc, weights=length, minlength=n)
    tri = textbuf.gram_hash(w.hash, 3)
    whole = w.doc[: len(tri)] == w.doc[2:] if len(tri) else np.zeros(0, bool)
    tri_doc = w.doc[: len(tri)][whole]
    n_tri = np.bincount(tri_doc, minlength=n)
    in_line = s.data != 10
    l_start, l_end = textbuf.spans(in_line, s.offsets)
    l_doc = np.searchsorted(s.offsets, l_start, "right") - 1
    n_lines = np.bincount(l_doc, minlength=n)
    non_ascii = total((np.arange(256) >= 0xC0).astype(np.int8))
    longest = textbuf.per_doc(length, count, np.maximum)
    columns = [
        np.log1p(count),
        np.log1p(visible / np.maximum(count, 1)),
        _logit(total(_UPPER), letters),
        _logit(total(_SYMBOL), visible),
        _logit(total(_DIGIT), visible),
        _logit(np.minimum(total(_STOP), count), count),
        _logit(_distinct(w.doc, w.hash, n), count),
        _logit(_distinct(tri_doc, tri[whole], n), n_tri),
        _logit(_distinct(l_doc, textbuf.span_hash(s.data, l_start, l_end), n), n_lines),
        np.log1p(count / np.maximum(n_lines, 1)),
        np.log1p(longest),
        _logit(np.bincount(w.doc, weights=length <= 3, minlength=n), count),
        _logit(np.minimum(non_ascii, letters), letters),
    ]
    return np.stack(columns, axis=1).astype(np.float64)


@dataclass
class Discriminant:
    center: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    inverse_factors: np.ndarray
    log_dets: np.ndarray
    log_priors: np.ndarray
    slope: float = 1.0
    offset: float = 0.0
    constant: float | None = None

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-density of class 1 less that of class 0, with priors."""
        z = (x - self.center) / self.scale
        logs = []
        for k in range(2):
            u = (z - self.means[k]) @ self.inverse_factors[k].T
            logs.append(self.log_priors[k] - 0.5 * np.einsum("ij,ij->i", u, u) - 0.5 * self.log_dets[k])
        return logs[1] - logs[0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * self.margin(x) + self.offset, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, shrink: float = 0.2, ridge: float = 0.05) -> Discriminant:
    """shrink: weight of the pooled covariance; ridge: weight of the scaled identity.

    Without rows, or with one class only, every score is the share of class 1 (0.5 without rows).
    """
    d = x.shape[1]
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        return Discriminant(np.zeros(d), np.ones(d), np.zeros((2, d)), np.stack([np.eye(d)] * 2), np.zeros(2), np.zeros(2), constant=share)
    center, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = (x - center) / scale
    own = [z[y == k] for k in range(2)]
    means = np.stack([o.mean(0) for o in own])
    covs = [(o - m).T @ (o - m) / max(1, len(o) - 1) for o, m in zip(own, means, strict=True)]
    pooled = sum(c * len(o) for c, o in zip(covs, own, strict=True)) / len(z)
    factors, dets = [], []
    for c, o in zip(covs, own, strict=True):
        weight = max(shrink, d / (d + len(o)))  # small classes lean on the pooled covariance
        c = (1 - weight) * c + weight * pooled
        c = (1 - ridge) * c + ridge * np.trace(c) / d * np.eye(d)
        low = np.linalg.cholesky(c)
        factors.append(np.linalg.inv(low))
        dets.append(2 * np.log(np.diag(low)).sum())
    model = Discriminant(center, scale, means, np.stack(factors), np.array(dets), np.log([len(o) / len(z) for o in own]))
    model.slope, model.offset = platt(model.margin(x), y)
    return model


def platt(m: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope (at least 0.01) and offset of the logistic line through margins that gives the labels the best likelihood."""
    n1, n0 = float((y == 1).sum()), float((y == 0).sum())
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    unit = max(float(np.abs(m).mean()), 1e-9)
    f = np.stack([np.clip(m / unit, -20, 20), np.ones(len(m))], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(f @ w, -30, 30)))
        hess = (f * (p * (1 - p))[:, None]).T @ f + 1e-3 * np.eye(2)
        w = w - np.clip(np.linalg.solve(hess, f.T @ (p - target) + 1e-3 * w), -2, 2)
    return max(float(w[0]) / unit, 0.01), float(w[1])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 4, held_out: int = 2, max_rows: int = labelled.MAX_ROWS, max_bytes: int = labelled.MAX_BYTES) -> Discriminant:
    """Fit on a bounded sample of labelled rows: max_rows documents and max_bytes of text at most."""
    ids = labelled.sample_ids(docs, labels, label, modulus, held_out, max_rows, max_bytes)

    def make():
        def run(batch: pa.RecordBatch):
            x = np.concatenate([statistics(s) for s in textbuf.slices(batch.column("text"))])
            flat = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.ravel())
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), flat], ["doc_id", "y", "x"])

        return run

    rows = map_batches(labelled.sampled_docs(docs, ids, "text"), make, "doc_id long, y int, x array<double>").toArrow().sort_by([("doc_id", "ascending")])
    x = rows["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES)) if rows.num_rows else np.zeros((0, len(FEATURES)))
    return fit(x, rows["y"].to_numpy())


def score(docs: DataFrame, model: Discriminant, modulus: int = 4, held_out: int = 2, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every whole text, in one pass without a shuffle.

    Null and empty texts have the statistics of a text without words.
    Repeated rows are scored each; other columns are not read.
    """
    model_b = docs.sparkSession.sparkContext.broadcast(model)  # two small matrices

    def make():
        def run(batch: pa.RecordBatch):
            s = np.concatenate([model_b.value.scores(statistics(x)) for x in textbuf.slices(batch.column("text"))])
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

        return run

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold("doc_id", modulus) == held_out).alias("held_out"), "text")
    return map_batches(rows, make, "doc_id long, held_out boolean, score double, predicted int")


def keep(docs: DataFrame, model: Discriminant, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose score is at least threshold."""
    model_b = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def make():
        def run(batch: pa.RecordBatch):
            s = np.concatenate([model_b.value.scores(statistics(x)) for x in textbuf.slices(batch.column(at))])
            return batch.filter(pa.array(s >= threshold))

        return run

    return map_batches(docs, make, docs.schema)
