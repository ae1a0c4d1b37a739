"""Toxicity: a convolutional text classifier trained in numpy on all labelled rows.

A word's embedding is the sum of two: that of the hashed word and that of its
hashed first STEM bytes, which inflected forms share.
Filters of several widths slide over the word embeddings, the largest response
of each filter over the document (at least 0) is its pooled feature, and a
logistic layer turns the pooled features into a score.  The first embedding
dimension starts from smoothed class log-odds of the hashed words, all others
from zero, so that words never seen in training are neutral.

Every labelled row outside the held-out fold takes part, whatever its size.  The
rows are dealt by a hash of their content to shards of bounded size, so that
their number follows the data and not the cluster, and are kept as word buckets
in the shared folder.  One pass counts words by class, a pass an epoch trains
each shard by itself from the common weights and averages what the shards moved,
and a last pass takes the thresholds of languages from the scores of all rows.
What comes to the driver are sums by weight, never rows.  Scoring is one pass
without a shuffle, with the weights (a fixed number of them) broadcast.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import drop_stored, release, stored
from . import labelled, textbuf
from .session import bounded_batches, fold, give_back, map_batches

BUCKETS = 1 << 18
DIM = 8
FILTERS = 8
WIDTHS = (1, 2, 3)
PAD = max(WIDTHS) - 1
#: Bytes of a word that its second embedding depends on.
STEM = 4
#: Words that one convolution handles at once.
BLOCK_WORDS = 1 << 16
DEFAULT_THRESHOLD = 0.3
#: Labelled rows of a shard, and bytes of their texts, on average.
SHARD_ROWS = 4096
SHARD_BYTES = 64 << 20
#: Sum of squared gradients that every weight starts from.
SQUARE = 1e-2
#: Rows of weights in an Arrow batch.
MOVES = 1 << 16
#: Thresholds that a language's is chosen from.
GRID = np.linspace(0.05, 0.95, 19)


def word_ids(s: textbuf.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two bucket numbers (1..BUCKETS-1; 0 pads) of each word, and the words of each document."""
    w = textbuf.words(s, textbuf.ALNUM)
    a = (w.hash % np.uint64(BUCKETS - 1)).astype(np.int32) + 1
    stem = textbuf.span_hash(textbuf.LOWER[s.data], w.start, np.minimum(w.end, w.start + STEM))
    b = (stem % np.uint64(BUCKETS - 1)).astype(np.int32) + 1
    return a, b, w.counts(s.n)


def padded(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ids with PAD zeros behind every document and one before; and where each document begins."""
    begin = np.concatenate([[0], np.cumsum(counts + PAD + 1)])
    out = np.zeros(begin[-1] + PAD, ids.dtype)
    doc = np.repeat(np.arange(len(counts)), counts)
    out[np.arange(len(ids)) + doc * (PAD + 1) + 1] = ids
    return out, begin


def _sparse(table: np.ndarray) -> tuple[tuple[int, ...], np.ndarray, np.ndarray]:
    """Shape, and the rows that hold something: most buckets have no word."""
    rows = np.flatnonzero(table.reshape(len(table), -1).any(axis=1))
    return table.shape, rows, table[rows]


def _dense(packed: tuple[tuple[int, ...], np.ndarray, np.ndarray]) -> np.ndarray:
    shape, rows, values = packed
    out = np.zeros(shape, values.dtype)
    out[rows] = values
    return out


@dataclass
class ConvNet:
    tables: list[np.ndarray]
    kernels: dict[int, np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    @classmethod
    def start(cls, rng: np.random.Generator) -> ConvNet:
        kernels = {w: rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS}
        for k in kernels.values():
            k[:, 0, : FILTERS // 2] = np.abs(k[:, 0, : FILTERS // 2]) + 0.3
            k[:, 0, FILTERS // 2 :] = -np.abs(k[:, 0, FILTERS // 2 :]) - 0.3
        n = FILTERS * len(WIDTHS)
        weights = np.tile(np.r_[np.full(FILTERS // 2, 0.5), np.full(FILTERS - FILTERS // 2, -0.1)], len(WIDTHS)).astype(np.float32)
        return cls([np.zeros((BUCKETS, DIM), np.float32) for _ in range(2)], kernels, np.full(n, -0.5, np.float32), weights)

    @classmethod
    def constant(cls, p: float) -> ConvNet:
        """The net that gives every text the score p."""
        net = cls.start(np.random.default_rng(0))
        net.out[:] = 0
        p = float(np.clip(p, 1e-3, 1 - 1e-3))
        net.out_bias = float(np.log(p / (1 - p)))
        return net

    def __getstate__(self) -> dict:
        return self.__dict__ | {"tables": [_sparse(t) for t in self.tables]}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ = state | {"tables": [_dense(t) for t in state["tables"]]}

    def responses(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Embeddings of padded words, and filter responses where a window begins at each of all but the last PAD."""
        x = self.tables[0][a] + self.tables[1][b]
        n = len(x) - PAD
        parts = []
        for w in WIDTHS:
            r = x[:n] @ self.kernels[w][0]
            for j in range(1, w):
                r += x[j : j + n] @ self.kernels[w][j]
            parts.append(r)
        return x, np.concatenate(parts, axis=1) + self.bias

    def pooled(self, a: np.ndarray, b: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Per document the largest response of each filter, at least 0; long documents go in blocks of words."""
        out = np.zeros((len(counts), FILTERS * len(WIDTHS)), np.float32)
        if not len(counts):
            return out
        pa_, begin = padded(a, counts)
        pb, _ = padded(b, counts)
        at = 0
        while at < begin[-1]:
            to = min(at + BLOCK_WORDS, int(begin[-1]))
            _, r = self.responses(pa_[at : to + PAD], pb[at : to + PAD])
            first = int(np.searchsorted(begin, at, "right")) - 1
            last = int(np.searchsorted(begin, to, "left"))
            cuts = np.maximum(begin[first:last], at) - at
            out[first:last] = np.maximum(out[first:last], np.maximum.reduceat(r, cuts, axis=0))
            at = to
        return out

    def peaks(self, a: np.ndarray, b: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of padded documents the largest response of each filter and the position that gives it, in blocks of words."""
        n, every = len(begin) - 1, np.arange(FILTERS * len(WIDTHS))
        top, where = np.full((n, len(every)), -np.inf, np.float32), np.zeros((n, len(every)), np.int64)
        for at in range(0, int(begin[-1]), BLOCK_WORDS):
            to = min(at + BLOCK_WORDS, int(begin[-1]))
            _, r = self.responses(a[at : to + PAD], b[at : to + PAD])
            for i in range(int(np.searchsorted(begin, at, "right")) - 1, int(np.searchsorted(begin, to, "left"))):
                low = max(int(begin[i]), at)
                own = r[low - at : min(int(begin[i + 1]), to) - at]
                j = np.argmax(own, axis=0)
                v = own[j, every]
                where[i] = np.where(v > top[i], j + low, where[i])
                top[i] = np.maximum(top[i], v)
        return top, where

    def scores(self, a: np.ndarray, b: np.ndarray, counts: np.ndarray) -> np.ndarray:
        z = self.pooled(a, b, counts).astype(np.float64) @ self.out.astype(np.float64) + self.out_bias
        return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def _odds(n0: np.ndarray, n1: np.ndarray, r0: int, r1: int, smooth: float = 4.0) -> np.ndarray:
    """Shrunk log-odds of class 1 for each bucket, which n0 of the r0 documents of class 0 hold, and n1 of the r1 of class 1."""
    base = smooth * r1 / (r1 + r0)
    return (np.log((n1 + base) / r1) - np.log((n0 + smooth - base) / r0)).astype(np.float32) + np.float32(np.log(r1 / base) - np.log(r0 / (smooth - base)))


@dataclass
class Learner:
    """A net, and for each of its weights (each bucket: the mean of its own) the sum of squared gradients, which divides its steps."""

    net: ConvNet
    squares: list[np.ndarray] = field(default_factory=lambda: [np.zeros(BUCKETS, np.float32) for _ in range(2)])
    dense: np.ndarray = field(default_factory=lambda: np.zeros(0))
    updates: list[np.ndarray] = field(default_factory=list)
    steps: int = 0

    def __post_init__(self) -> None:
        if not len(self.dense):
            self.dense = np.zeros(len(self.weights()))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"squares": [_sparse(q) for q in self.squares]}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ = state | {"squares": [_dense(q) for q in state["squares"]]}

    def branch(self) -> Learner:
        """A copy that learns by itself."""
        own = copy.deepcopy(self)
        own.updates, own.steps = [np.zeros(BUCKETS, np.int32) for _ in range(2)], 0
        return own

    def weights(self) -> np.ndarray:
        """All weights but those of buckets."""
        net = self.net
        return np.concatenate([*(net.kernels[w].ravel() for w in WIDTHS), net.bias, net.out, [net.out_bias]]).astype(np.float64)

    def set_weights(self, v: np.ndarray) -> None:
        net, at = self.net, 0
        for x in (*(net.kernels[w] for w in WIDTHS), net.bias, net.out):
            x[...] = v[at : at + x.size].reshape(x.shape)
            at += x.size
        net.out_bias = float(v[at])

    def gradient(self, a: np.ndarray, b: np.ndarray, begin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the mean loss on padded documents by weights(), and by the embeddings at the positions that come third."""
        net = self.net
        top, where = net.peaks(a, b, begin)
        h = np.maximum(top, 0)
        z = h @ net.out + net.out_bias
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        gh = g[:, None] * net.out[None, :] * (top > 0)
        kernels, at, by = [], [], []
        for k, w in enumerate(WIDTHS):
            f = slice(k * FILTERS, (k + 1) * FILTERS)
            pos, gw = where[:, f], gh[:, f]
            gk = np.zeros_like(net.kernels[w])
            for j in range(w):
                x = net.tables[0][a[pos + j]] + net.tables[1][b[pos + j]]
                gk[j] = np.einsum("dfk,df->kf", x, gw)
                at.append((pos + j).ravel())
                by.append((gw[:, :, None] * net.kernels[w][j].T[None]).reshape(-1, DIM))
            kernels.append((gk + 1e-4 * net.kernels[w]).ravel())
        out = h.T @ g + 1e-4 * net.out
        return np.concatenate([*kernels, gh.sum(0), out, [g.sum()]]).astype(np.float64), np.concatenate(by), np.concatenate(at)

    def step(self, docs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, rate: float) -> None:
        """One step of Adagrad on documents given as the two bucket arrays of their words."""
        counts = np.array([len(d[0]) for d in docs])
        a, begin = padded(np.concatenate([d[0] for d in docs]), counts)
        b, _ = padded(np.concatenate([d[1] for d in docs]), counts)
        dense, by, at = self.gradient(a, b, begin, y)
        for t, ids in enumerate((a, b)):
            own = ids[at]
            order = np.argsort(own, kind="stable")
            cut = np.flatnonzero(np.diff(own[order], prepend=-1))
            hit, total = own[order][cut], np.add.reduceat(by[order], cut, axis=0)
            real = hit > 0  # bucket 0 pads
            hit, total = hit[real], total[real]
            self.squares[t][hit] += (total**2).mean(axis=1)
            self.net.tables[t][hit] -= rate * total / np.sqrt(SQUARE + self.squares[t][hit])[:, None]
            self.updates[t][hit] += 1
        self.dense += dense**2
        self.set_weights(self.weights() - rate * dense / np.sqrt(SQUARE + self.dense))
        self.steps += 1

    def moves(self, start: Learner) -> Iterator[pa.RecordBatch]:
        """What this branch moved since start: rows of DIM weights and a sum of squares, times the updates behind them."""
        for t in range(2):
            hit = np.flatnonzero(self.updates[t])
            n = self.updates[t][hit].astype(np.float64)
            v = (self.net.tables[t][hit] - start.net.tables[t][hit]) * n[:, None]
            yield from _batches(hit + t * BUCKETS, n, (self.squares[t][hit] - start.squares[t][hit]) * n, v)
        v = np.stack([self.weights() - start.weights(), self.dense - start.dense]).ravel() * self.steps
        v = np.pad(v, (0, -len(v) % DIM)).reshape(-1, DIM)
        yield from _batches(2 * BUCKETS + np.arange(len(v)), np.full(len(v), float(self.steps)), np.zeros(len(v)), v)

    def move(self, slot: np.ndarray, square: np.ndarray, v: np.ndarray) -> None:
        """Move by the averages of all branches."""
        for t in range(2):
            own = slot // BUCKETS == t
            self.net.tables[t][slot[own] - t * BUCKETS] += v[own]
            self.squares[t][slot[own] - t * BUCKETS] += square[own]
        own = slot >= 2 * BUCKETS
        flat = np.zeros((-(-2 * len(self.dense) // DIM), DIM))
        flat[slot[own] - 2 * BUCKETS] = v[own]
        w, q = flat.ravel()[: 2 * len(self.dense)].reshape(2, -1)
        self.set_weights(self.weights() + w)
        self.dense = self.dense + q


_VALUES = [f"v{i}" for i in range(DIM)]


def _batches(slot: np.ndarray, n: np.ndarray, square: np.ndarray, v: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(slot), MOVES):
        own = slice(i, i + MOVES)
        cols = [pa.array(slot[own].astype(np.int32)), *(pa.array(np.ascontiguousarray(c[own], np.float32)) for c in (n, square, *v.T))]
        yield pa.RecordBatch.from_arrays(cols, ["slot", "n", "square", *_VALUES])


def training_rows(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int) -> DataFrame:
    """Every labelled row of docs outside the held-out fold as shard, y, lang and the two bucket arrays of its words.

    A table in the shared folder: a shard's rows stand together, in the order of a hash.
    """
    known = labelled.known_labels(labels, label, modulus, held_out).hint("merge")  # one plan at any size
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.col("lang").cast("string").alias("lang")).filter(fold("doc_id", modulus) != held_out)
    sizes = own.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size")).join(known, "doc_id")
    size = sizes.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    shards = max(1, -(-size["rows"] // SHARD_ROWS), -(-size["bytes"] // SHARD_BYTES))

    def make():
        def encode(batch: pa.RecordBatch):
            parts = [word_ids(s) for s in textbuf.slices(batch.column("text"))]
            offsets = np.concatenate([[0], np.cumsum(np.concatenate([p[2] for p in parts]))]).astype(np.int32)
            cols = [pa.ListArray.from_arrays(offsets, np.concatenate([p[k] for p in parts])) for k in (0, 1)]
            return pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("y"), batch.column("lang"), *cols], ["shard", "y", "lang", "a", "b"])

        return encode

    dealt = labelled.may_be_known(own, known).join(known, "doc_id").withColumn("shard", F.pmod(F.xxhash64("doc_id", "text", F.lit(29)), F.lit(shards)).cast("int"))
    dealt = dealt.repartitionById(shards, "shard").sortWithinPartitions("shard", F.xxhash64("doc_id", "text", F.lit(17)), "doc_id").select("shard", "y", "lang", "text")
    return stored(map_batches(dealt, make, "shard int, y int, lang string, a array<int>, b array<int>"), "toxicity")


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of all lists, and where each begins."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], offsets - offsets[0]


def class_counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Rows of each class, and of each class those that hold each bucket (of words, then of stems)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, 2 * BUCKETS + 1), np.int64)
        for batch in batches:
            y = batch.column("y").to_numpy()
            n[:, -1] += np.bincount(y, minlength=2)
            for t in range(2):
                ids, begin = _lists(batch.column("ab"[t]))
                key = np.unique(ids.astype(np.int64) * len(y) + np.repeat(np.arange(len(y)), np.diff(begin)))
                bucket, c = key // max(1, len(y)), y[key % max(1, len(y))]
                for k in range(2):
                    n[k, t * BUCKETS : (t + 1) * BUCKETS] += np.bincount(bucket[c == k], minlength=BUCKETS)
        slot = np.flatnonzero(n.any(axis=0))
        for i in range(0, len(slot), MOVES):
            own = slot[i : i + MOVES]
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(n[0, own]), pa.array(n[1, own])], ["slot", "n0", "n1"])
        del n
        give_back()

    bounded_batches(rows.sparkSession)
    sums = rows.mapInArrow(run, "slot int, n0 long, n1 long").groupBy("slot").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()  # a row a bucket
    n = np.zeros((2, 2 * BUCKETS + 1), np.int64)
    n[:, sums["slot"].to_numpy()] = sums["n0"].to_numpy(), sums["n1"].to_numpy()
    return n[:, -1], n[:, :-1]


def train_epoch(rows: DataFrame, start: Learner, epoch: int, batch: int, rate: float, seed: int) -> None:
    """Train a branch of start on each shard, and move start by the branches' averages.

    Each bucket counts in a branch as often as the branch has updated it, so that
    one which few shards hold is not held back by the others.
    """
    start_b = rows.sparkSession.sparkContext.broadcast(start)  # 2 * BUCKETS * (DIM + 1) floats at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, own, piece = start_b.value, None, 0
        for part in batches:
            shard, y = part.column("shard").to_numpy(), part.column("y").to_numpy().astype(np.float32)
            (a, begin), (b, _) = _lists(part.column("a")), _lists(part.column("b"))
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1), len(shard)]
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                if low == high:
                    continue
                if own is None or shard[low] != own[0]:
                    if own:
                        yield from own[1].moves(begun)
                    own, piece = (shard[low], begun.branch()), 0
                order = np.random.default_rng([seed, epoch, int(own[0]), piece]).permutation(high - low) + low
                piece += 1
                for at in range(0, len(order), batch):
                    some = order[at : at + batch]
                    own[1].step([(a[begin[i] : begin[i + 1]], b[begin[i] : begin[i + 1]]) for i in some], y[some], rate)
        if own:
            yield from own[1].moves(begun)
        del begun, own
        give_back()

    bounded_batches(rows.sparkSession)
    moved = rows.mapInArrow(run, "slot int, n float, square float, " + ", ".join(f"{c} float" for c in _VALUES)).groupBy("slot")
    mean = moved.agg(*((F.sum(c) / F.sum("n")).cast("float").alias(c) for c in ("square", *_VALUES))).toArrow()  # a row a bucket
    start_b.destroy()
    start.move(mean["slot"].to_numpy(), mean["square"].to_numpy(), np.stack([mean[c].to_numpy() for c in _VALUES], axis=1))


def language_thresholds(scores: np.ndarray, y: np.ndarray, langs: list[str | None], least: int = 20, counts: np.ndarray | None = None) -> dict[str, float]:
    """For each language with enough rows of both classes the threshold of the best F1 (ties: the lowest). counts: rows that each score stands for."""
    out = {}
    names = np.array([x or "" for x in langs], dtype=object)
    counts = np.ones(len(names), np.int64) if counts is None else counts
    for lang in sorted(set(names) - {""}):
        own = names == lang
        s, t, n = scores[own], y[own], counts[own]
        if n[t == 1].sum() < least or n[t == 0].sum() < least:
            continue
        f1 = [2 * n[(s >= g) & (t == 1)].sum() / max(1, n[s >= g].sum() + n[t == 1].sum()) for g in GRID]
        out[lang] = float(GRID[int(np.argmax(f1))])
    return out


def train_thresholds(rows: DataFrame, net: ConvNet) -> dict[str, float]:
    """Thresholds of languages by the scores of all rows: counted by the largest number of GRID that a score reaches."""
    net_b = rows.sparkSession.sparkContext.broadcast(net)

    def make():
        def run(batch: pa.RecordBatch):
            (a, begin), (b, _) = _lists(batch.column("a")), _lists(batch.column("b"))
            reached = np.r_[0.0, GRID][np.searchsorted(GRID, net_b.value.scores(a, b, np.diff(begin)), "right")]
            return pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("y"), pa.array(reached)], ["lang", "y", "reached"])

        return run

    def best(pdf):
        found = language_thresholds(pdf["reached"].to_numpy(), pdf["y"].to_numpy(), pdf["lang"].tolist(), counts=pdf["count"].to_numpy())
        return pdf.head(len(found))[["lang"]].assign(threshold=list(found.values()))

    cells = map_batches(rows.filter("lang <> ''"), make, "lang string, y int, reached double").groupBy("lang", "y", "reached").count()
    found = cells.groupBy("lang").applyInPandas(best, "lang string, threshold double").collect()  # a row a language
    net_b.destroy()
    return {r["lang"]: r["threshold"] for r in sorted(found)}


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 4, held_out: int = 2, epochs: int = 4, batch: int = 64, rate: float = 0.02, seed: int = 5) -> ConvNet:
    """Fit on all labelled rows outside the held-out fold.

    Without rows, or with one class only among them, the score is the share of
    class 1 (0.5 without rows) for every text.
    """
    rows = training_rows(docs, labels, label, modulus, held_out)
    release(docs.sparkSession)
    (r0, r1), n = class_counts(rows)
    if not r0 or not r1:
        drop_stored(rows)
        return ConvNet.constant(r1 / (r0 + r1) if r0 + r1 else 0.5)
    net = ConvNet.start(np.random.default_rng(seed))
    for t in range(2):
        own = n[:, t * BUCKETS : (t + 1) * BUCKETS]
        net.tables[t][:, 0] = 0.5 * _odds(own[0], own[1], r0, r1)
    net.out_bias = float(np.log(r1 / r0))
    learner = Learner(net)
    for epoch in range(epochs):
        train_epoch(rows, learner, epoch, batch, rate, seed)
    net.thresholds = train_thresholds(rows, net)
    drop_stored(rows)
    return net


def score(docs: DataFrame, net: ConvNet, modulus: int = 4, held_out: int = 2, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Score every whole text.

    Returns doc_id, held_out, score, predicted (score >= threshold), threshold_lang
    and flagged: the decision by the threshold of the row's language (threshold
    where the language is null or unknown).  Null and empty texts get the score
    of a document without words.  Repeated rows are scored each; other columns
    are not read.
    """
    net_b = docs.sparkSession.sparkContext.broadcast(net)  # 2 * BUCKETS * DIM floats

    def make():
        def run(batch: pa.RecordBatch):
            model = net_b.value
            s = [model.scores(*word_ids(x)) for x in textbuf.slices(batch.column("text"))]
            cut = [model.thresholds.get(x, threshold) for x in batch.column("lang").to_pylist()]
            s = np.concatenate(s)
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32)), pa.array(cut, pa.float64()), pa.array(s >= np.array(cut))],
                ["doc_id", "held_out", "score", "predicted", "threshold_lang", "flagged"],
            )

        return run

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold("doc_id", modulus) == held_out).alias("held_out"), "text", F.col("lang").cast("string").alias("lang"))
    return map_batches(rows, make, "doc_id long, held_out boolean, score double, predicted int, threshold_lang double, flagged boolean")
