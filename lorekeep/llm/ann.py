"""Approximate nearest neighbours by randomly rotated one-bit codes.

Vectors are centred, scaled to length 1 and rotated by a random orthogonal matrix;
the signs of the rotated components, packed into bits, are the code, kept with two
correction scalars: the distance from the centre and the inner product of the
vector with its code.  The inner product of a query with the code, summed from
tables of the packed bytes and divided by the second scalar, estimates that with
the vector without bias, and its error has a bound that holds with high
probability.  A task compares the vectors that look nearest first, so that the
k-th best distance is soon small; from then on only vectors whose smallest
possible distance is below it are compared.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import stored
from .session import map_batches

#: Standard deviations of the estimator that the error bound covers: a vector's distance is below the bound in 3 % of cases.
EPSILON = 1.9
SEED = 20240521
#: Vectors that a query of a task is first compared with, those that look nearest, for each of its k places.
TRIES = 16
#: Queries that are broadcast at once, and vectors compared with them at once.
QUERY_BLOCK, QUERY_PASS, VECTOR_BLOCK = 256, 16_384, 8_192


def usable(c: Column) -> Column:
    """Vectors that take part: not null, no null or non-finite component, not zero."""
    good = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(good & F.exists(c, lambda x: x != 0), F.lit(False))


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


@dataclass
class Index:
    """rows: vec_id, vector, code, norm, dot of every usable vector of dim components."""

    rows: DataFrame
    dim: int
    center: np.ndarray


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def build(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> Index:
    """Encode every usable vector. Those of another length than most (ties: the shorter) take no part."""
    spark = vectors.sparkSession
    v = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vector")).filter(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    sizes = v.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return Index(v.select("*", F.lit(b"").alias("code"), F.lit(0.0).alias("norm"), F.lit(1.0).alias("dot")), 0, np.zeros(0))
    dim = sizes["d"]
    v = v.filter(F.size("vector") == dim)

    def sums(batches):
        total, n = np.zeros(dim), 0
        for batch in batches:
            x = _matrix(batch.column("vector"), dim)
            total, n = total + x.sum(0), n + len(x)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64())), pa.array([n], pa.int64())], ["total", "n"])

    parts = v.select("vector").mapInArrow(sums, "total array<double>, n long").select(F.col("n"), F.posexplode("total").alias("i", "x"))
    rows = parts.groupBy("i").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).collect()  # dim rows
    center = np.zeros(dim)
    for r in rows:
        center[r["i"]] = r["x"] / max(1, r["n"])
    turn_b = spark.sparkContext.broadcast((center, rotation(dim)))

    def make():
        c, turn = turn_b.value

        def run(batch: pa.RecordBatch):
            x = _matrix(batch.column("vector"), dim) - c
            norm = np.sqrt(np.einsum("ij,ij->i", x, x))
            unit = (x / np.where(norm > 0, norm, 1)[:, None]) @ turn
            bits = unit >= 0
            dot = np.abs(unit).sum(1) / np.sqrt(dim)
            code = [r.tobytes() for r in np.packbits(bits, axis=1)]
            return pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vector"), pa.array(code, pa.binary()), pa.array(norm), pa.array(np.where(norm > 0, dot, 1.0))], ["vec_id", "vector", "code", "norm", "dot"])

        return run

    return Index(stored(map_batches(v, make, "vec_id long, vector array<double>, code binary, norm double, dot double"), "codes"), dim, center)


def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows, components added one after another."""
    total = np.zeros(len(x))
    for d in range(x.shape[1]):
        diff = x[:, d] - y[:, d]
        total += diff * diff
    return np.sqrt(total)


def byte_tables(unit: np.ndarray) -> np.ndarray:
    """For each packed byte of a code, value of the byte and query: the inner product with the signs in that byte."""
    dim = unit.shape[1]
    signs = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float32) * 2 - 1
    padded = np.zeros((len(unit), -(-dim // 8) * 8), np.float32)
    padded[:, :dim] = unit
    return np.einsum("vj,qbj->bvq", signs, padded.reshape(len(unit), -1, 8)).astype(np.float32)


class Nearest:
    """The k nearest found so far of each query of a block; compared counts vectors compared by all components."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, center: np.ndarray, turn: np.ndarray, k: int, epsilon: float) -> None:
        self.ids, self.q, self.k, self.epsilon = ids, q, k, epsilon
        x = q - center
        self.norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        self.tables = byte_tables((x / np.where(self.norm > 0, self.norm, 1)[:, None]) @ turn)
        self.limit = np.full(len(q), np.inf)
        self.compared = 0
        self.found: tuple[np.ndarray, np.ndarray, np.ndarray] = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def add(self, ids: np.ndarray, x: np.ndarray, code: np.ndarray, norm: np.ndarray, dot: np.ndarray) -> None:
        """Vectors x with their packed codes (a row each), norms and inner products with their codes."""
        dim = x.shape[1]
        inner = self.tables[0][code[:, 0]]
        for b in range(1, code.shape[1]):
            inner += self.tables[b][code[:, b]]
        # squared distance as estimated, and how much less it can be
        far = (2 * norm / (np.sqrt(dim) * dot)).astype(np.float32)
        inner *= far[:, None]
        inner *= self.norm.astype(np.float32)
        square = (norm**2).astype(np.float32)[:, None] + (self.norm**2).astype(np.float32) - inner
        error = 2 * norm * self.epsilon * np.sqrt(np.maximum(1 - dot**2, 0) / dot**2 / max(1, dim - 1))
        own = np.flatnonzero(np.isin(ids, self.ids))
        if len(own):
            square[own] = np.where(ids[own][:, None] == self.ids[None, :], np.inf, square[own])
        slack = 1e-5 * (1 + float((norm**2).max(initial=0)) + float((self.norm**2).max(initial=0)))  # single precision
        tried = None
        if np.isinf(self.limit).any() and len(ids) > 2 * TRIES * self.k:
            near = np.argpartition(square, TRIES * self.k - 1, axis=0)[: TRIES * self.k]
            to = np.broadcast_to(np.arange(len(self.ids)), near.shape)
            ok = np.isfinite(square[near, to])
            tried = (near[ok], to[ok])
            self._compare(ids, x, *tried)
            square[tried] = np.inf
        most = self.limit**2 + slack
        at, to = np.nonzero(square <= most[None, :] + (error[:, None] * self.norm[None, :]).astype(np.float32))
        good = np.isfinite(square[at, to])
        self._compare(ids, x, at[good], to[good])

    def _compare(self, ids: np.ndarray, x: np.ndarray, at: np.ndarray, to: np.ndarray) -> None:
        """Exact distances of vectors at to queries to; those that can be among the k nearest are kept."""
        self.compared += len(at)
        at_kept, to_kept, dist_kept = [], [], []
        for i in range(0, len(at), 1 << 15):
            a, t = at[i : i + (1 << 15)], to[i : i + (1 << 15)]
            diff = x[a] - self.q[t]
            rough = np.einsum("ij,ij->i", diff, diff)
            ok = rough <= self.limit[t] ** 2 * (1 + 1e-9) + 1e-12
            at_kept.append(a[ok])
            to_kept.append(t[ok])
            dist_kept.append(exact(x[a[ok]], self.q[t[ok]]))
        if not sum(map(len, at_kept)):
            return
        to, vec, dist = (np.concatenate(p) for p in zip(self.found, (np.concatenate(to_kept), ids[np.concatenate(at_kept)], np.concatenate(dist_kept)), strict=True))
        order = np.lexsort((vec, dist, to))
        to, vec, dist = to[order], vec[order], dist[order]
        pair = np.unique(np.stack([to, vec]), axis=1, return_index=True)[1]  # of a repeated id the nearest
        pair.sort()
        to, vec, dist = to[pair], vec[pair], dist[pair]
        first = np.searchsorted(to, np.arange(len(self.ids)))
        place = np.arange(len(to)) - first[to] if len(to) else np.zeros(0, np.int64)
        keep = place < self.k
        last = place == self.k - 1
        self.limit[to[last]] = dist[last]
        self.found = to[keep], vec[keep], dist[keep]


def search(index: Index, queries: DataFrame, k: int = 10, epsilon: float = EPSILON) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query (vec_id, vector), itself left out.

    Queries are a stated set that meets all vectors in blocks: QUERY_PASS of them
    are broadcast at a time, each task keeps k a query, and what tasks found is
    merged by one shuffle.  Ties go to the smaller vec_id.  Of queries with the
    same id the one with the smallest vector counts; of rows with the same
    vec_id the nearest.
    """
    spark = index.rows.sparkSession
    dim, center = index.dim, index.center
    schema = "query_id long, vec_id long, score double"
    found = spark.createDataFrame([], schema)
    if dim:
        turn = rotation(dim)

        def passed(ids: list[int], vectors: list[list[float]]) -> DataFrame:
            block_b = spark.sparkContext.broadcast((np.array(ids, np.int64), np.array(vectors, np.float64)))

            def run(batches):
                ids, q = block_b.value
                blocks = [Nearest(ids[i : i + QUERY_BLOCK], q[i : i + QUERY_BLOCK], center, turn, k, epsilon) for i in range(0, len(ids), QUERY_BLOCK)]
                for batch in batches:
                    for i in range(0, batch.num_rows, VECTOR_BLOCK):
                        b = batch.slice(i, VECTOR_BLOCK)
                        x = _matrix(b.column("vector"), dim)
                        packed = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(len(x), -1)
                        own = [b.column(c).to_numpy() for c in ("vec_id", "norm", "dot")]
                        for near in blocks:
                            near.add(own[0], x, packed, own[1], own[2])
                for near in blocks:
                    to, vec, dist = near.found
                    yield pa.RecordBatch.from_arrays([pa.array(near.ids[to]), pa.array(vec), pa.array(dist)], ["query_id", "vec_id", "score"])

            return index.rows.mapInArrow(run, schema)

        ids: list[int] = []
        vectors: list[list[float]] = []
        rows = queries.filter(F.size("vector") == dim).groupBy("vec_id").agg(F.min("vector").alias("vector"))
        passes = []
        for r in rows.toLocalIterator():
            ids.append(r["vec_id"])
            vectors.append(r["vector"])
            if len(ids) == QUERY_PASS:
                passes.append(passed(ids, vectors))
                ids, vectors = [], []
        if ids:
            passes.append(passed(ids, vectors))
        for p in passes:
            found = found.union(p)
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
