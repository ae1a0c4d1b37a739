"""A stored vector index of four bits a component, with inserts, removals and exact re-scoring.

A vector is rotated by a fixed random rotation, after which its components look
like draws of one bell curve, and each becomes the number of the nearest of 16
levels that suit that curve.  A scale a vector makes the estimate of an inner
product right on average.  Codes are a Parquet table in batches: an insert or a
removal writes a batch of its own, the newest row of an id counts, and compact()
writes what counts as one batch.  A search compares rotated queries with decoded
vectors tile by tile.  Exact similarities of some times as many rows as asked for,
those of the best estimates, tell what any other row has to reach; those whose
code leaves room for that get their exact similarity too, so the result is exact.

The scale makes a decoded vector differ from its own by something at right angles
to it, of a length that is told by both lengths.  So for a query q and a vector x
of similarity s, the estimate is off by at most that length times the length of
the part of q at right angles to x, sqrt(|q|^2 - s^2 / |x|^2).

Vectors are cut or filled up with zeros to the index's length.  Null vectors are
not indexed; of equal ids in one insert the largest vector counts.  One writer at
a time; a batch that fails halfway leaves nothing that readers see.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import drop_path, fresh_path
from . import tiles
from .vector import fit_dim

LEVELS = 16
ROW = "id long, scale double, size double, code binary"
#: Room for rounding in estimates, a share of the lengths of both vectors.
ROUND = 1e-9


@lru_cache
def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(dim).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


@lru_cache
def levels() -> np.ndarray:
    """Values that represent a standard normal variable with the least square error: each is the mean of what is nearest to it."""
    x = np.linspace(-6, 6, 24_001)
    p = np.exp(-x * x / 2)
    at = np.linspace(-2.5, 2.5, LEVELS)
    for _ in range(200):
        cell = np.searchsorted((at[1:] + at[:-1]) / 2, x)
        at = np.bincount(cell, x * p, LEVELS) / np.bincount(cell, p, LEVELS)
    return at


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scale of each row, codes of two components a byte)."""
    r = x @ rotation(x.shape[1]).T
    size = np.sqrt((r * r).sum(1)) / np.sqrt(x.shape[1])
    at = levels()
    code = np.searchsorted((at[1:] + at[:-1]) / 2, r / np.where(size > 0, size, 1)[:, None]).astype(np.uint8)
    near = at[code]
    inner = (near * r).sum(1)
    scale = np.divide((r * r).sum(1), inner, out=np.zeros(len(x)), where=inner > 0)
    code = np.pad(code, ((0, 0), (0, x.shape[1] % 2)))
    return scale, code[:, ::2] << 4 | code[:, 1::2]


def decode(scale: np.ndarray, code: np.ndarray, dim: int) -> np.ndarray:
    """Vectors in rotated space."""
    parts = np.stack([code >> 4, code & 15], axis=2).reshape(len(code), -1)[:, :dim]
    return levels()[parts] * scale[:, None]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.ravel())


@dataclass
class VectorIndex:
    spark: SparkSession
    path: str
    dim: int

    @classmethod
    def create(cls, spark: SparkSession, dim: int, path: str | None = None) -> VectorIndex:
        made = cls(spark, path or fresh_path(spark, "index"), dim)
        spark.createDataFrame([], ROW).write.parquet(f"{made.path}/batch=0")
        return made

    def _batches(self) -> DataFrame:
        return self.spark.read.schema(f"{ROW}, batch long").parquet(self.path)

    def _append(self, rows: DataFrame) -> None:
        last = self._batches().agg(F.max("batch")).first()[0]
        names = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        found = names.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(names)  # a folder a batch, also where it has no rows
        number = max([last or 0, *(int(f.getPath().getName()[6:]) for f in found if f.getPath().getName().startswith("batch="))]) + 1
        rows.write.parquet(f"{self.path}/batch={number}")

    def insert(self, vectors: DataFrame) -> None:
        """Add vectors (id, vector); ids that are there get new ones."""
        dim = self.dim
        rows = vectors.filter("id is not null and vector is not null").groupBy(F.col("id").cast("long").alias("id")).agg(F.max(F.col("vector").cast("array<double>")).alias("vector"))
        rows = tiles.usable(rows.select("id", fit_dim(F.col("vector"), dim).alias("vector")))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x = _matrix(b.column("vector"), dim)
                    scale, code = encode(x)
                    size = np.sqrt((x * x).sum(1))
                    yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(scale), pa.array(size), pa.array([c.tobytes() for c in code], pa.binary())], ["id", "scale", "size", "code"])

        self._append(rows.mapInArrow(run, ROW))

    def remove(self, ids: DataFrame) -> None:
        self._append(ids.filter("id is not null").select(F.col("id").cast("long").alias("id")).distinct().selectExpr("id", "cast(null as double) as scale", "cast(null as double) as size", "cast(null as binary) as code"))

    def codes(self) -> DataFrame:
        """(id, scale, size, code) of what is indexed."""
        newest = self._batches().groupBy("id").agg(F.max(F.struct("batch", "scale", "size", "code")).alias("row"))
        return newest.select("id", "row.scale", "row.size", "row.code").filter("code is not null")

    def compact(self) -> None:
        """One batch in place of all; readers of the old ones have to begin again."""
        old = [r["batch"] for r in self._batches().select("batch").distinct().collect()]  # a row a batch
        self._append(self.codes())
        for n in old:
            drop_path(self.spark, f"{self.path}/batch={n}")

    def decoded(self) -> DataFrame:
        """(id, vector in rotated space, size): size is the length of what was inserted."""
        dim = self.dim

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    code = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(b.num_rows, -1)
                    yield pa.RecordBatch.from_arrays([b.column("id"), _lists(decode(b.column("scale").to_numpy(), code, dim)), b.column("size")], ["id", "vector", "size"])

        return self.codes().mapInArrow(run, "id long, vector array<double>, size double")

    def search(self, queries: DataFrame, vectors: DataFrame, k: int, over: int = 4) -> DataFrame:
        """(query, id, sim, rank): the k most similar rows by the exact inner products with vectors (id, vector), those that were inserted; ties to the smaller id.

        A row travels as its decoded vector followed by its own, a query as the rotated one followed by its own.
        """
        dim = self.dim
        q = tiles.usable(queries.select(F.col("query").cast("long").alias("id"), fit_dim(F.col("vector").cast("array<double>"), dim).alias("vector")))

        def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x = _matrix(b.column("vector"), dim)
                    yield pa.RecordBatch.from_arrays([b.column("id"), _lists(np.hstack([x @ rotation(dim).T, x]))], ["id", "vector"])

        def pick(t: tiles.Tile, i: slice, v: tiles.Tile, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            x, y, size = t.x[i][:, dim:], v.x[:, dim:], v.extra["size"]
            est = t.x[i][:, :dim] @ v.x[:, :dim].T
            full = np.sqrt((v.x[:, :dim] ** 2).sum(1))
            off = np.sqrt(np.maximum(full * full - size * size, 0)) + ROUND * full  # how far decoded vectors are from their own
            first = min(k * over, len(y))
            if first >= k and (low == -np.inf).any():
                some = np.argpartition(-est, first - 1, axis=1)[:, :first]
                sims = tiles.exact(np.repeat(x, first, axis=0), y[some.ravel()]).reshape(some.shape)
                low = np.maximum(low, np.partition(sims, first - k, axis=1)[:, first - k])
            length, least = np.sqrt((x * x).sum(1))[:, None], low[:, None]
            along = np.divide(np.maximum(least, 0), size, out=np.zeros(est.shape), where=size > 0)
            aside = np.sqrt(np.maximum(length * length - along * along, 0)) + np.sqrt(ROUND) * length
            p, r = np.nonzero(est >= least - off * aside - ROUND * length * full)
            return p, r, tiles.exact(x[p], y[r])

        own = vectors.select("id", fit_dim(F.col("vector").cast("array<double>"), dim).alias("own"))
        rows = self.decoded().join(own, "id").select("id", F.concat("vector", "own").alias("vector"), "size")
        stock = tiles.tiled(rows, ("size",))
        return tiles.topk(tiles.tiled(q.mapInArrow(turned, "id long, vector array<double>"), at=stock.pivots), stock, k, pick=pick)
