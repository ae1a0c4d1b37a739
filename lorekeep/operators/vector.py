"""Exact similarity of a set of queries with all vectors: queries are broadcast a bounded pass at a time, vectors stream past.

Tables that meet themselves or another corpus are compared in operators/tiles.py.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import stored

#: Queries broadcast at once, and vectors and queries multiplied at once.
PASS, VECTOR_BLOCK, QUERY_BLOCK = 16_384, 2_048, 512
Kernel = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def unit(c: Column) -> Column:
    """Scaled to length 1; shorter than 1e-10 stays as it is."""
    v = F.transform(c, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(v, lambda x: x / F.when(norm < 1e-10, 1.0).otherwise(norm))


def fit_dim(c: Column, dim: int) -> Column:
    """Cut or filled up with zeros to dim components."""
    return F.slice(F.concat(c, F.array_repeat(F.lit(0.0), dim)), 1, dim)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine within [0, 2]; 1 for different lengths."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)
    return F.when(F.size(a) != F.size(b), 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(2.0), 1 - dot)))


def _dots(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products, components added one after another in double precision."""
    out = np.zeros((len(x), len(q)))
    for d in range(x.shape[1]):
        out += x[:, d, None] * q[None, :, d]
    return out


def compare(queries: DataFrame, vectors: DataFrame, select: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(query, id, sim) of the pairs that select(query ids, ids, similarities ids x queries) marks.

    Vectors of another length than a query's don't meet it.
    """
    spark = queries.sparkSession
    schema = "query long, id long, sim double"
    out = None

    def one(ids: list[int], vecs: list) -> DataFrame:
        block = spark.sparkContext.broadcast((np.array(ids, np.int64), np.array([np.asarray(v, np.float64) for v in vecs])))

        def run(batches):
            qid, q = block.value
            for batch in batches:
                for i in range(0, batch.num_rows, VECTOR_BLOCK):
                    part = batch.slice(i, VECTOR_BLOCK)
                    col = part.column("vector")
                    size = np.diff(col.offsets.to_numpy())
                    part = part.filter(pa.array(size == q.shape[1]))
                    if not part.num_rows:
                        continue
                    x = part.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)
                    vid = part.column("id").to_numpy()
                    for j in range(0, len(qid), QUERY_BLOCK):
                        sims = _dots(x, q[j : j + QUERY_BLOCK])
                        at, to = np.nonzero(select(qid[j : j + QUERY_BLOCK], vid, sims))
                        yield pa.RecordBatch.from_arrays([pa.array(qid[j : j + QUERY_BLOCK][to]), pa.array(vid[at]), pa.array(sims[at, to])], ["query", "id", "sim"])

        return vectors.select("id", "vector").mapInArrow(run, schema)

    ids, vecs, dim = [], [], None
    for r in queries.select("query", "vector").orderBy(F.size("vector"), "query").toLocalIterator():
        if ids and (len(ids) == PASS or len(r["vector"]) != dim):
            part = one(ids, vecs)
            out, ids, vecs = part if out is None else out.union(part), [], []
        dim = len(r["vector"])
        ids.append(r["query"])
        vecs.append(r["vector"])
    if ids:
        part = one(ids, vecs)
        out = part if out is None else out.union(part)
    return out if out is not None else spark.createDataFrame([], schema)


def cosine_topk(queries: DataFrame, vectors: DataFrame, k: int, drop_self: bool = False) -> DataFrame:
    """(query, id, sim, rank): the k most similar vectors of each query, ties to the smaller id."""

    def select(qid, vid, sims):
        s = np.where(qid[None, :] == vid[:, None], -np.inf, sims) if drop_self else sims
        if len(vid) <= k:
            return s > -np.inf
        return s >= np.partition(s, len(s) - k, axis=0)[len(s) - k]

    order = Window.partitionBy("query").orderBy(F.desc("sim"), "id")
    return compare(queries, vectors, select).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mean_centered(vectors: DataFrame) -> DataFrame:
    """Vectors less the corpus mean, scaled to length 1 again."""
    mean = vectors.select(F.posexplode("vector").alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    row = mean.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mean"))  # one value a dimension
    row = stored(row, "mean")
    shifted = vectors.crossJoin(F.broadcast(row)).select("id", F.zip_with("vector", "mean", lambda x, m: x.cast("double") - m).alias("vector"))
    return shifted.select("id", unit(F.col("vector")).alias("vector"))
