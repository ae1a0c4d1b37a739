"""Packing into optimal length buckets.

Dynamic programming over the global histogram of document lengths chooses at most
n_buckets bucket lengths so that padding every document to the length of its
bucket wastes the fewest tokens.  Within a bucket documents follow each other by
doc_id and fill batches of a token budget: budget // bucket length documents each,
one where the budget is shorter than the bucket.  Documents are never cut.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import stored
from .session import small_table
from .tokens import token_counts

N_BUCKETS = 16
TOKEN_BUDGET = 65_536


def boundaries(lengths: np.ndarray, counts: np.ndarray, n_buckets: int = N_BUCKETS) -> list[int]:
    """Bucket lengths of least total padding for ascending distinct lengths.

    Exact: the cost of the best k buckets up to a length is a minimum over lines
    in that length, kept as a lower envelope, so each k takes linear time.  Of
    equally good choices the one with fewer buckets stays.
    """
    m = len(lengths)
    if not m:
        return []
    size = [int(x) for x in lengths]
    below = np.concatenate([[0], np.cumsum(counts)]).tolist()
    tokens = np.concatenate([[0], np.cumsum(np.asarray(lengths, np.int64) * counts)]).tolist()
    # best[j]: least padded tokens of the first j lengths; last bucket i..j-1 costs size[j-1] * (below[j] - below[i])
    best = [0, *[size[j - 1] * below[j] for j in range(1, m + 1)]]
    choice = [[0] * (m + 1)]
    for _ in range(1, min(n_buckets, m)):
        new, origin = best[:], [-1] * (m + 1)
        hull: list[int] = []
        at = 0

        def value(i: int, x: int, best=best) -> int:
            return best[i] - below[i] * x

        def useless(a: int, b: int, c: int, best=best) -> bool:
            # line b never lies below both a and c; slopes -below fall
            return (best[c] - best[a]) * (below[b] - below[a]) <= (best[b] - best[a]) * (below[c] - below[a])

        for j in range(1, m + 1):
            i = j - 1
            if i:
                while len(hull) >= 2 and useless(hull[-2], hull[-1], i):
                    hull.pop()
                hull.append(i)
                at = min(at, len(hull) - 1)
            x = size[j - 1]
            while at + 1 < len(hull) and value(hull[at + 1], x) <= value(hull[at], x):
                at += 1
            if hull and (v := value(hull[at], x) + x * below[j]) < new[j]:
                new[j], origin[j] = v, hull[at]
        choice.append(origin)
        if new[m] == best[m]:
            choice.pop()
            break
        best = new
    out, j, k = [], m, len(choice) - 1
    while j:
        out.append(size[j - 1])
        while k and choice[k][j] < 0:
            k -= 1
        j, k = (choice[k][j], k - 1) if k else (0, 0)
    return out[::-1]


def padding(lengths: np.ndarray, counts: np.ndarray, bounds: list[int]) -> int:
    to = np.asarray(bounds)[np.searchsorted(bounds, lengths)]
    return int(((to - lengths) * counts).sum())


def pack_lengths(rows: DataFrame, n_buckets: int = N_BUCKETS, budget: int = TOKEN_BUDGET) -> DataFrame:
    """Add bucket, bucket_tokens, batch_id, slot and padding to rows (doc_id, n_tokens).

    Buckets and batches are numbered from 0, by length and then by doc_id (null
    first); repeated rows each get a slot.  No rows give no rows.
    """
    rows = stored(rows.select("doc_id", "n_tokens"), "lengths")
    histogram = rows.groupBy("n_tokens").count().orderBy("n_tokens").toArrow()  # a row for each distinct length
    bounds = boundaries(histogram["n_tokens"].to_numpy(), histogram["count"].to_numpy(), n_buckets)
    limits = np.array(bounds, np.int64)
    capacity = np.maximum(1, budget // np.maximum(limits, 1))

    def number(batches):
        seen = np.zeros(max(1, len(limits)), np.int64)
        for batch in batches:
            bucket, part = (batch.column(c).to_numpy() for c in ("bucket", "part"))
            order = np.argsort(bucket, kind="stable")
            place = np.empty(len(bucket), np.int64)
            runs = np.bincount(bucket, minlength=len(seen))
            place[order] = np.arange(len(bucket)) - np.repeat(np.cumsum(runs) - runs, runs) + np.repeat(seen, runs)
            seen += runs
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_tokens"), pa.array(bucket), pa.array(part), pa.array(place)], ["doc_id", "n_tokens", "bucket", "part", "place"])

    of = F.lit(0)
    for b in bounds[:-1]:
        of = of + (F.col("n_tokens") > b).cast("int")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("bucket", of).repartitionByRange(parts, "bucket", "doc_id").sortWithinPartitions("bucket", "doc_id", "n_tokens").withColumn("part", F.spark_partition_id())
    numbered = stored(dealt.mapInArrow(number, "doc_id long, n_tokens long, bucket int, part int, place long"), "places")
    # rows of a bucket in earlier parts: as many rows as buckets and parts
    sums = numbered.groupBy("bucket", "part").agg(F.count("*").alias("k"))
    before = sums.withColumn("before", F.sum("k").over(Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("bucket", "part", F.coalesce("before", F.lit(0)).alias("before"))
    per_bucket = {r["bucket"]: r["k"] for r in sums.groupBy("bucket").agg(F.sum("k").alias("k")).collect()}
    first, table = 0, []
    for b, (limit, cap) in enumerate(zip(limits.tolist(), capacity.tolist(), strict=True)):
        table.append((b, limit, cap, first))
        first += -(-per_bucket.get(b, 0) // cap)
    facts = small_table(rows.sparkSession, table, "bucket int, bucket_tokens long, capacity long, first long")
    at = F.col("place") + F.col("before")
    return (
        numbered.join(F.broadcast(before), ["bucket", "part"])  # buckets times parts rows
        .join(F.broadcast(facts), "bucket")  # n_buckets rows
        .select(
            "doc_id", "n_tokens", "bucket", "bucket_tokens",
            (F.col("first") + F.floor(at / F.col("capacity"))).cast("long").alias("batch_id"),
            (at % F.col("capacity")).cast("long").alias("slot"),
            (F.col("bucket_tokens") - F.col("n_tokens")).alias("padding"),
        )
    )


def pack(docs: DataFrame, tokenizer: str, end_id: int | None = 2, n_buckets: int = N_BUCKETS, budget: int = TOKEN_BUDGET) -> DataFrame:
    """Pack the documents by their lengths in tokens, end id included. Null and empty texts are the end id alone."""
    return pack_lengths(token_counts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), tokenizer, end_id), n_buckets, budget)
