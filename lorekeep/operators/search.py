"""Hybrid retrieval: fusion, weights, caps, expansion, routing and reranking of candidates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import TYPE_BOOST, classify_intent, recency_weight, salience_weight
from ..sources.shared import stored
from .bm25 import bm25_topk
from .vector import cosine_topk

ALPHA, DECAY, SEEDS = 0.7, 0.85, 5


def rank_norm(rank: Column, n: Column) -> Column:
    """1 for the first, 0 for the last; 1 if there is one."""
    return F.when(n <= 1, 1.0).otherwise(1 - (rank - 1) / (n - 1))


def candidates(queries: DataFrame, texts: DataFrame, vectors: DataFrame, n_cos: int, n_bm25: int) -> DataFrame:
    """(query, id, cos, cos_rank, bm25, bm25_rank) of both arms, absent scores 0; ranks before any filter."""
    cos = cosine_topk(queries.filter("vector is not null"), vectors, n_cos).select("query", "id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "sim")).alias("cos"), F.col("rank").alias("cos_rank"))
    bm = bm25_topk(queries, texts.select("id", "content"), n_bm25).select("query", "id", F.col("rank").alias("bm25_rank"))
    n = F.count("*").over(Window.partitionBy("query"))
    bm = bm.withColumn("bm25", rank_norm(F.col("bm25_rank"), n))
    return cos.join(bm, ["query", "id"], "full_outer").fillna(0.0, ["cos", "bm25"])


def hybrid_search(
    queries: DataFrame, memories: DataFrame, vectors: DataFrame, n: int, now: Column, alpha: float = ALPHA, type_: str | None = None, project: str | None = None,
    exclude_superseded: bool = True, edges: DataFrame | None = None, texts: DataFrame | None = None,
) -> DataFrame:
    """(query, id, distance, score, rank): cosine and BM25 candidates fused, weighted by recency and salience.

    Filters apply after the over-fetch (10 n candidates by cosine with a type
    filter, else 30 n; 5 n by BM25). Without a type filter at most 40 % of n,
    one at least, may have the same type, so fewer than n rows are possible.
    With edges, graph neighbours of the best rows are added before the cut.
    texts (id, content): where BM25 reads texts, if not from memories.
    """
    alpha = min(1.0, max(0.0, alpha))
    cand = candidates(queries, texts if texts is not None else memories, vectors, n * (10 if type_ else 30), n * 5)
    m = memories.select("id", "type", "project", "ts", "salience", "superseded_by")
    rows = cand.join(m, "id")
    if type_:
        rows = rows.filter(F.col("type") == type_)
    if project:
        rows = rows.filter(F.col("project") == project)
    if exclude_superseded:
        rows = rows.filter("superseded_by is null")
    hybrid = alpha * F.col("cos") + (1 - alpha) * F.col("bm25")
    score = salience_weight(F.coalesce("salience", F.lit(0.5))) * recency_weight(F.col("ts"), now) * hybrid
    distance = F.when(F.col("cos_rank").isNull(), 1.0).otherwise(1 - F.col("cos"))
    scored = rows.select("query", "id", "type", distance.alias("distance"), F.round(score, 9).alias("score"), F.coalesce("cos_rank", F.lit(1 << 30)).alias("o1"), F.coalesce("bm25_rank", F.lit(1 << 30)).alias("o2"))
    order = [F.desc("score"), F.col("o1"), F.col("o2"), F.col("id")]
    if edges is not None:
        scored = stored(scored, "scored")  # queries times candidates, read three times
        scored = graph_expand(scored.select("query", "id", "type", "distance", "score", "o1", "o2"), edges, memories, n, type_, project)
    if not type_:
        scored = diversity_cap(scored, n, order)
    best = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).filter(F.col("rank") <= n)
    return best.select("query", "id", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"), "rank")


def diversity_cap(rows: DataFrame, n: int, order: list[Column], share: float = 0.4) -> DataFrame:
    """At most max(1, ceil(share * n)) rows of a type for each query, in order."""
    cap = max(1, math.ceil(share * n))
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy("query", "type").orderBy(*order))).filter(F.col("_k") <= cap).drop("_k")


def graph_expand(scored: DataFrame, edges: DataFrame, memories: DataFrame, n: int, type_: str | None = None, project: str | None = None, decay: float = DECAY) -> DataFrame:
    """Add neighbours (by a shared entity) of the top min(n, 5) rows: the best seed's score times decay, n at most, existing rows untouched.

    Edges are met twice by equi-joins on memory and entity; a hub entity meets
    only the seeds that mention it.
    """
    seeds = scored.withColumn("_r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "o1", "o2", "id"))).filter(F.col("_r") <= min(n, SEEDS))
    per_entity = seeds.join(edges, seeds["id"] == edges["memory"]).groupBy("query", "entity").agg(F.max("score").alias("seed"))
    near = per_entity.join(edges, "entity").groupBy("query", F.col("memory").alias("id")).agg(F.round(F.max("seed") * decay, 9).alias("score"))
    new = near.join(scored.select("query", "id"), ["query", "id"], "left_anti")
    m = memories.filter("superseded_by is null")
    if type_:
        m = m.filter(F.col("type") == type_)
    if project:
        m = m.filter(F.col("project") == project)
    new = new.join(m.select("id", "type"), "id")
    new = new.withColumn("_r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).filter(F.col("_r") <= n)
    return scored.unionByName(new.select("query", "id", "type", F.lit(1.0).alias("distance"), "score", F.lit((1 << 30) + 1).alias("o1"), F.lit((1 << 30) + 1).alias("o2")))


def rrf_fusion(cos: DataFrame, bm: DataFrame, n_docs: Column, k: int = 60) -> DataFrame:
    """(query, id, rrf): 1/(k+rank) of both arms; a row absent from one has rank n_docs + 1 there."""
    both = cos.select("query", "id", F.col("rank").alias("rc")).join(bm.select("query", "id", F.col("rank").alias("rb")), ["query", "id"], "full_outer")
    return both.select("query", "id", F.round(1 / (k + F.coalesce("rc", n_docs + 1)) + 1 / (k + F.coalesce("rb", n_docs + 1)), 9).alias("rrf"))


def alpha_fusion(cos: DataFrame, bm: DataFrame, n_docs: Column, alpha: Column) -> DataFrame:
    """(query, id, fused) of the offline variant: (sim + 1) / 2 and 1 - (rank - 1) / max(1, n_docs - 1)."""
    both = cos.select("query", "id", "sim").join(bm.select("query", "id", F.col("rank").alias("rb")), ["query", "id"], "full_outer")
    b = F.when(F.col("rb").isNull(), 0.0).otherwise(1 - (F.col("rb") - 1) / F.greatest(F.lit(1), n_docs - 1))
    c = F.coalesce((F.col("sim") + 1) / 2, F.lit(0.0))
    return both.select("query", "id", F.round(alpha * c + (1 - alpha) * b, 9).alias("fused"))


def rerank(results: DataFrame, prefix: str = "vault/") -> DataFrame:
    """Add adjusted distance and rank: -0.12 under the prefix, +0.08 for short contents under long queries; stable."""
    words = lambda c: F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != ""))
    short = (words(F.col("text")) >= 12) & (words(F.col("content")) > 0) & (words(F.col("content")) < 40)
    adj = F.round(F.col("distance") - F.when(F.col("path").startswith(prefix), 0.12).otherwise(0.0) + F.when(short, 0.08).otherwise(0.0), 6)
    return results.withColumn("adjusted", adj).withColumn("new_rank", F.row_number().over(Window.partitionBy("query").orderBy("adjusted", "pos")))


def template_search(hits: DataFrame, queries: DataFrame, n: int = 10) -> DataFrame:
    """Type-boosted merge of ranked hits (query, id, type, rank): first the boosted types' hits, then all; first wins; n rows."""
    boost = F.create_map(*[x for k, v in TYPE_BOOST.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    q = queries.select("query", boost[classify_intent(F.col("text"))].alias("types"))
    rows = hits.join(F.broadcast(q), "query")
    per = max(n // 2, 5)
    boosted = rows.withColumn("arm", F.array_position(F.coalesce("types", F.array().cast("array<string>")), F.col("type")))
    boosted = boosted.filter("arm > 0").withColumn("k", F.row_number().over(Window.partitionBy("query", "arm").orderBy("rank"))).filter(F.col("k") <= per)
    general = rows.filter(F.col("rank") <= n).withColumn("arm", F.lit(1 << 20)).withColumn("k", F.col("rank"))
    cols = ["query", "id", "type", "arm", "k"]
    first = boosted.select(cols).union(general.select(cols)).withColumn("w", F.row_number().over(Window.partitionBy("query", "id").orderBy("arm", "k"))).filter("w = 1")
    return first.withColumn("pos", F.row_number().over(Window.partitionBy("query").orderBy("arm", "k"))).filter(F.col("pos") <= n).select("query", "id", "type", "pos")


def uncertain(results: DataFrame, gap: float = 0.05) -> DataFrame:
    """(query, uncertain): whether the two nearest distances differ by less than gap; null and 0 count as 1."""
    d = F.when(F.coalesce("distance", F.lit(0.0)) == 0, 1.0).otherwise(F.col("distance"))
    w = Window.partitionBy("query").orderBy("rank")
    return results.withColumn("d", d).withColumn("d2", F.lead("d").over(w)).filter("rank = 1").select("query", F.coalesce(F.abs(F.col("d2") - F.col("d")) < gap, F.lit(False)).alias("uncertain"))
