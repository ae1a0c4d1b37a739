"""Corpus quality: near duplicates, support, confidence, fragility and pruning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import stored
from . import tiles
from .components import connected_components
from .vector import unit


def near_dup_pairs(vectors: DataFrame, memories: DataFrame | None = None, threshold: float = 0.97, prefix: int = 300) -> DataFrame:
    """(a, b, sim) above threshold; with memories also equal in the first characters.

    Without memories, equal vectors are a class: pairs between classes are pairs
    of their smallest ids, and each other member is paired with that of its own.
    The prefix is an equi-key, so it goes first: vectors meet only within a prefix.
    """
    if memories is None:
        rows = vectors.filter("id is not null and vector is not null")
        classes = rows.groupBy("vector").agg(F.min("id").alias("least"), F.count("*").alias("n"))
        t = tiles.tiled(classes.select(F.col("least").alias("id"), "vector"))
        own = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
        copies = rows.join(classes.filter("n > 1").drop("n"), "vector").filter("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b"), own.alias("sim"))
        return tiles.similar(t, threshold, over=True).union(copies.filter(F.col("sim") > threshold))
    keyed = memories.select("id", F.sha2(F.substring("content", 1, prefix), 256).alias("p")).join(vectors, "id").select("id", "p", unit(F.col("vector")).alias("v"))
    dot = F.aggregate(F.zip_with("x.v", "y.v", lambda a, b: a * b), F.lit(0.0), lambda t, z: t + z)
    pairs = keyed.alias("x").join(keyed.alias("y"), (F.col("x.p") == F.col("y.p")) & (F.col("x.id") < F.col("y.id")))
    return pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.round(dot, 6).alias("sim")).filter(F.col("sim") > threshold)


def cluster_resolution(pairs: DataFrame, memories: DataFrame) -> DataFrame:
    """(id, component, size, keep): in each cluster the highest salience stays (null and 0 count as 0.5), ties to the smallest id."""
    c = connected_components(pairs.select("a", "b"))
    s = F.when(F.coalesce("salience", F.lit(0.0)) == 0, 0.5).otherwise(F.col("salience"))
    rows = c.join(memories.select("id", s.alias("s")), "id")
    best = rows.groupBy("component").agg(F.max(F.struct("s", (-F.col("id")).alias("n"))).alias("best"), F.count("*").alias("size"))
    return rows.join(best, "component").select("id", "component", "size", (F.col("id") == -F.col("best.n")).alias("keep"))


def corroboration(vectors: DataFrame, memories: DataFrame, support_min: float = 0.60, dup_max: float = 0.97, cap: int = 5) -> DataFrame:
    """(id, support, score): other sessions among neighbours with support_min <= sim < dup_max; records without a session count as one each.

    What comes out of the comparison is a count for each record: all vectors of a session are met in one task.
    """
    unit_of = memories.select("id", F.when(F.coalesce("session_id", F.lit("")) == "", F.concat(F.lit("id:"), F.col("id"))).otherwise(F.col("session_id")).alias("u"))
    rows = tiles.usable(vectors).select("id", "vector").join(unit_of, "id")
    groups = -(-rows.count() * 4 // (3 * tiles.TILE_ROWS)) or 1  # of units, somewhat less than a tile each on average
    units = rows.select("u").distinct().withColumn("group", F.pmod(F.xxhash64("u"), F.lit(groups)))
    units = stored(units.withColumn("place", F.row_number().over(Window.partitionBy("group").orderBy("u")) - 1), "units")
    twice = rows.groupBy("id").agg((F.count("*") > 1).cast("double").alias("twice"))
    rows = rows.join(units, "u").join(twice, "id").select("id", "vector", F.col("group").cast("double").alias("group"), F.col("place").cast("double").alias("place"), "twice")
    own = tiles.tiled(rows, ("group", "place", "twice"))
    n = tiles.groups_near(own, tiles.tiled(rows, ("group", "place"), at=own.pivots, group="group"), support_min, dup_max).withColumnRenamed("n", "support")
    return vectors.select("id").join(n, F.col("id") == F.col("query"), "left").select("id", F.coalesce("support", F.lit(0)).alias("support"), F.round(F.least(F.coalesce("support", F.lit(0)), F.lit(cap)) / cap, 6).alias("score"))


def trust_weight(score: Column) -> Column:
    return F.greatest(F.lit(0.85), F.least(F.lit(1.15), 1 + F.lit(0.3) * (score - 0.5)))


def nearest(vectors: DataFrame, k: int) -> DataFrame:
    """(query, id, sim, rank): the k most similar others of every vector."""
    t = tiles.tiled(vectors)
    return tiles.topk(t, t, k, drop_self=True)


def support(vectors: DataFrame, k: int = 10) -> DataFrame:
    """(id, support): mean similarity of the k nearest others."""
    near = nearest(vectors, k)
    return near.groupBy(F.col("query").alias("id")).agg(F.round(F.avg(F.round("sim", 9)), 6).alias("support"))


def confidence_bands(scored: DataFrame) -> DataFrame:
    """(id, support, band, confidence) by the 75th, 40th and 15th percentile of support."""
    cuts = scored.agg(*[F.percentile("support", F.lit(p)).alias(f"p{round(p * 100)}") for p in (0.75, 0.40, 0.15)])
    s = F.col("support")
    rows = scored.crossJoin(F.broadcast(cuts))  # one row
    band = F.when(s >= F.col("p75"), "H").when(s >= F.col("p40"), "M").when(s >= F.col("p15"), "L").otherwise("D")
    value = F.when(s >= F.col("p75"), 0.70).when(s >= F.col("p40"), 0.55).when(s >= F.col("p15"), 0.40).otherwise(0.25)
    return rows.select("id", "support", band.alias("band"), value.alias("confidence"))


def demotions(bands: DataFrame, memories: DataFrame, trusted_sources: list[str], drop: float = 0.10) -> DataFrame:
    """Trusted records (salience 0.8 or more, or a trusted project) whose confidence would fall by drop or more."""
    rows = bands.join(memories.select("id", "salience", "project"), "id")
    trusted = (F.col("salience") >= 0.8) | F.col("project").isin(trusted_sources)
    delta = F.round(F.col("confidence") - F.col("salience"), 6)
    return rows.filter(trusted & (delta <= -drop)).select("id", delta.alias("delta"))


def density_buckets(scored: DataFrame) -> DataFrame:
    s = F.col("support")
    bucket = F.when(s >= 0.9, "0.9+").when(s >= 0.8, "0.8-0.9").when(s >= 0.6, "0.6-0.8").when(s >= 0.4, "0.4-0.6").when(s >= 0.3, "0.3-0.4").otherwise("<0.3")
    return scored.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg("support"), 6).alias("mean_support"))


def fragility(vectors: DataFrame, sigma: float = 0.05, k: int = 10, trials: int = 5, seed: int = 42) -> DataFrame:
    """(id, fragility): 1 - mean Jaccard of the k nearest others before and after noise on the vector.

    The noise of a record depends on seed and id alone, so results don't depend
    on the partitioning.  A task makes the noisy copies of its tiles itself and
    searches for them and for the vectors at once; what comes out is a row for
    each record.
    """
    best = tiles.most_similar(k, drop_self=True)

    def copies(t: tiles.Tile) -> tiles.Tile:
        """Each row followed by its noisy copies."""
        x = np.repeat(t.x, trials + 1, axis=0)
        for n, i in enumerate(t.ids.tolist()):
            rng = np.random.default_rng([seed, i & 0xFFFFFFFF])
            for c in range(1, trials + 1):
                y = t.x[n] + rng.normal(0, sigma, x.shape[1])
                x[n * (trials + 1) + c] = y / max(float(np.linalg.norm(y)), 1e-10)
        return tiles.Tile(np.repeat(t.ids, trials + 1), x, {}, t.number)

    def kernel(t: tiles.Tile, v: tiles.Tile) -> Iterator[pa.RecordBatch]:
        t.found = t.found or copies(t)
        tiles.keep_best(t.found, v, k, best)
        return iter(())

    def end(t: tiles.Tile) -> Iterator[pa.RecordBatch]:
        if t.found and len(t.found.found[0]):
            row, sim, ids = t.found.found
            at, first = np.unique(row // (trials + 1), return_index=True)
            lists = [pa.ListArray.from_arrays(np.append(first, len(row)).astype(np.int32), pa.array(c)) for c in ((row % (trials + 1)).astype(np.int32), sim, ids)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t.number)), pa.array(at), pa.array(t.ids[at]), *lists], ["tile", "place", "query", "copy", "sim", "ids"])

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for r in batch.to_pylist():
                copy, sim, near = (np.concatenate([np.array(f[c]) for f in r["found"]]) for c in ("copy", "sim", "ids"))
                by = np.lexsort((near, -sim, copy))
                copy, near = copy[by], near[by]
                sets = [set(near[copy == c][:k].tolist()) for c in range(trials + 1)]
                if sets[0] and any(sets[1:]):
                    ids.append(r["query"])
                    out.append(float(np.mean([len(sets[0] & s) / len(sets[0] | s) for s in sets[1:] if s])))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.float64())], ["id", "share"])

    own = tiles.tiled(vectors)
    found = tiles.meet(own, own, tiles.tile_pairs(own, own), kernel, "tile long, place long, query long, copy array<int>, sim array<double>, ids array<long>", end)
    rows = found.groupBy("tile", "place", "query").agg(F.collect_list(F.struct("copy", "sim", "ids")).alias("found"))  # one of each task
    return rows.select("query", "found").mapInArrow(shares, "id long, share double").groupBy("id").agg(F.round(1 - F.avg("share"), 6).alias("fragility"))


def jaccard_neighbors(vectors: DataFrame, other: DataFrame, k: int = 10) -> DataFrame:
    """(id, jaccard) of the k nearest others of each id in two vector tables."""
    def sets(v: DataFrame, name: str) -> DataFrame:
        return nearest(v, k).groupBy("query").agg(F.collect_set("id").alias(name))

    rows = sets(vectors, "x").join(sets(other, "y"), "query")
    return rows.select(F.col("query").alias("id"), F.round(F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y")), 6).alias("jaccard"))


def prune_sweep(vectors: DataFrame, gold: DataFrame, scores: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, killed, p_at_1, mrr): ranks of golds (query, gold) after dropping ids whose fragility reaches a threshold; a killed gold is a miss.

    Every vector has a level, the number of thresholds that drop it, and better
    ones are counted by level once for all thresholds. Vectors and golds that all
    thresholds drop take no part in that.
    """
    cuts = sorted(thresholds)
    level = sum((F.when(F.col("fragility") >= t, 1).otherwise(0) for t in cuts), F.lit(0))
    levels = stored(scores.select("id", level.cast("double").alias("level")), "levels")
    targets = gold_targets(vectors, gold).join(levels.select(F.col("id").alias("gold"), F.col("level").alias("gold_level")), "gold")
    targets = stored(targets, "targets")
    own = tiles.tiled(vectors.join(levels.filter(F.col("level") < len(cuts)), "id"), ("level",))
    asked = vectors.join(targets.filter(F.col("gold_level") < len(cuts)).select(F.col("query").alias("id"), "target"), "id")
    above = tiles.better(tiles.tiled(asked, ("target",), at=own.pivots), own, "target", part="level")
    at = F.explode(F.array(*[F.struct(F.lit(float(c)).alias("threshold"), F.lit(i).alias("i")) for i, c in enumerate(cuts)])).alias("at")
    per = targets.select("query", "gold_level", at).select("query", "gold_level", "at.threshold", "at.i")
    met = per.join(above, (per["query"] == above["query"]) & (F.col("part") <= F.col("i")), "left").groupBy(per["query"], "gold_level", "threshold", "i").agg(F.coalesce(F.sum("above"), F.lit(0)).alias("above"))
    alive = F.col("gold_level") <= F.col("i")
    rr = F.when(alive, 1 / (F.col("above") + 1)).otherwise(0.0)
    return met.groupBy("threshold").agg(F.sum(F.when(alive, 0).otherwise(1)).alias("killed"), F.round(F.avg(F.when(rr == 1, 1.0).otherwise(0.0)), 6).alias("p_at_1"), F.round(F.avg(rr), 6).alias("mrr"))


def gold_targets(vectors: DataFrame, gold: DataFrame, places: int | None = None) -> DataFrame:
    """(query, gold, target): the similarity of each gold, by joins on both ids; golds without a vector have no row."""
    q = vectors.select(F.col("id").alias("query"), F.col("vector").alias("x"))
    g = vectors.select(F.col("id").alias("gold"), F.col("vector").alias("y"))
    sim = F.aggregate(F.zip_with("x", "y", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda t, z: t + z)
    return gold.select("query", "gold").join(q, "query").join(g, "gold").filter(F.size("x") == F.size("y")).select("query", "gold", (F.round(sim, places) if places else sim).alias("target"))


def gold_ranks(vectors: DataFrame, gold: DataFrame, places: int | None = None, weights: DataFrame | None = None, scopes: DataFrame | None = None) -> DataFrame:
    """(query, gold_rank, n_tied) of golds (query, gold) among all vectors but the query's own.

    A gold's similarity is known first, so the others are only counted: what
    moves are tiles and a count for each query, not a row for each pair.  weights
    (id, weight) multiply similarities (rounded to `places` after that); scopes
    (id, scope) leave vectors of the query's scope only, and golds of another
    scope have no rank.
    """
    targets, rows, extra = gold_targets(vectors, gold), vectors, ["target"]
    if weights is not None:
        targets = targets.join(weights.select(F.col("id").alias("gold"), "weight"), "gold").withColumn("target", F.col("target") * F.col("weight"))
        rows, extra = rows.join(weights.select("id", "weight"), "id"), [*extra, "weight"]
    if places:
        targets = targets.withColumn("target", F.round("target", places))
    if scopes is not None:
        numbers = stored(scopes.select("scope").distinct().filter("scope is not null").select("scope", F.monotonically_increasing_id().cast("double").alias("number")), "scopes")
        of = scopes.join(numbers, "scope").select("id", F.col("number").alias("scope"))
        targets = targets.join(of.select(F.col("id").alias("query"), F.col("scope").alias("own")), "query").join(of.select(F.col("id").alias("gold"), "scope"), "gold").filter("own = scope").drop("own", "scope")
        rows, extra = rows.join(of, "id"), [*extra, "scope"]
    rows = rows.join(targets.select(F.col("query").alias("id"), "target"), "id", "left").withColumn("target", F.coalesce("target", F.lit(float("nan"))))
    t = tiles.tiled(rows, tuple(extra))
    found = tiles.better(t, t, "target", weight="weight" if weights is not None else None, scope="scope" if scopes is not None else None, places=places)
    ranked = targets.select("query").join(found.select("query", "above", "tied"), "query", "left")
    return ranked.select("query", (F.coalesce("above", F.lit(0)) + 1).alias("gold_rank"), F.greatest(F.lit(0), F.coalesce("tied", F.lit(0)) - 1).alias("n_tied"))


def save_guard(incoming: DataFrame, vectors: DataFrame, memories: DataFrame, max_distance: float = 0.03) -> DataFrame:
    """(id, duplicate_of): the single nearest record, if closer than max_distance and of the same project and type."""
    stock = tiles.tiled(vectors)
    near = tiles.topk(tiles.tiled(incoming, at=stock.pivots), stock, 1, drop_self=True)
    a = memories.select(F.col("id").alias("query"), F.col("project").alias("p"), F.col("type").alias("t"))
    rows = near.join(a, "query").join(memories.select("id", "project", "type"), "id")
    return rows.filter((1 - F.col("sim") < max_distance) & (F.col("p") == F.col("project")) & (F.col("t") == F.col("type"))).select(F.col("query").alias("id"), F.col("id").alias("duplicate_of"))


def index_validation(exact: DataFrame, found: DataFrame, k: int = 10) -> DataFrame:
    """One row: queries, recall@k and top-1 agreement of found against exact (query, id, rank), and the shares of both whose first row is the query itself."""
    e, f = exact.filter(F.col("rank") <= k), found.filter(F.col("rank") <= k)
    hit = e.select("query", "id", F.col("rank").alias("re")).join(f.select("query", "id", F.col("rank").alias("rf")), ["query", "id"], "left")
    first, own = F.col("re") == 1, F.col("query") == F.col("id")
    one = F.sum(first.cast("double"))
    return hit.agg(
        F.sum(first.cast("long")).alias("n"), F.round(F.avg(F.col("rf").isNotNull().cast("double")), 6).alias("recall"), F.round(F.sum((first & F.coalesce(F.col("rf") == 1, F.lit(False))).cast("double")) / one, 6).alias("top1"),
        F.round(F.sum((own & F.coalesce(F.col("rf") == 1, F.lit(False))).cast("double")) / one, 6).alias("self_found"), F.round(F.sum((own & first).cast("double")) / one, 6).alias("self_exact"),
    )
