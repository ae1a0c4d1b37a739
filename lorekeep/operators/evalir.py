"""Retrieval evaluation: ranks, metrics, sweeps, paired tests and gates."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranks import positions

def gold_ranks(scores: DataFrame, gold: DataFrame, partition: list[str] | None = None) -> DataFrame:
    """(query, gold_rank, n_tied) of scores (query, id, s) and gold (query, gold).

    The rank is 1 + the number of strictly better rows, so ties share the best
    rank; n_tied counts the others that tie. Missing golds have no row.
    """
    keys = ["query", *(partition or [])]
    rows = scores.join(gold, "query")
    g = F.max(F.when(F.col("id") == F.col("gold"), F.col("s"))).over(Window.partitionBy(*keys))
    return rows.withColumn("g", g).filter("g is not null").groupBy(*keys).agg((F.sum((F.col("s") > F.col("g")).cast("long")) + 1).alias("gold_rank"), (F.sum((F.col("s") == F.col("g")).cast("long")) - 1).alias("n_tied"))


def metrics(ranks: DataFrame, by: list[str] | None = None, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """n, p_at_k, mrr and median rank of (query, gold_rank)."""
    aggs = [F.count("*").alias("n")]
    aggs += [F.round(F.avg((F.col("gold_rank") <= k).cast("double")), 6).alias(f"p_at_{k}") for k in ks]
    aggs += [F.round(F.avg(1 / F.col("gold_rank")), 6).alias("mrr"), F.floor(F.percentile("gold_rank", F.lit(0.5))).cast("long").alias("median_rank")]
    return ranks.groupBy(*by).agg(*aggs) if by else ranks.agg(*aggs)


def relevance_set(results: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """One row: success@1, recall@k, MRR of results (query, id, rank) against relevant (query, id)."""
    n = relevant.groupBy("query").agg(F.count("*").alias("n_rel"))
    hits = results.filter(F.col("rank") <= k).join(relevant, ["query", "id"]).groupBy("query").agg(F.min("rank").alias("first"), F.count("*").alias("k"))
    rows = n.join(hits, "query", "left")
    return rows.agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce(F.col("first") == 1, F.lit(False)).cast("double")), 6).alias("success_at_1"), F.round(F.avg(F.coalesce("k", F.lit(0)) / F.col("n_rel")), 6).alias("recall"), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


def label_relevance(results: DataFrame, labels: DataFrame, k: int = 10) -> DataFrame:
    """The same, relevant being all others of the query's label in (id, label): members of a label are counted, not paired."""
    size = labels.filter("label is not null").groupBy("label").agg(F.count("*").alias("_m"))
    n = labels.join(size, "label").filter("_m > 1").select(F.col("id").alias("query"), F.col("label").alias("_own"), (F.col("_m") - 1).alias("n_rel"))
    found = results.filter((F.col("rank") <= k) & (F.col("query") != F.col("id"))).join(labels.select("id", "label"), "id").join(n.select("query", "_own"), "query").filter("label = _own")
    hits = found.groupBy("query").agg(F.min("rank").alias("first"), F.count("*").alias("k"))
    rows = n.drop("_own").join(hits, "query", "left")
    return rows.agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce(F.col("first") == 1, F.lit(False)).cast("double")), 6).alias("success_at_1"), F.round(F.avg(F.coalesce("k", F.lit(0)) / F.col("n_rel")), 6).alias("recall"), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


def paired(off: DataFrame, on: DataFrame, k: int = 10) -> DataFrame:
    """One row of (query, gold_rank) pairs: hit@k of both, gains, losses, MRR@10 of both; null ranks are misses."""
    hit = lambda c: F.coalesce(F.col(c) <= k, F.lit(False))
    rr = lambda c: F.when(F.col(c) <= 10, 1 / F.col(c)).otherwise(0.0)
    rows = off.select("query", F.col("gold_rank").alias("a")).join(on.select("query", F.col("gold_rank").alias("b")), "query", "full_outer")
    mean = lambda c: F.round(F.avg(c), 6)
    return rows.agg(
        F.count("*").alias("n"), mean(hit("a").cast("double")).alias("hit_off"), mean(hit("b").cast("double")).alias("hit_on"),
        F.sum((~hit("a") & hit("b")).cast("long")).alias("gains"), F.sum((hit("a") & ~hit("b")).cast("long")).alias("losses"), mean(rr("a")).alias("mrr_off"), mean(rr("b")).alias("mrr_on"),
    )


def mcnemar_exact(b: int, c: int) -> float:
    """Two-sided exact p of b gains against c losses."""
    if b < 0 or c < 0:
        raise ValueError("counts can't be negative")
    n = b + c
    return 1.0 if not n else min(1.0, 2 * sum(math.comb(n, i) for i in range(min(b, c) + 1)) / 2**n)


def mcnemar_p(b: Column, c: Column) -> Column:
    """The same in SQL for any counts: each binomial term from the one before, as logarithms."""
    n = b + c
    start = F.struct((n * F.lit(-math.log(2))).alias("log"), F.lit(0.0).alias("tail"))

    def add(s: Column, i: Column) -> Column:
        return F.struct((s["log"] + F.log((n - i) / (i + 1))).alias("log"), (s["tail"] + F.exp(s["log"])).alias("tail"))

    tail = F.aggregate(F.sequence(F.lit(0).cast("long"), F.least(b, c).cast("long")), start, add)["tail"]
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def bootstrap_ci(diffs: DataFrame, iters: int = 10_000, seed: int = 42) -> DataFrame:
    """One row (lo, hi): percentile interval of the mean of diffs (i, d), i being distinct ids.

    Each iteration draws as many rows as there are by a hash of (seed, iteration,
    draw); draws are aggregated by iteration, so nothing is collected.
    """
    diffs = positions(diffs.select("i", "d"), [], F.pmod(F.xxhash64("i"), F.lit(1024)), ["i"], "p").select((F.col("p") - 1).alias("i"), "d")
    n = diffs.count()
    spark = diffs.sparkSession
    if not n or iters <= 0:
        return spark.createDataFrame([(0.0, 0.0)], "lo double, hi double")
    draws = spark.range(iters * n).select(F.floor(F.col("id") / n).alias("it"), F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(n)).alias("i"))
    means = draws.join(diffs, "i").groupBy("it").agg(F.avg("d").alias("m"))
    return means.agg(F.round(F.percentile("m", F.lit(0.025)), 4).alias("lo"), F.round(F.percentile("m", F.lit(0.975)), 4).alias("hi"))


def p95(values: Column) -> Column:
    """Nearest-rank 95th percentile of a group."""
    v = F.array_sort(F.collect_list(values))
    return F.element_at(v, F.greatest(F.lit(1), F.ceil(0.95 * F.size(v))).cast("int"))


#: The thresholds of the gate are fixed values.
@dataclass(frozen=True)
class GateConfig:
    min_n: int = 150
    max_baseline_hit10: float = 0.90
    min_reachable: int = 12
    min_discordant: int = 12
    alpha: float = 0.05
    min_delta_hit10: float = 0.03
    max_delta_mrr_loss: float = 0.01
    max_delta_hit3_loss: float = 0.02
    max_p95_latency_ratio: float = 1.25
    ci_mrr_floor: float = -0.02


NEEDED = ("n_queries", "baseline_hit10", "n_reachable", "gains", "losses", "delta_hit1", "delta_hit3", "delta_hit10", "delta_mrr", "ci_hit10_low", "ci_mrr_low", "filter_violations", "latency_ratio")


def gate(report: dict[str, float], cfg: GateConfig | None = None) -> tuple[str, list[int]]:
    """Verdict and the numbers of the criteria that fail: INVALID_SET before UNDERPOWERED before FAIL before PASS.

    Absent evidence is invalid, and so is a latency ratio of 0, whose baseline can't have been measured.
    """
    c = cfg or GateConfig()
    missing = [k for k in NEEDED if report.get(k) is None]
    r = {k: float(report.get(k) or 0) for k in (*NEEDED, "dangling", "unlinked", "episodes")}
    invalid = [1] if r["n_queries"] < c.min_n or r["dangling"] or r["unlinked"] or r["episodes"] or missing else []
    invalid += [2] if r["baseline_hit10"] > c.max_baseline_hit10 else []
    invalid += [10] if r["latency_ratio"] <= 0 else []
    weak = [3] if r["n_reachable"] < c.min_reachable else []
    weak += [4] if r["gains"] + r["losses"] < c.min_discordant or r["gains"] <= r["losses"] else []
    checks = {
        5: mcnemar_exact(int(r["gains"]), int(r["losses"])) < c.alpha,
        6: r["delta_hit10"] >= c.min_delta_hit10 and r["ci_hit10_low"] > 0,
        7: r["delta_hit1"] == 0,
        8: r["delta_hit3"] >= -c.max_delta_hit3_loss and r["delta_mrr"] >= -c.max_delta_mrr_loss and r["ci_mrr_low"] > c.ci_mrr_floor,
        9: r["filter_violations"] == 0,
        10: r["latency_ratio"] <= c.max_p95_latency_ratio,
    }
    failed = [k for k, ok in checks.items() if not ok]
    for verdict, found in (("INVALID_SET", invalid), ("UNDERPOWERED", weak), ("FAIL", failed)):
        if found:
            return verdict, sorted({*(invalid or []), *weak, *failed})
    return "PASS", []


def rollback_wanted(n: int, p_at_1: float, baseline: float, margin: float = 0.05) -> bool:
    return n >= 5 and p_at_1 < baseline - margin


def compare_reports(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Differences b - a of p_at_1 and mrr by keys."""
    x = a.select(*keys, F.col("p_at_1").alias("pa"), F.col("mrr").alias("ma"))
    y = b.select(*keys, F.col("p_at_1").alias("pb"), F.col("mrr").alias("mb"))
    return x.join(y, keys, "full_outer").select(*keys, F.round(F.col("pb") - F.col("pa"), 6).alias("d_p_at_1"), F.round(F.col("mb") - F.col("ma"), 6).alias("d_mrr"))


def stratified_sample(rows: DataFrame, by: str, fraction: float, key: str = "id", seed: int = 42) -> DataFrame:
    """At least one and about fraction of each stratum: those with the smallest MD5 of 'key:seed'. Places come from prefixes of the hash, so a stratum is not sorted in one task."""
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    n = rows.groupBy(F.col(by).alias("_by")).agg(F.count("*").alias("_n"))
    placed = positions(rows, [by], F.substring(h, 1, 3), [h, key], "_r").join(n, F.col(by).eqNullSafe(F.col("_by")))
    return placed.filter(F.col("_r") <= F.greatest(F.lit(1), F.round(F.col("_n") * F.lit(fraction)))).select(*rows.columns)


def offline_p1(scores: DataFrame, gold: DataFrame) -> DataFrame:
    """One row (p1): share of all of gold (query, gold) that rank first in scores (query, id, s); golds without a score miss."""
    first = gold_ranks(scores, gold).select("query", (F.col("gold_rank") == 1).alias("hit"))
    return gold.join(first, "query", "left").agg(F.round(F.avg(F.coalesce("hit", F.lit(False)).cast("double")), 4).alias("p1"))


def live_path(results: DataFrame, gold: DataFrame, corpus: DataFrame, baseline: DataFrame) -> DataFrame:
    """One row: P@1 and MRR of results (query, id, rank) against gold (query, gold), with the gap to baseline (p1).

    Golds that corpus (id) lacks are left out and counted as n_skipped_dangling;
    when none is left the status is skipped and the figures are null.
    """
    known = gold.join(corpus.select(F.col("id").alias("gold"), F.lit(True).alias("_has")).distinct(), "gold", "left")
    ranks = results.select("query", F.col("id").alias("gold"), "rank").groupBy("query", "gold").agg(F.min("rank").alias("rank"))
    valid = F.col("_has").isNotNull()
    p1 = F.avg(F.when(valid, F.coalesce(F.col("rank") == 1, F.lit(False)).cast("double")))
    one = known.join(ranks, ["query", "gold"], "left").agg(
        F.count(F.when(valid, 1)).alias("n_queries"), p1.alias("_p1"), F.round(F.avg(F.when(valid, F.coalesce(1 / F.col("rank"), F.lit(0.0)))), 4).alias("mrr"), F.count(F.when(~valid, 1)).alias("n_skipped_dangling"),
    )
    status = F.when(F.col("n_queries") > 0, "ok").otherwise("skipped").alias("status")
    return one.crossJoin(F.broadcast(baseline)).select(status, "n_queries", F.round("_p1", 4).alias("precision_at_1"), "mrr", F.round(F.col("_p1") - F.col("p1"), 4).alias("gap_vs_offline_rrf"), "n_skipped_dangling")  # one row each
