import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lorekeep.functions.embed import HashEmbedder
from lorekeep.operators import evalir, facts, graph, quality, records, search
from lorekeep.operators.components import connected_components
from lorekeep.operators.ranks import positions
from lorekeep.operators.vector import cosine_topk

TS = [datetime(2024, 1, i + 1) for i in range(9)]


def test_timeline_excludes_ties(spark):
    m = spark.createDataFrame([(i, TS[i]) for i in range(5)] + [(9, TS[2])], "id long, ts timestamp_ntz")
    got = records.timeline(m, spark.createDataFrame([(2,), (77,)], "anchor long"), 1, 1).orderBy("offset").collect()
    assert [(r["id"], r["offset"]) for r in got] == [(1, -1), (2, 0), (3, 1)]


def test_rollback_clears_what_was_superseded(spark):
    m = spark.createDataFrame([(1, 10), (2, None), (10, None), (11, None)], "id long, superseded_by long")
    cur = spark.createDataFrame([(10, "UPDATE", "b"), (10, "ADD", "b"), (2, "IGNORE", "b"), (11, "ADD", "c")], "fact_id long, decision string, batch_id string")
    batches = spark.createDataFrame([("b", 0, 3, 1), ("c", 0, 1, 0)], "batch_id string, rolled_back int, facts_inserted int, facts_superseded int")
    left, marked = records.rollback_batch(m, cur, batches, "b")
    assert sorted((r["id"], r["superseded_by"]) for r in left.collect()) == [(1, None), (2, None), (11, None)]
    assert sorted(tuple(r) for r in marked.collect()) == [("b", 1, 0, 0), ("c", 0, 1, 0)]


def test_upsert_keeps_old_embedding(spark):
    base = spark.createDataFrame([(1, "a", [1.0]), (2, "b", None)], "id long, content string, embedding array<double>")
    new = spark.createDataFrame([(1, "z", None), (3, "c", [3.0])], "id long, content string, embedding array<double>")
    assert sorted(tuple(r) for r in records.upsert(base, new).collect()) == [(1, "z", [1.0]), (2, "b", None), (3, "c", [3.0])]


def test_feedback_is_idempotent(spark):
    schema = "event_id long, ts timestamp_ntz, key string"
    old = spark.createDataFrame([(1, TS[0], "a")], schema)
    new = spark.createDataFrame([(2, TS[1], "a"), (3, TS[1], "b"), (4, TS[2], "b"), (5, TS[1], None), (6, TS[1], None)], schema)
    assert sorted(r["event_id"] for r in records.append_feedback(old, new).collect()) == [3, 5, 6]


def test_nudges_clamp_in_order(spark):
    m = spark.createDataFrame([(1, 1.0), (2, None)], "id long, salience double")
    f = spark.createDataFrame([(1, TS[0], 1, "accepted"), (1, TS[1], 2, "rejected"), (2, TS[0], 3, "rejected")], "memory long, ts timestamp_ntz, event_id long, kind string")
    assert dict(tuple(r) for r in records.nudged_salience(m, f).collect()) == {1: 0.9, 2: 0.4}


def test_save_guard_looks_at_the_nearest_only(spark):
    schema = "id long, vector array<double>"
    stored = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.999, 0.0447])], schema)
    m = spark.createDataFrame([(1, "other", "fact"), (2, "p", "fact"), (3, "p", "fact"), (4, "other", "fact")], "id long, project string, type string")
    new = spark.createDataFrame([(3, [1.0, 0.0]), (4, [1.0, 0.0])], schema)
    assert [tuple(r) for r in quality.save_guard(new, stored, m).collect()] == [(4, 1)]


def test_topk_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(60)] + [(99, [1.0])]
    v = spark.createDataFrame(rows, "id long, vector array<double>")
    got = cosine_topk(v.withColumnRenamed("id", "query"), v, 3, drop_self=True).collect()
    want = {}
    for q, x in rows[:-1]:
        want[q] = [i for _, i in sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in rows[:-1] if i != q)[:3]]
    assert {q: [r["id"] for r in sorted((r for r in got if r["query"] == q), key=lambda r: r["rank"])] for q in want} == want
    assert v.filter("false").count() == 0 and cosine_topk(v.filter("false").withColumnRenamed("id", "query"), v, 3).count() == 0


def test_expansion_keeps_the_best_and_breaks_ties_by_id(spark):
    scored = spark.createDataFrame([(1, 10, "fact", 0.1, 0.9, 1, 1), (1, 11, "fact", 0.2, 0.2, 2, 2)], "query long, id long, type string, distance double, score double, o1 int, o2 int")
    e = spark.createDataFrame([(10, 1), (20, 1), (21, 1), (22, 1), (11, 1)], "memory long, entity long")
    m = spark.createDataFrame([(i, "fact", "p", 22 if i == 21 else None) for i in (10, 11, 20, 21, 22)], "id long, type string, project string, superseded_by long")
    got = search.graph_expand(scored, e, m, 1).orderBy(F.desc("score"), "o1").collect()
    assert [(r["id"], r["score"]) for r in got] == [(10, 0.9), (20, 0.765), (11, 0.2)]


def test_neighbours_filter_before_the_cap(spark):
    e = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 1)], "memory long, entity long")
    seeds, active = spark.createDataFrame([(1,)], "seed long"), spark.createDataFrame([(4,)], "id long")
    assert [r["neighbor"] for r in graph.neighbors(seeds, e, active, cap=1).collect()] == [4]


@pytest.mark.parametrize("seed", range(2))
def test_components_against_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(30)] + [(None, 3), (5, 5)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}


def test_mcnemar_and_gate(spark):
    assert evalir.mcnemar_exact(0, 0) == 1.0 and evalir.mcnemar_exact(10, 0) == pytest.approx(2 / 1024)
    t = spark.createDataFrame([(3, 9), (0, 0), (20, 7), (900, 1010), (4000, 4001)], "b long, c long")
    for r in t.select("b", "c", evalir.mcnemar_p(F.col("b"), F.col("c")).alias("p")).collect():
        assert r["p"] == pytest.approx(evalir.mcnemar_exact(r["b"], r["c"]), abs=1e-9)
    good = dict(n_queries=200, baseline_hit10=0.6, n_reachable=40, gains=25, losses=3, delta_hit1=0, delta_hit3=0.01, delta_hit10=0.1, delta_mrr=0.01, ci_hit10_low=0.02, ci_mrr_low=0.0, filter_violations=0, latency_ratio=1.1)
    assert evalir.gate(good) == ("PASS", [])
    assert evalir.gate({**good, "delta_hit1": 0.01}) == ("FAIL", [7])
    assert evalir.gate({**good, "n_reachable": 3})[0] == "UNDERPOWERED"
    assert evalir.gate({**good, "latency_ratio": 0})[0] == "INVALID_SET"
    assert evalir.gate({k: v for k, v in good.items() if k != "delta_hit3"})[0] == "INVALID_SET"
    assert evalir.rollback_wanted(5, 0.5, 0.6) and not evalir.rollback_wanted(4, 0.0, 0.6)


def test_ranks_report_ties(spark):
    s = spark.createDataFrame([(1, i, x) for i, x in enumerate([0.9, 0.5, 0.5, 0.1])], "query long, id long, s double")
    r = evalir.gold_ranks(s, spark.createDataFrame([(1, 2), (2, 7)], "query long, gold long")).collect()
    assert [(x["gold_rank"], x["n_tied"]) for x in r] == [(2, 1)]


def test_bootstrap_covers_the_mean(spark):
    d = spark.range(50).select(F.col("id").alias("i"), (F.col("id") % 5 / 10).alias("d"))
    r = evalir.bootstrap_ci(d, iters=200).first()
    assert r["lo"] < 0.2 < r["hi"]


def test_positions_are_those_of_one_sort(spark):
    rows = [(random.Random(i).choice(["a", "b", None]), i, i % 13 if i % 7 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, id long, v long")
    got = {r["id"]: r["p"] for r in positions(df, ["g"], F.floor(F.col("v") / 4), ["v", "id"], "p").collect()}
    for g in ("a", "b", None):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[2] is not None, r[2] or 0, r[1]))
        assert [got[r[1]] for r in own] == list(range(1, len(own) + 1))
    assert positions(df.filter("id < 0"), [], F.col("v"), ["id"], "p").count() == 0


def test_timeline_of_the_whole_table(spark):
    m = spark.createDataFrame([(i, TS[0] + timedelta(hours=5 * i)) for i in range(12)], "id long, ts timestamp_ntz")
    got = records.timeline(m, spark.createDataFrame([(6,)], "anchor long"), 2, 1).orderBy("offset").collect()
    assert [(r["id"], r["offset"]) for r in got] == [(4, -2), (5, -1), (6, 0), (7, 1)]


def test_batches_start_once_and_finish(spark):
    schema = "batch_id string, project string, started_at timestamp_ntz, finished_at timestamp_ntz, p1_before double, p1_after double, facts_inserted long, facts_superseded long, rolled_back int"
    now = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    new = spark.createDataFrame([("b", "p", 0.5), ("b", "p", 0.5), ("c", "p", None)], "batch_id string, project string, p1_before double")
    started = records.start_batches(spark.createDataFrame([], schema), new, now)
    again = records.start_batches(started, new, now)
    done = records.finish_batches(again, spark.createDataFrame([("b", 0.6, 3, 1, 0), ("x", 0.1, 0, 0, 1)], "batch_id string, p1_after double, facts_inserted long, facts_superseded long, rolled_back int"), now)
    assert sorted((r["batch_id"], r["facts_inserted"], r["finished_at"] is not None) for r in done.collect()) == [("b", 3, True), ("c", None, False)]
    log = spark.createDataFrame([], "id string, ts timestamp_ntz, fact_id string, decision string, sim double, reason string, model string, batch_id string")
    rows = records.log_curation(log, spark.createDataFrame([("f", "ADD", None, "new", None, "b"), ("f", "ADD", None, "new", None, "b")], "fact_id string, decision string, sim double, reason string, model string, batch_id string"), now).collect()
    assert len({r["id"] for r in rows}) == 2


def test_live_path_leaves_dangling_golds_out(spark):
    results = spark.createDataFrame([(1, 10, 1), (2, 5, 1), (2, 20, 2), (3, 99, 1)], "query long, id long, rank int")
    gold = spark.createDataFrame([(1, 10), (2, 20), (3, 30), (4, 40)], "query long, gold long")
    corpus, base = spark.createDataFrame([(10,), (20,), (40,)], "id long"), spark.createDataFrame([(0.25,)], "p1 double")
    r = evalir.live_path(results, gold, corpus, base).first()
    assert tuple(r) == ("ok", 3, 0.3333, 0.5, 0.0833, 1)
    none = evalir.live_path(results, gold, corpus.filter("id < 0"), base).first()
    assert (none["status"], none["n_queries"], none["precision_at_1"], none["n_skipped_dangling"]) == ("skipped", 0, None, 4)


def test_facts_parse_and_curate(spark):
    raw = spark.createDataFrame([(1, '```json\n{"facts":[{"content":"a","salience":2},{"content":" "},{"content":"b","salience":0.7,"fact_type":"odd"}]}\n```'), (2, "no json"), (3, "[1]")], "id long, text string")
    assert [(r["id"], r["content"], r["salience"], r["fact_type"]) for r in facts.parse_facts(raw).orderBy("pos").collect()] == [(1, "a", 1.0, "decision"), (1, "b", 0.7, "decision")]
    v = HashEmbedder(8).embed(["x", "y"]).tolist()
    mid = [0.85 * a + 0.527 * b for a, b in zip([1.0, 0, 0, 0, 0, 0, 0, 0], [0, 1.0, 0, 0, 0, 0, 0, 0], strict=True)]
    e1 = [1.0] + [0.0] * 7
    ex = spark.createDataFrame([("p", 1, "old", e1)], "project string, id long, content string, vector array<double>")
    dr = spark.createDataFrame([("p", 2, 0, "same", e1), ("p", 3, 1, "near", mid), ("p", 4, 2, "far", v[0])], "project string, id long, pos int, content string, vector array<double>")
    got = {r["id"]: (r["decision"], r["other"]) for r in facts.curate(dr, ex, decide=lambda old, new, sim: "UPDATE").collect()}
    assert got[2] == ("IGNORE", 1) and got[3] == ("UPDATE", 1) and got[4][0] == "ADD"
