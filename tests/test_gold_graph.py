import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from lorekeep.operators import gold, graph, quality


def _memories(spark, n=120):
    rng = random.Random(6)
    rows = [(i, f"alpha{i} beta{i} gamma{i} " + "x" * rng.choice([10, 300]), rng.choice(["fact", "solution", "note"]), "p", 1 if i % 10 == 0 else None) for i in range(n)]
    edges = [(i, e) for i in range(n) if i % 7 for e in range(rng.randrange(1, 5))]
    return rows, edges, spark.createDataFrame(rows, "id long, content string, type string, project string, superseded_by long"), spark.createDataFrame(edges, "memory long, entity long")


def _make_client():
    def client(texts):  # tasks can't import this file, so it is a local function
        out = []
        for t in texts:
            i = int(t.split(" ")[0][5:])
            out.append([None, f"alpha{i} beta{i} other", "the of", f"something quite new about gamma{i}", "entirely different words"][i % 5])
        return out

    return client


@pytest.mark.parametrize(("quotas", "oversample"), [({"fact": 3, "solution": 2}, 1.5), ({"fact": 1000, "solution": 4}, 1.0), ({"missing": 2}, 3.0)])
def test_gold_fills_quotas_in_key_order(spark, quotas, oversample):
    rows, edges, memories, links = _memories(spark)
    n = {i: sum(m == i for m, _ in edges) for i, *_ in rows}

    def key(i):
        u = (int(hashlib.md5(f"{i}:42".encode()).hexdigest()[:13], 16) + 1) / 2**52
        return (-math.log(u) / n[i], i)

    want, rejected, none = {}, 0, 0
    for t, quota in quotas.items():
        pool = sorted((i for i, c, kind, _, gone in rows if kind == t and gone is None and len(c) >= 200 and n[i]), key=key)
        for i in pool:
            if len(want.get(t, [])) == quota:
                break
            q = _make_client()([rows[i][1]])[0]
            if q is None:
                none += 1
            elif i % 5 in (1, 2):  # two of three words are the text's; no content words at all
                rejected += 1
            else:
                want.setdefault(t, []).append(i)
    got = gold.build(gold.pool(memories, links, list(quotas), weighted=True), quotas, _make_client(), oversample=oversample)
    assert sorted(r["id"] for r in got.rows.collect()) == sorted(i for ids in want.values() for i in ids)
    assert got.accepted == {t: len(want.get(t, [])) for t in quotas} and (got.rejected_overlap, got.rejected_client) == (rejected, none)
    assert got.shortfalls(quotas) == {t: q - len(want.get(t, [])) for t, q in quotas.items() if q > len(want.get(t, []))}


def test_conversations_are_no_gold(spark):
    _, _, memories, links = _memories(spark, 5)
    with pytest.raises(ValueError, match="conversation"):
        gold.pool(memories, links, ["fact", "conversation"])


def test_weights_lead_the_sample(spark):
    ids = spark.range(4000).withColumn("w", F.when(F.col("id") < 1000, 9.0).otherwise(1.0)).withColumn("key", gold.sample_key(F.col("id"), F.col("w")))
    first = [r["id"] for r in ids.orderBy("key").limit(400).collect()]
    assert 0.65 < sum(i < 1000 for i in first) / 400 < 0.85  # 9 / 12 of the weight


@pytest.mark.parametrize("hub", [0, 2, 5, 1000])
def test_degrees_by_hub_sets(spark, hub):
    rng = random.Random(hub)
    edges = {(m, e) for m in range(60) for e in range(12) if rng.random() < 0.9 / (e + 1)}
    df = spark.createDataFrame([*edges, *list(edges)[:5]], "memory long, entity long")
    want = {}
    for m in {m for m, _ in edges}:
        own = {e for x, e in edges if x == m}
        want[m] = (len(own), len({x for x, e in edges if e in own and x != m}))
    assert {r["memory"]: (r["n_edges"], r["degree"]) for r in graph.neighbor_degree(df, hub).collect()} == want


@pytest.mark.parametrize(("hub", "wide"), [(1000, 0), (4, 1), (6, 3), (1000, 5), (1000, 64)])
def test_degrees_without_pairs(spark, hub, wide):
    rng = random.Random(wide)
    edges = {(f"m{m}", e) for m in range(80) for e in range(14) if rng.random() < 0.9 / (e + 1)} | {(None, 1), ("m1", None)}
    got = graph.neighbor_degree(spark.createDataFrame([*edges, *list(edges)[:9]], "memory string, entity int"), hub, wide)
    want = {}
    for m in {m for m, e in edges if e is not None}:
        own = {e for x, e in edges if x == m and e is not None}
        want[m] = (len(own), len({x for x, e in edges if e in own and x not in (m, None)}) if m else 0)
    assert {r["memory"]: (r["n_edges"], r["degree"]) for r in got.collect()} == want
    if (hub, wide) == (1000, 64):
        assert "Join" not in got._jdf.queryExecution().toString()  # no row for each pair


def test_copies_are_paired_with_the_least_of_their_class(spark):
    rows = [(5, [1.0, 0.0]), (3, [1.0, 0.0]), (9, [1.0, 0.0]), (4, [0.8, 0.6]), (1, [0.8, 0.6]), (7, [0.0, 1.0]), (8, None)]
    got = {(r["a"], r["b"]) for r in quality.near_dup_pairs(spark.createDataFrame(rows, "id long, vector array<double>"), threshold=0.7).collect()}
    assert got == {(3, 5), (3, 9), (1, 4), (1, 3)}
