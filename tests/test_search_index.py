"""Stems and BM25, tiles of vectors, and the quantised index, against plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.functions.stem import porter
from lorekeep.operators import quality, tiles
from lorekeep.operators.bm25 import bm25_topk

#: Pairs that M. F. Porter's paper gives, taken through all steps.
PUBLISHED = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size
hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc digitizer digit
operator oper feudalism feudal decisiveness decis hopefulness hope formaliti formal sensitiviti sensit triplicate triplic formative form formalize formal electrical electr hopeful hope
goodness good revival reviv allowance allow inference infer airliner airlin adjustable adjust replacement replac adoption adopt homologou homolog communism commun activate activ effective effect
bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll generalizations gener oscillators oscil""".split()


def test_published_stems():
    assert [porter(w) for w in PUBLISHED[::2]] == PUBLISHED[1::2]
    assert [porter(w) for w in ("", "s", "is", "été", "x" * 65 + "s", "sies")] == ["", "s", "is", "été", "x" * 65 + "s", "si"]


def _terms(t):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    return [porter(w) for w in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low) if w]


def _query(t):
    tokens = [w for w in re.sub(r"[^\w'-]|_", " ", t or "").split() if len(w.encode()) >= 2]
    return set(_terms(" ".join(tokens)))


def test_bm25_by_stems(spark):
    rng = random.Random(4)
    vocab = "connect connected CONNECTION connects don't well-known É été a b relate relational relating x,y".split()
    docs = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 25)))) for i in range(60)] + [(90, None), (91, ""), (92, "...")]
    queries = [(1, "connecting"), (2, "relates don't"), (3, "well-known!"), (4, "a"), (5, None), (6, "É (connections)"), (7, "missing connect")]
    terms = {i: _terms(t) for i, t in docs}
    avg = sum(map(len, terms.values())) / len(docs)
    want = {}
    for q, t in queries:
        ws, scored = _query(t), []
        for i, d in terms.items():
            tf = Counter(d)
            if ws and all(tf[w] for w in ws):
                s = 0.0
                for w in ws:
                    df = sum(w in x for x in terms.values())
                    s += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(d) / avg))
                scored.append((-round(s, 9), i))
        want |= {(q, i): r for r, (_, i) in enumerate(sorted(scored)[:5], 1)}
    got = bm25_topk(spark.createDataFrame(queries, "query long, text string"), spark.createDataFrame(docs, "id long, content string"), 5).collect()
    assert {(r["query"], r["id"]): r["rank"] for r in got} == want and want


# vectors


def _clusters(seed, n, dim=6, centres=5):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dim))
    x = c[rng.integers(centres, size=n)] + 0.05 * rng.normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _table(spark, x, odd=True):
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    if odd:
        rows += [(900, None), (901, [1.0, 0.0]), (902, [float("nan")] * x.shape[1]), (None, x[0].tolist()), (903, [])]
    return spark.createDataFrame(rows, "id long, vector array<double>")


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(tiles, "TILE_ROWS", 16)
    monkeypatch.setattr(tiles, "PIVOTS", 5)


@pytest.mark.parametrize("n", [1, 150])
def test_pairs_against_all_pairs(spark, small, n):
    x = _clusters(n, n)
    t = tiles.tiled(_table(spark, x))
    sims = x @ x.T
    got = {(r["a"], r["b"]) for r in tiles.similar(t, 0.97, over=True, at_most=0.999).collect()}
    assert got == {(i, j) for i in range(n) for j in range(i + 1, n) if 0.97 < sims[i, j] <= 0.999}
    got = {(r["a"], r["b"]) for r in tiles.similar(t, 0.5, below=0.98).collect()}
    assert got == {(i, j) for i in range(n) for j in range(i + 1, n) if 0.5 <= sims[i, j] < 0.98}


def test_near_tiles_only_are_compared(spark, small):
    r = tiles.share_compared(tiles.tiled(_table(spark, _clusters(3, 300), odd=False)), 0.97).first()
    assert r["tiles"] >= 19 and r["tile_pairs"] == r["tiles"] * (r["tiles"] + 1) // 2 and r["compared"] < 0.5 * r["tile_pairs"]
    rng = np.random.default_rng(1).normal(size=(60, 6))
    assert tiles.share_compared(tiles.tiled(_table(spark, rng, odd=False)), -9.0).first()["share"] == 1.0


@pytest.mark.parametrize("drop", [True, False])
def test_nearest_in_rounds(spark, small, drop):
    x = np.round(_clusters(7, 130), 1)  # ties
    t = tiles.tiled(_table(spark, x))
    got = {}
    for r in tiles.topk(t, t, 4, drop_self=drop).collect():
        got.setdefault(r["query"], {})[r["rank"]] = r["id"]
    for i in range(130):
        sims = [(-float(tiles.exact(x[[i]], x[[j]])[0]), j) for j in range(130) if not drop or i != j]
        assert [got[i][k] for k in range(1, 5)] == [j for _, j in sorted(sims)[:4]], i
    assert got[901] == {} if drop and 901 in got else (901 not in got or got[901] == {1: 901})


def test_nearest_of_another_table(spark, small):
    x, y = _clusters(8, 40), _clusters(9, 70)
    b = tiles.tiled(_table(spark, y))
    got = {(r["query"], r["rank"]): r["id"] for r in tiles.topk(tiles.tiled(_table(spark, x, odd=False), at=b.pivots), b, 3).collect()}
    want = np.argsort(-(x @ y.T), axis=1, kind="stable")[:, :3]
    assert got == {(i, k + 1): want[i, k] for i in range(40) for k in range(3)}
    empty = tiles.tiled(_table(spark, y, odd=False).limit(0))
    assert tiles.topk(empty, empty, 3).count() == 0 and tiles.similar(empty, 0.5).count() == 0


def test_gold_ranks_by_counts(spark, small):
    x = _clusters(11, 90)
    rng = random.Random(2)
    gold = [(i, rng.randrange(95)) for i in range(80)]
    w, scope = [rng.choice([0.9, 1.0, 1.1]) for _ in range(90)], [rng.choice(["a", "b", None]) for _ in range(90)]
    v, g = _table(spark, x, odd=False), spark.createDataFrame(gold, "query long, gold long")
    weights = spark.createDataFrame(list(enumerate(w)), "id long, weight double")
    scopes = spark.createDataFrame(list(enumerate(scope)), "id long, scope string")
    s = np.array([[float(tiles.exact(x[[i]], x[[j]])[0]) for j in range(90)] for i in range(90)])

    def want(s, ok):
        return {(q, 1 + sum(s[q, j] > s[q, t] for j in range(90) if j != q and ok(q, j))) for q, t in gold if t < 90 and ok(q, t)}

    ranks = lambda df: {(r["query"], r["gold_rank"]) for r in df.collect()}
    assert ranks(quality.gold_ranks(v, g)) == want(s, lambda q, j: True)
    assert ranks(quality.gold_ranks(v, g, places=9, weights=weights)) == want(np.round(s * np.array(w)[None, :], 9), lambda q, j: True)
    assert ranks(quality.gold_ranks(v, g, scopes=scopes)) == want(s, lambda q, j: scope[q] is not None and scope[q] == scope[j])


def test_prune_sweep_by_levels(spark, small):
    x = _clusters(12, 60)
    rng = random.Random(3)
    f = [rng.choice([0.1, 0.5, 0.7, 0.95]) for _ in range(60)]
    gold = [(i, (i + 1) % 60) for i in range(60)]
    got = {r["threshold"]: (r["killed"], r["p_at_1"], r["mrr"]) for r in quality.prune_sweep(_table(spark, x, odd=False), spark.createDataFrame(gold, "query long, gold long"), spark.createDataFrame(list(enumerate(f)), "id long, fragility double"), [0.6, 0.95]).collect()}
    s = np.array([[float(tiles.exact(x[[i]], x[[j]])[0]) for j in range(60)] for i in range(60)])
    for t in (0.6, 0.95):
        rr = [1 / (1 + sum(s[q, j] > s[q, g] for j in range(60) if j != q and f[j] < t)) if f[g] < t else 0 for q, g in gold]
        assert got[t] == (sum(f[g] >= t for _, g in gold), round(sum(r == 1 for r in rr) / 60, 6), round(sum(rr) / 60, 6))


def test_prune_sweep_compares_what_is_left(spark, monkeypatch):
    """Vectors that every threshold drops are not compared; ties in single precision are told apart."""
    seen = []
    better = tiles.better
    monkeypatch.setattr(tiles, "better", lambda a, b, *args, **kwargs: seen.append((a.rows.agg(F.sum("n")).first()[0], b.rows.agg(F.sum("n")).first()[0])) or better(a, b, *args, **kwargs))
    x = np.random.default_rng(4).normal(size=(90, 5))
    x[10:40] = x[3] * (1 + np.arange(30)[:, None] * 1e-12)
    f = [0.9 if i % 3 == 0 else 0.1 for i in range(90)]
    gold = [(i, (i + 1) % 90) for i in range(90)]
    got = quality.prune_sweep(_table(spark, x, odd=False), spark.createDataFrame(gold, "query long, gold long"), spark.createDataFrame(list(enumerate(f)), "id long, fragility double"), [0.5]).first()
    s = np.array([[float(tiles.exact(x[[i]], x[[j]])[0]) for j in range(90)] for i in range(90)])
    rr = [1 / (1 + sum(s[q, j] > s[q, g] for j in range(90) if j != q and f[j] < 0.5)) if f[g] < 0.5 else 0 for q, g in gold]
    assert (got["killed"], got["mrr"]) == (30, round(sum(rr) / 90, 6)) and seen == [(60, 60)]


def test_label_relevance_counts_members(spark):
    from lorekeep.operators import evalir

    labels = spark.createDataFrame([(1, 0), (2, 0), (3, 0), (4, 1), (5, None)], "id long, label int")
    results = spark.createDataFrame([(1, 4, 1), (1, 2, 2), (2, 3, 1), (3, 4, 1), (4, 1, 1), (5, 1, 1)], "query long, id long, rank int")
    pairs = labels.join(labels.select(F.col("id").alias("o"), "label"), "label").filter("id <> o").select(F.col("id").alias("query"), F.col("o").alias("id"))
    assert evalir.label_relevance(results, labels).first() == evalir.relevance_set(results, pairs).first()


# the quantised index


def test_codes_keep_inner_products():
    from lorekeep.operators import index

    x = np.random.default_rng(0).normal(size=(200, 65))
    scale, code = index.encode(x)
    back = index.decode(scale, code, 65)
    assert code.shape == (200, 33) and code.dtype == np.uint8
    turned = x @ index.rotation(65).T
    cos = (back * turned).sum(1) / np.linalg.norm(back, axis=1) / np.linalg.norm(turned, axis=1)
    assert cos.min() > 0.98 and np.allclose((back * turned).sum(1), (x * x).sum(1))
    assert np.allclose(index.levels(), -index.levels()[::-1], atol=1e-3)
    assert index.decode(*index.encode(np.zeros((1, 4))), 4).tolist() == [[0.0] * 4]


def test_index_inserts_and_removes(spark):
    from lorekeep.operators.index import VectorIndex

    x = np.random.default_rng(5).normal(size=(120, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    base = _table(spark, x)
    index = VectorIndex.create(spark, 16)
    asked = base.filter("id < 120").withColumnRenamed("id", "query")
    assert index.search(asked, base, 3).count() == 0
    index.insert(base)

    def found(base):
        return {(r["query"], r["rank"]): r["id"] for r in index.search(asked, base, 3, over=6).collect()}

    def want(ids, y):
        out = {}
        for q in range(120):
            best = sorted(ids, key=lambda i: (-float(tiles.exact(x[[q]], y[[i]])[0]), i))[:3]
            out |= {(q, k): i for k, i in enumerate(best, 1)}
        return out

    assert found(base.filter("id < 120")) == want(range(120), x)
    index.remove(spark.createDataFrame([(0,), (1,), (500,), (None,)], "id long"))
    assert found(base.filter("id < 120")) == want(range(2, 120), x)
    y = x.copy()
    y[[1, 2]] = x[[2, 1]]
    index.insert(_table(spark, y, odd=False).filter("id in (1, 2)"))
    assert found(_table(spark, y, odd=False)) == want(range(1, 120), y)
    index.compact()
    assert found(_table(spark, y, odd=False)) == want(range(1, 120), y) and index.codes().filter("id < 120").count() == 119


def test_index_cuts_and_fills(spark):
    from lorekeep.operators.index import VectorIndex

    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0, 0.0, 0.0, 9.0]), (3, [0.0, 0.0, 1.0, 0.0])], "id long, vector array<double>")
    index = VectorIndex.create(spark, 4)
    index.insert(rows)
    got = {r["query"]: r["id"] for r in index.search(rows.withColumnRenamed("id", "query"), rows, 1).collect()}
    assert got == {1: 1, 2: 2, 3: 3}


def test_index_search_is_exact(spark):
    """Also where estimates put one of the best rows behind those that are looked at first."""
    from lorekeep.operators.index import VectorIndex

    x = np.random.default_rng(5).normal(size=(3_000, 64))
    x[100:130] = x[7]  # equal ones: ties go to smaller ids
    x[200:400] = x[8] + np.random.default_rng(6).normal(size=(200, 64)) * 0.01
    x[9] = 0
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, vector array<double>")
    index = VectorIndex.create(spark, 64)
    index.insert(rows)
    asked = rows.filter("id < 60").withColumnRenamed("id", "query")
    got = {(r["query"], r["rank"]): r["id"] for r in index.search(asked, rows, 10, over=1).collect()}
    s = np.zeros((60, len(x)))
    for d in range(64):
        s += x[:60, d, None] * x[None, :, d]
    assert got == {(q, r + 1): int(i) for q in range(60) for r, i in enumerate(np.lexsort((np.arange(len(x)), -s[q]))[:10])}


def test_corroboration_counts_sessions_without_pairs(spark, monkeypatch):
    """One session holds more vectors than a tile, some ids are repeated, some records have no session or are none."""
    def never(*args, **kwargs):
        raise AssertionError("a row for each pair")

    monkeypatch.setattr(tiles, "similar", never)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3_400, 6))
    x /= np.sqrt((x * x).sum(1))[:, None]
    ids = [*range(3_390), *range(10)]
    unit = {i: "" if i % 9 == 0 else None if i % 10 == 3 else "big" if i % 8 else f"s{i % 5}" for i in range(3_380)}
    rows = spark.createDataFrame([*zip(ids, x.tolist(), strict=True), (4_000, None), (4_001, [1.0])], "id long, vector array<double>")
    got = {(r["id"], r["support"], r["score"]) for r in quality.corroboration(rows, spark.createDataFrame([*unit.items(), (4_000, "s1")], "id long, session_id string"), 0.6, 0.97).collect()}
    name = {i: u or f"id:{i}" for i, u in unit.items()}
    names = np.array([name.get(i, "") for i in ids])
    met = {i: set() for i in [*ids, 4_000, 4_001]}
    for i, v in zip(ids, x, strict=True):
        s = sum(x[:, d] * v[d] for d in range(6))
        if i in name:
            met[i] |= set(names[(s >= 0.6) & (s < 0.97) & (np.array(ids) != i)].tolist()) - {"", name[i]}
    assert got == {(i, len(m), round(min(len(m), 5) / 5, 6)) for i, m in met.items()}


def test_fragility_makes_noise_in_the_tasks(spark, monkeypatch):
    """Vectors are tiled once, without their noisy copies."""
    tiled, sizes = tiles.tiled, []
    monkeypatch.setattr(tiles, "tiled", lambda *args, **kwargs: sizes.append(t := tiled(*args, **kwargs)) or t)
    x = np.random.default_rng(3).normal(size=(70, 8))
    x /= np.sqrt((x * x).sum(1))[:, None]
    got = {r["id"]: r["fragility"] for r in quality.fragility(spark.createDataFrame([*enumerate(x.tolist()), (500, [1.0]), (501, None)], "id long, vector array<double>"), 0.2, 5, 3).collect()}

    def near(y, i):
        s = x @ y
        return set(sorted((j for j in range(70) if j != i), key=lambda j: (-s[j], j))[:5])

    for i in range(70):
        rng = np.random.default_rng([42, i])
        share = []
        for _ in range(3):
            y = x[i] + rng.normal(0, 0.2, 8)
            a, b = near(x[i], i), near(y / np.linalg.norm(y), i)
            share.append(len(a & b) / len(a | b))
        assert got.pop(i) == pytest.approx(1 - np.mean(share), abs=1e-6)
    assert not got and [t.rows.agg(F.sum("n")).first()[0] for t in sizes] == [71]
