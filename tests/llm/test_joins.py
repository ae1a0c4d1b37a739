import hashlib
import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lorekeep.llm import ann, decontam, jaccard, textbuf, urlfilter


def _lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def _sets(rows, width):
    out = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", _lower(t))
        out[i] = {tuple(w)} if 0 < len(w) < width else {tuple(w[k : k + width]) for k in range(len(w) - width + 1)}
    return out


def _brute_components(rows, width, percent):
    sets = _sets(rows, width)
    comp = {i: i for i in sets}
    links = [(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(comp[a], comp[b])
            if (comp[a], comp[b]) != (m, m):
                comp[a] = comp[b] = m
                changed = True
    return {i: (len(sets[i]), comp[i]) for i in sets}, links


def _corpus(seed, n=60, vocab=400):
    rng = random.Random(seed)
    rows, i = [], 0
    passage = [f"p{k}" for k in range(30)]
    for _ in range(n):
        base = [f"w{rng.randrange(vocab)}" for _ in range(rng.randrange(1, 90))]
        if rng.random() < 0.3:
            base += passage
        for _ in range(rng.choice([1, 1, 2, 5])):
            copy = list(base)
            for _ in range(rng.randrange(0, 3)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(99)}"
            rows.append((i, " ".join(copy)))
            i += 1
    return [*rows, (1000, None), (1001, ""), (1002, "  \n"), (1003, "One"), (1004, "one"), (1005, "one two"), (1006, "ONE\ttwo")]


@pytest.mark.parametrize(("seed", "width", "percent", "pivots"), [(1, 3, 90, 16), (2, 5, 80, 16), (3, 3, 90, 2), (4, 1, 60, 2), (6, 2, 70, 4)])
def test_components_against_all_pairs(spark, monkeypatch, seed, width, percent, pivots):
    monkeypatch.setattr(jaccard, "PIVOTS", pivots)
    rows = _corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("n", F.lit("clash"))
    want, links = _brute_components(rows, width, percent)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.components(docs, jaccard.Rule(width, percent)).collect()}
    assert got == want and links


def test_all_links_between_classes(spark):
    rows = _corpus(5)
    join = jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), jaccard.Rule(3, 80))
    key = {r["doc_id"]: r["key"] for r in join.profiles.collect()}
    got = {tuple(sorted((r["a"], r["b"]))) for r in join.links.collect()}
    want = {tuple(sorted((key[a], key[b]))) for a, b in _brute_components(rows, 3, 80)[1] if key[a] != key[b]}
    assert got == want


def test_repeats_and_empty_tables(spark):
    docs = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (2, "a b c d e f"), (7, "other words are here now"), (None, "a b c d e f")], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["component_id"]) for r in jaccard.components(docs).collect())
    assert got == [(-1, None), (2, 2), (5, 2), (5, 2), (7, 7)]
    assert sorted(r["doc_id"] or -1 for r in jaccard.keep_one(docs).collect()) == [-1, 2, 7]
    assert jaccard.components(docs.filter("false")).count() == 0


def test_one_row_of_each_group_stays_whatever_its_id(spark):
    base = [f"w{i}" for i in range(60)]
    near = [" ".join(base[:i] + ["x"] + base[i + 1 :]) for i in (0, 59)]
    alone = [" ".join(f"{c}{i}" for i in range(30)) for c in "abcde"]
    rows = [(1, " ".join(base)), (5, near[0]), (5, alone[0]), (7, alone[1]), (7, alone[1].upper()), (7, alone[1] + " more"), (None, near[1]), (None, alone[2]), (None, alone[2]), (None, alone[2] + " more")]
    rows += [(None, alone[3]), (9, ""), (9, ""), (9, None), (None, ""), (None, "")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, key int")
    kept = jaccard.keep_one(docs, with_null_ids=True)
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert kept.columns == docs.columns and len(got) == 8
    for want in [(1, " ".join(base)), (5, alone[0]), (None, alone[3]), (9, ""), (9, None), (None, "")]:
        assert got.count(want) == 1
    assert sum(i == 7 for i, _ in got) == 1 and sum(i is None and (t or "").startswith("c0") for i, t in got) == 1
    apart = [(r["doc_id"], r["text"]) for r in jaccard.keep_one(docs).collect()]
    assert len(apart) == 9 and (None, near[1]) in apart


def test_prefixes_lose_no_similar_pair():
    rng = np.random.default_rng(0)
    level = rng.integers(0, 255, 1 << 10).astype(np.uint8)
    rule = jaccard.Rule(3, 90)
    for _ in range(200):
        n = int(rng.integers(1, 120))
        a = np.unique(rng.integers(0, 2**62, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[int(rng.integers(0, len(a) // 10 + 1)) :], rng.integers(0, 2**62, int(rng.integers(0, 4))).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both < 90 * (len(a) + len(b) - both):
            continue
        for seed in jaccard._SEEDS:
            pre = [jaccard.ranked(x, level[jaccard.buckets(x, 10)], seed, len(x) - rule.overlap(len(x)) + 1) for x in (a, b)]
            assert len(np.intersect1d(*pre))


def test_levels_keep_the_order_of_counts():
    for scale in (0.1, 5, 800):
        counts = np.random.default_rng(1).poisson(scale, 4096).astype(np.uint32)
        counts[:8] = [0, 1, 2, 50, 3000, 10**5, 10**6, 10**7]
        order = np.argsort(counts, kind="stable")
        assert (np.diff(jaccard.levels(counts)[order].astype(int)) >= 0).all()


WINDOW = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def _brute_hits(docs, items):
    def words(t):
        return re.findall(WINDOW, _lower(t))

    wins = {}
    for item, t in items:
        w = words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[k : k + n]), set()).add(str(item))
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if (own := wins.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= own
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("block_words", [1_000_000, 40])
def test_decontamination_against_brute_force(spark, block_words):
    rng = random.Random(7)
    vocab = [f"w{k}" for k in range(12)] + ["été", "a1"]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(n))) for k, n in enumerate([40, 10, 9, 1, 2, 3, 15, 11, 70])] + [(20, None), (21, "..."), (1, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11"), (22, "w3, w3! w3")]
    docs = []
    for i in range(60):
        w = [rng.choice(vocab) for _ in range(rng.randrange(0, 60))]
        if i % 3 == 0:
            t = items[rng.randrange(9)][1].split()
            a = rng.randrange(len(t))
            w[len(w) // 2 : len(w) // 2] = t[a : a + rng.randrange(1, 30)]
        docs.append((i, ". ".join(w).upper() if i % 2 else " ".join(w)))
    docs += [(90, None), (91, ""), (92, "--"), (5, "w1 w1")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("items", F.lit(0)).withColumn("hits", F.lit(0))
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.report(d, b, block_words).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    assert sorted(tuple(r) for r in got) == sorted(_brute_hits(docs, items))
    kept = decontam.clean(d, b, block_words)
    assert kept.columns == d.columns and kept.count() == sum(not r["contaminated"] for r in got)


def test_longest_match_and_empty_benchmark(spark):
    d = spark.createDataFrame([(1, "x a b c d y"), (2, "q")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b c d e f g h i j k l")], "item_id long, text string")
    r = {x["doc_id"]: x for x in decontam.report(d, b).collect()}
    assert (r[1]["longest_match"], r[1]["longest_at"], r[1]["n_hit"]) == (4, 1, 0) and r[2]["longest_at"] == -1
    assert {x["n_hit"] for x in decontam.report(d, b.filter("false")).collect()} == {0}
    assert decontam.report(d.filter("false"), b).count() == 0


def test_items_without_id_mark_hits(spark):
    item = " ".join(f"a{i}" for i in range(12))
    d = spark.createDataFrame([(1, f"x {item} y"), (2, "b c d"), (3, "q")], "doc_id long, text string")
    b = spark.createDataFrame([(None, item), (4, "b c"), (None, None)], "item_id long, text string")
    for block_words in (1_000_000, 5):
        got = {r["doc_id"]: (r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontam.report(d, b, block_words).collect()}
        none, four = decontam.sha256_of([]), decontam.sha256_of(["4"])
        assert got == {1: (12, 0, none, True), 2: (2, 1, four, True), 3: (0, 0, none, False)}
        assert [r["doc_id"] for r in decontam.clean(d, b, block_words).collect()] == [3]


def _brute_longest(words, items):
    best, at = 0, -1
    for i in range(len(words)):
        for t in items:
            for j in range(len(t)):
                n = 0
                while i + n < len(words) and j + n < len(t) and words[i + n] == t[j + n]:
                    n += 1
                if n > best and n >= 3:
                    best, at = n, i
    return best, at


def test_longest_matches_at_full_depth(spark):
    rng = random.Random(11)
    a = [f"a{rng.randrange(400)}" for _ in range(300)]
    b = a[20:150] + [f"b{k}" for k in range(150)]
    items = [a, b, ["z"] * 90 + ["y"] + ["z"] * 80, a[:70]]
    docs = [a[5:75] + ["x"] + a[30:260] + ["x"], a[100:] + a, b[60:210] + ["q"] + a[:280], ["z"] * 200, ["z"] * 85 + ["y"] + ["z"] * 70, a[20:160], a[:64] + b[:65], ["q"] * 70, a[:30]]
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")
    t = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    for block_words in (1_000_000, 100):
        got = {r["doc_id"]: (r["longest_match"], r["longest_at"]) for r in decontam.report(d, t, block_words).collect()}
        assert got == {i: _brute_longest(w, items) for i, w in enumerate(docs)}


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
URLS = ["http://a.example.com/en/x?y#z", "https://WWW.Example.COM/en/", "http://www.example.com/en", "http://x.net/fr/1", "http://net/es/", "http://notnet/es/", "ftp://e.com", "no host", "", None, "http://a.b.net#/es/", "x://y://z.com/", "http://example.com:80/en/", "http://.com/", "http:///en/"]


def _brute_rule(url, rules):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = (_lower(m[1]), m[2]) if m else ("", "")
    fit = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fit, key=lambda r: (len(r[1] + r[2]), len(r[1])), default=None)
    return host, path, best[1] + best[2] if best else None, best[0] if best else "allow"


@pytest.mark.parametrize("kind", ["long", "int"])
def test_url_rules_against_brute_force(spark, kind):
    rows = [(i, u, "html") for i, u in enumerate(URLS * 2)]
    got = urlfilter.judge(spark.createDataFrame(rows, f"page_id {kind}, url string, keys string"), [urlfilter.UrlRule(*r) for r in RULES]).collect()
    assert sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got) == [(i, *_brute_rule(u, RULES)) for i, u, _ in rows]
    assert urlfilter.judge(spark.createDataFrame([], "page_id long, url string"), [urlfilter.UrlRule(*r) for r in RULES]).count() == 0
    assert {r["verdict"] for r in urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string, h string"), []).collect()} == {"allow"}


def test_cascade_is_exact_for_its_universe(spark):
    keys = [f"k{i}" for i in range(3000)]
    listed = keys[::7] + ["not in the corpus"]
    universe = spark.createDataFrame([(k,) for k in keys * 2], "key string")
    for c, own in zip(urlfilter.build(universe, [listed, keys[1::9]], 6000), (listed, keys[1::9]), strict=True):
        assert c.has(urlfilter._hashes(keys)).tolist() == [k in set(own) for k in keys] and len(c.filters) > 1


def test_keys_with_the_hash_of_a_listed_one_are_told_apart(monkeypatch):
    real = urlfilter._hashes
    monkeypatch.setattr(urlfilter, "_hashes", lambda keys: np.where([k == "twin" for k in keys], real(["listed"]), real(keys)))
    c = urlfilter._cascade(urlfilter.Bloom.of(real(["listed"]), 0.5, 1), ["listed"], ["other", "twin"])
    assert c.exceptions == {"twin"} and c.has(real(["listed"])).all()


def _brute_nearest(rows, k):
    ok = [(i, np.array(v, float)) for i, v in rows if v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, x in ok:
        if q % 10 == 0:
            best = {}
            for i, y in ok:
                if i != q:
                    d = float(ann.exact(x[None], y[None])[0])
                    best[i] = min(best.get(i, np.inf), d)
            out[q] = sorted((d, i) for i, d in best.items())[:k]
    return out


def test_nearest_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, [float(np.float32(rng.gauss(0, 1))) for _ in range(8)]) for i in range(400)]
    rows += [(500, rows[0][1]), (501, rows[0][1]), (510, [0.0] * 8), (511, None), (512, [1.0, None] * 4), (520, [float("nan")] * 8), (530, [1.0]), (7, rows[3][1])]
    index = ann.build(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("vector", F.lit(0)))
    got = {}
    for r in ann.search(index, index.rows.filter("vec_id % 10 = 0").select("vec_id", "vector"), 5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    want = _brute_nearest(rows, 5)
    assert set(got) == set(want)
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.98 * 5 * len(want)
    assert sum(got[q] == want[q] for q in want) >= 0.9 * len(want)


def test_copies_of_one_id_fill_one_place(spark):
    rng = random.Random(8)
    rows = [(i, [float(np.float32(rng.gauss(0, 1))) for _ in range(8)]) for i in range(60)]
    rows += [(1, rows[0][1])] * 40 + [(2, [float(np.float32(x + 0.01)) for x in rows[0][1]])] * 30
    index = ann.build(spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1))
    got = {}
    for r in ann.search(index, index.rows.filter("vec_id = 0").select("vec_id", "vector"), 5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    assert got[0] == _brute_nearest(rows, 5)[0]


def test_no_vectors_and_few_vectors(spark):
    empty = ann.build(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>"))
    assert ann.search(empty, empty.rows, 3).count() == 0
    few = ann.build(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<float>"))
    assert [(r["query_id"], r["vec_id"]) for r in ann.search(few, few.rows, 10).orderBy("query_id").collect()] == [(0, 1), (1, 0)]


def test_slices_keep_documents_whole():
    s = list(textbuf.slices(pa.array(["a" * 10, "b" * 10, None, "c"]), 12))
    assert [(x.row, x.n, len(x.data)) for x in s] == [(0, 1, 10), (1, 3, 11)]


def test_recall_and_share_of_exact_comparisons_at_64_components():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(12_000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    ids, q = np.arange(len(x)), np.arange(0, len(x), 400)
    turn, center = ann.rotation(64), x.mean(0)
    y = x - center
    norm = np.linalg.norm(y, axis=1)
    unit = (y / norm[:, None]) @ turn
    code, dot = np.packbits(unit >= 0, axis=1), np.abs(unit).sum(1) / 8
    near = ann.Nearest(ids[q], x[q], center, turn, 10, ann.EPSILON)
    for i in range(0, len(x), 8192):
        near.add(ids[i : i + 8192], x[i : i + 8192], code[i : i + 8192], norm[i : i + 8192], dot[i : i + 8192])
    to, vec, _ = near.found
    hits = 0
    for i, own in enumerate(q):
        d = np.linalg.norm(x - x[own], axis=1)
        d[own] = np.inf
        hits += len(set(np.argsort(d)[:10]) & set(vec[to == i]))
    assert hits >= 0.9 * 10 * len(q)
    assert near.compared < 0.25 * len(x) * len(q)
