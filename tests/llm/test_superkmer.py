import random
import re
from collections import Counter

import numpy as np
import pytest

from lorekeep.llm import superkmer, textbuf


def _words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def _brute(rows, k):
    least = {}
    for i, t in rows:
        w = _words(t)
        for p in range(len(w) - k + 1) if i is not None else ():
            s = tuple(w[p : p + k])
            least[s] = min(i, least.get(s, i))
    out = Counter()
    for i, t in rows:
        w = _words(t)
        off = {q for p in range(len(w) - k + 1) if i is not None and least[tuple(w[p : p + k])] < i for q in range(p, p + k)}
        out[(i, len(w), len(off), " ".join(x for p, x in enumerate(w) if p not in off))] += 1
    return out


def _corpus(seed, k):
    rng = random.Random(seed)
    passages = [[rng.choice("abcdé") for _ in range(rng.randrange(k - 1, 4 * k))] for _ in range(6)]
    rows = []
    for i in range(80):
        w = []
        for _ in range(rng.randrange(0, 5)):
            w += rng.choice(passages) if rng.random() < 0.6 else [f"w{rng.randrange(50)}" for _ in range(rng.randrange(1, 30))]
        rows.append((rng.choice([i, i, 7, None]), rng.choice([" ", "  ", "\n", " \t"]).join(w) + rng.choice(["", " ", "\n"])))
    rows += [(200, None), (201, ""), (202, " \n"), (3, "x " * 400), (2, "x " * 300), (300, "x y " * 50), (301, " ".join("ab" * 30)), (302, "𝒳 " * 20)]
    return rows + rows[:5]


@pytest.mark.parametrize(("seed", "window", "gram", "bins", "bucket", "unit"), [(1, 13, 3, 64, 1 << 20, 1 << 20), (2, 5, 2, 1 << 16, 200, 300), (3, 4, 4, 1, 60, 100), (4, 1, 1, 8, 1 << 20, 500)])
def test_report_against_all_windows(spark, seed, window, gram, bins, bucket, unit):
    rows = _corpus(seed, window)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "2 as key", "3 as _gone", "4 as n_words", "'k' as kept").repartition(3)
    rule = superkmer.Rule(window, gram, bins=bins, bucket_bytes=bucket, unit_bytes=unit)
    want = _brute(rows, window)
    assert Counter(tuple(r) for r in superkmer.report(df, rule).collect()) == want
    cleaned = superkmer.clean(df, rule)
    assert cleaned.schema == df.schema
    assert Counter((r["doc_id"], " ".join(_words(r["text"]))) for r in cleaned.collect()) == sum((Counter({(i, kept): n}) for (i, _, _, kept), n in want.items()), Counter())


def test_empty_tables_and_untouched_texts(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert superkmer.report(empty).count() == 0 and superkmer.clean(empty).count() == 0
    rows = [(1, None), (2, ""), (3, " a\tb  ")]
    assert {tuple(r) for r in superkmer.clean(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == set(rows)


def test_hashes_that_clash_are_told_apart(monkeypatch):
    word = np.array([0, 1, 2, 0, 1, 2, 3, 1, 2, 0, 1, 4])
    start = np.array([0, 3, 6, 9])
    mix, calls = textbuf.mix, []

    def poor(h):
        calls.append(len(h))
        return np.zeros_like(h) if len(calls) <= 4 else mix(h)

    monkeypatch.setattr(textbuf, "mix", poor)
    by, same = superkmer.sorted_windows(word, start, 3)
    groups = [[start[i]] for i in by]
    out = []
    for g, s in zip(groups, same, strict=True):
        out[-1].extend(g) if s else out.append(list(g))
    assert sorted(map(sorted, out)) == [[0, 3], [6], [9]]


def test_long_text(spark):
    rng = random.Random(8)
    text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(200_000))
    rows = [(1, text), (2, "start " + text[: text.index(" ", 500_000)] + " end")]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in superkmer.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    n = len(_words(rows[1][1]))
    assert got == {1: (200_000, 0), 2: (n, n - 2)}
