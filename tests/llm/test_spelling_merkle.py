import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from lorekeep.llm import merkle, spelling

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# spelling


def _one_edit(a, b):
    shorter = {a[:i] + a[i + 1 :] for i in range(len(a))}
    return a != b and (b in shorter or any(b[:i] + b[i + 1 :] == a for i in range(len(b))) or (len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1))


def _variants(rows):
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= 3}
    form, near = {}, {}
    for w in n:
        near[w] = sorted((v for v in n if _one_edit(w, v)), key=lambda v: (-n[v], v))
        form[w] = near[w][0] if near[w] and n[near[w][0]] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root))
    return sorted(out)


def _rows(df):
    return sorted(tuple(r) for r in df.select("word", "n", "n_near", "form", "form_n", "root").collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_variants_against_all_pairs(spark, monkeypatch, seed):
    monkeypatch.setattr(spelling, "SHARD_WORDS", 7)
    monkeypatch.setattr(spelling, "PASS_BYTES", 2000)
    monkeypatch.setattr(spelling, "BLOCK", 16)
    rng = random.Random(seed)
    letters = "abÀéZ×"
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(4, 8))) for _ in range(25)]
    rows = [(i, " ".join(rng.choice(base) for _ in range(rng.randrange(1, 80))) + rng.choice(["", "1", "\n"])) for i in range(40)]
    rows += [(None, " ".join(base)), (None, None), (3, ""), (3, "ÉTÉÉÉ étééé ETEEE"), *[(5, "x" * 20_000)] * 3, *[(5, "x" * 20_001)] * 7]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as word", "'a' as n", "2 as run", "'q' as near")
    assert _rows(spelling.variants(spelling.vocabulary(df))) == _variants(rows)


def test_no_words(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert _rows(spelling.variants(spelling.vocabulary(empty))) == []
    assert _rows(spelling.variants(spelling.vocabulary(spark.createDataFrame([(1, None), (2, "ab")], "doc_id long, text string")))) == []


def test_forms_lead_to_a_root(spark):
    words = spark.createDataFrame([("aaaaa", 3), ("aaaab", 6), ("aaabb", 12), ("aabbb", 24), ("zzzzz", 9), ("zzzzy", 9)], "word string, n long")
    got = {r["word"]: (r["form"], r["root"], r["n_near"]) for r in spelling.variants(words).collect()}
    assert got == {"aaaaa": ("aaaab", "aabbb", 1), "aaaab": ("aaabb", "aabbb", 2), "aaabb": ("aabbb", "aabbb", 2), "aabbb": (None, "aabbb", 1), "zzzzz": (None, "zzzzz", 1), "zzzzy": (None, "zzzzy", 1)}


def test_automaton_in_a_trie():
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("ab\U0001f600") for _ in range(rng.randrange(0, 7))) for _ in range(200)})
    shard = spelling.build(words, [1] * len(words))
    asked = sorted({*words, "zzz", "", "b" * 40})
    got = defaultdict(list)
    for i, k in spelling.neighbours(asked, shard):
        got[asked[i]].append(words[k])
    assert {w: sorted(v) for w, v in got.items()} == {w: v for w in asked if (v := [v for v in words if _one_edit(w, v)])}


# Merkle manifest


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(doc_id, text, lang, source, n_chars):
    return _h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def _tree(leaves):
    """The root, and the siblings of each leaf: (left, right) by level."""
    way, at = [[] for _ in leaves], list(range(len(leaves)))
    while len(leaves) > 1:
        runs = [leaves[i : i + 8] for i in range(0, len(leaves), 8)]
        for k, p in enumerate(at):
            run, i = runs[p // 8], p % 8
            way[k].append(("".join(run[:i]), "".join(run[i + 1 :])))
            at[k] = p // 8
        leaves = [_h(*r) for r in runs]
    return leaves[0], way


def _manifest(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0] is not None, r[0] or 0, _leaf(*r), r))
    keys = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: _tree([x[2] for x in sorted(groups[g])]) for g in keys}
    root, upper = _tree([trees[g][0] for g in keys])
    out = []
    for j, g in enumerate(keys):
        for x, way in zip(sorted(groups[g]), trees[g][1], strict=True):
            doc_id, text, *rest = x[3]
            changed = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0 and text is not None
            h = _leaf(doc_id, re.sub("[A-Z]", lambda m: m[0].lower(), text) if changed else text, *rest)
            for left, right in way + upper[j]:
                h = _h(left, h, right)
            out.append((doc_id, x[2], trees[g][0], root, _h(*(s for pair in way + upper[j] for s in pair)), h, h == root))
    return out


@pytest.mark.parametrize(("n", "langs"), [(1, ["en"]), (9, ["en"]), (200, ["en", "en", "en", None, "", "é", "z", "a", "b", "c", "d", "e"])])
def test_manifest_against_plain_trees(spark, n, langs):
    rng = random.Random(n)
    rows = [(rng.choice([i, 7, None]) if n > 9 else i, rng.choice(["Text", "text É", "", None, "A" * 5000]), rng.choice(langs), rng.choice(["s", None]), rng.choice([1, None])) for i in range(n)]
    rows += rows[:3] if n > 9 else []
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as id", "2 as key", "3 as place", "4 as hash", "5 as way", "6 as level", "7 as at", "8 as run")
    got = merkle.manifest(df, tampered={"text": merkle.lowered_where(3)}).select("id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert Counter(tuple(r) for r in got) == Counter(_manifest(rows))


def test_manifest_of_no_rows(spark):
    assert merkle.manifest(spark.createDataFrame([], DOCS)).count() == 0


def test_a_way_leads_to_the_root(spark):
    rows = [(i, f"t{i}", "en", "s", 2) for i in range(70)]
    for r in merkle.manifest(spark.createDataFrame(rows, DOCS)).collect():
        h = r["leaf"]
        for s in r["way"]:
            h = _h(s["left"], h, s["right"])
        assert h == r["root"] and r["verified"]
