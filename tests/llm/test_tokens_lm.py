import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lorekeep.llm import packing, ppm, tokens
from lorekeep.llm.queries import byte_bpe
from lorekeep.llm.session import crc32_text

TEXTS = [
    "Hello, world! It's here.\n\n  Two  spaces\tand tabs\r\n", "", None, "naïve café — été. Ça va?", "a\u00a0 b\u2003 c\u3000\u00a0x", "<|endoftext|> inside <|endoftext|>.", "   ", "日本語のテキスト。 と 空白", "x" * 3000,
    "don't we're I'll they've you'd", "1,234.56 (a.b) a.b.c!!! ...", "\x1c\x1d a\x85b \u200b\u200a c", "emoji 😀😀 😀", "\n\n\n", "end ", "'s 's's",
]


def _plain(text):
    return [*Tokenizer.from_file(byte_bpe()).encode(text or "", add_special_tokens=False).ids, 2]


def test_round_trip_through_files(spark, tmp_path):
    rows = [(100 - i, t) for i, t in enumerate(TEXTS * 2)] + [(50, "same id"), (50, "same id too"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("shard", F.lit(1)).repartition(5)
    w = tokens.write(docs, f"file://{tmp_path}/t", byte_bpe())
    got = sorted(((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in tokens.read_back(spark, w).collect()), key=lambda x: x[0])
    assert [r[1] for r in got] == sorted((r[0] for r in rows), key=lambda x: -1 if x is None else x)
    start = 0
    want = {}
    for i, t in rows:
        ids = np.array(_plain(t), "<u4")
        want.setdefault(i, []).append((len(ids), zlib.crc32(ids.tobytes())))
    for s, i, n, crc in got:
        assert s == start and (n, crc) in want[i]
        start += n
    m = w.manifest.first()
    shard = tokens.Shard(w.path, m["file"])
    i = next(x for x, t in rows if t and "naïve" in t)
    assert [d.tolist() for d in shard.find(i)] == [_plain(TEXTS[3])]
    shard.close()


def test_another_dictionary_is_refused(spark, tmp_path):
    w = tokens.write(spark.createDataFrame([(1, "a")], "doc_id long, text string"), f"file://{tmp_path}/t", byte_bpe())
    Path(tmp_path / "t/dictionary").write_bytes(b"other")
    with pytest.raises(ValueError, match="another dictionary"):
        tokens.Shard(w.path, w.manifest.first()["file"])


def test_empty_table(spark, tmp_path):
    w = tokens.write(spark.createDataFrame([], "doc_id long, text string"), f"file://{tmp_path}/t", byte_bpe())
    assert tokens.read_back(spark, w).count() == 0


def test_many_shards_are_in_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokens, "LEAST_SHARD", 200)
    rows = [(i * 7 % 101, f"text number {i} " * (i % 5)) for i in range(101)]
    w = tokens.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), f"file://{tmp_path}/t", byte_bpe())
    assert w.manifest.count() > 5
    got = tokens.read_back(spark, w).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == list(range(101)) and [r["start"] for r in got] == np.cumsum([0] + [r["n_tokens"] for r in got[:-1]]).tolist()


@pytest.mark.parametrize("seed", range(6))
def test_boundaries_are_optimal(seed):
    rng = random.Random(seed)
    lengths = np.array(sorted(rng.sample(range(1, 60), rng.randrange(1, 9))))
    counts = np.array([rng.randrange(1, 9) for _ in lengths])
    for k in range(1, 6):
        best = min(packing.padding(lengths, counts, [*c, int(lengths[-1])]) for n in range(min(k, len(lengths))) for c in combinations(lengths[:-1].tolist(), n))
        got = packing.boundaries(lengths, counts, k)
        assert len(got) <= k and packing.padding(lengths, counts, got) == best
    assert packing.boundaries(np.zeros(0, int), np.zeros(0, int)) == []


def test_batches_fit_the_budget(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([3, 5, 9, 40, 200])) for i in range(300)] + [(7, 9), (None, 3), (900, 5000)]
    got = packing.pack_lengths(spark.createDataFrame(rows, "doc_id long, n_tokens long").repartition(7), n_buckets=3, budget=400).collect()
    assert sorted((r["doc_id"] or -1, r["n_tokens"]) for r in got) == sorted((a or -1, b) for a, b in rows)
    batches = {}
    for r in got:
        assert r["n_tokens"] + r["padding"] == r["bucket_tokens"]
        batches.setdefault((r["bucket"], r["batch_id"]), []).append(r)
    ids = sorted(k[1] for k in batches)
    assert ids == list(range(len(ids)))
    for rs in batches.values():
        assert sorted(r["slot"] for r in rs) == list(range(len(rs)))
        assert len(rs) == 1 or sum(r["bucket_tokens"] for r in rs) <= 400
    one = [r["doc_id"] or -1 for r in sorted((r for r in got if r["bucket"] == 0), key=lambda r: (r["batch_id"], r["slot"]))]
    assert one == sorted(one)
    assert packing.pack_lengths(spark.createDataFrame([], "doc_id long, n_tokens long")).count() == 0


def _words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


LM = ["The cat sat", "the CAT sat on the mat", "a  b\tc", "", None, "thé cat\nsat", "zz zz zz", "mat the", "on the mat a cat", "x"]


@pytest.mark.parametrize(("max_trie", "max_words"), [(4_000_000, 6_000_000), (40, 5)])
def test_scores_against_plain_models(spark, max_trie, max_words):
    rows = [(i, t) for i, t in enumerate(LM * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("score", F.lit("clash"))
    train = [(i, t) for i, t in rows if crc32_text(i) % 10 != 0]
    assert len(train) < len(rows)
    model = ppm.AdaptivePPM(3)
    counts = Counter()
    for _, t in train:
        model.read(t, learn=True, score=False)
        counts.update([*_words(t), None])
    n, v = sum(counts.values()), len(counts)
    got = {r["doc_id"]: r for r in ppm.score(docs, order=3, max_trie=max_trie, max_words=max_words).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        tok = [*_words(t), None]
        r = got[i]
        assert r["held_out"] == (crc32_text(i) % 10 == 0) and r["train_tokens"] == n
        assert (r["n_tokens"], r["n_known"]) == (len(tok), sum(counts[x] > 0 for x in tok))
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tok), abs=1e-9)
        assert r["score"] == pytest.approx(model.read(t, learn=False), abs=1e-9)


def test_model_sums_to_one():
    m = ppm.AdaptivePPM(2)
    m.read("the cat sat on the mat", score=False)
    for context in (b"th", b"zz", bytes([ppm.START] * 2), b"e "):
        assert sum(10 ** m.log10(context, b) for b in range(256)) == pytest.approx(1, abs=1e-9)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(i, "ab") for i in range(200) if crc32_text(i) % 10 == 0], "doc_id long, text string")
    r = ppm.score(docs).first()
    assert r["train_tokens"] == 0 and r["n_known"] == 0 and r["score"] == pytest.approx(-3 * math.log10(256))
    assert ppm.score(docs.filter("false")).count() == 0


def test_adaptive_reading_gets_cheaper():
    m = ppm.AdaptivePPM(3)
    assert m.read("some words in a row") < m.read("some words in a row") < 0
