import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lorekeep.llm import labelled, langid, quality, textbuf, toxicity
from lorekeep.llm.session import crc32_text

LANGS = {"en": "the and of that with from this have not they", "de": "der und die das mit von nicht sie einen größe", "fr": "le et de la que avec dans pas une été"}


def _docs(n=240, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = sorted(LANGS)[i % 3]
        words = [rng.choice(LANGS[lang].split()) for _ in range(rng.randrange(8, 60))]
        toxic = i % 5 == 0
        if toxic:
            words.insert(rng.randrange(len(words)), {"en": "vile", "de": "ekelhaft", "fr": "ignoble"}[lang])
        good = i % 4 != 3
        text = " ".join(words) if good else " ".join(w.upper() + "!!" for w in words[:4] * 8)
        rows.append((i, text, lang, int(good), int(toxic and good)))
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    rows = _docs()
    docs = spark.createDataFrame([r[:3] for r in rows] + [(900, None, "en"), (901, "", None), (902, "12 34", "en"), (903, "é" * 50_000, "fr"), (0, rows[0][1], "en"), (None, "no id", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3], r[4]) for r in rows] + [(None, 1, 1), (5, None, None), (7777, 1, 0)], "doc_id long, quality int, toxic int")
    return docs.withColumn("y", F.lit("clash")).withColumn("score", F.lit(1)), labels, rows


def test_fold_matches_zlib(tables):
    docs, labels, rows = tables
    got = quality.score(docs, quality.train(docs, labels)).filter("doc_id is not null").collect()
    assert all(r["held_out"] == (crc32_text(r["doc_id"]) % 4 == 2) for r in got)


@pytest.mark.parametrize("module", [toxicity, quality])
def test_held_out_accuracy(tables, module):
    docs, labels, rows = tables
    out = module.score(docs, module.train(docs, labels)).collect()
    assert len(out) == len(rows) + 6 and all(0 <= r["score"] <= 1 for r in out)
    truth = {r[0]: r[4 if module is toxicity else 3] for r in rows}
    own = [(r["predicted"], truth[r["doc_id"]]) for r in out if r["held_out"] and r["doc_id"] in truth]
    assert sum(a == b for a, b in own) >= 0.9 * len(own)


@pytest.mark.parametrize("module", [toxicity, quality])
def test_without_labels_or_rows(spark, tables, module):
    docs, labels, _ = tables
    model = module.train(docs, labels.filter("false"))
    assert {r["score"] for r in module.score(docs, model).collect()} == {0.5}
    assert module.score(docs.filter("false"), model).count() == 0
    one = module.train(docs, labels.withColumn("toxic", F.lit(0)).withColumn("quality", F.lit(1)))
    assert len({r["score"] for r in module.score(docs, one).collect()}) == 1


def test_scores_do_not_depend_on_other_columns(spark, tables):
    docs, labels, _ = tables
    model = toxicity.train(docs, labels)
    a = toxicity.score(docs, model).select("doc_id", "score").orderBy("doc_id", "score").collect()
    b = toxicity.score(docs.withColumn("lang", F.lit("xx")), model).select("doc_id", "score").orderBy("doc_id", "score").collect()
    assert a == b


def test_thresholds_by_language():
    s, y = np.array([0.9, 0.8, 0.2, 0.1] * 30), np.array([1, 1, 0, 0] * 30)
    t = toxicity.language_thresholds(s, y, ["en"] * 120)
    assert 0.2 < t["en"] <= 0.8 and toxicity.language_thresholds(s, y, [None] * 120) == {}


def test_pooling_in_blocks_equals_one_block(monkeypatch):
    rng = np.random.default_rng(1)
    net = toxicity.ConvNet.start(rng)
    for t in net.tables:
        t[1:] = rng.normal(size=(len(t) - 1, toxicity.DIM))
    counts = np.array([0, 5, 1, 40, 0, 3])
    a, b = (rng.integers(1, 1000, counts.sum()).astype(np.int32) for _ in range(2))
    whole = net.pooled(a, b, counts)
    monkeypatch.setattr(toxicity, "BLOCK_WORDS", 7)
    assert np.allclose(whole, net.pooled(a, b, counts), atol=1e-5)
    at = 5
    x = np.concatenate([net.tables[0][a[at : at + 1]] + net.tables[1][b[at : at + 1]], np.zeros((2, toxicity.DIM), np.float32)])
    one = max(0.0, float((x[:1] @ net.kernels[1][0])[0, 0] + net.bias[0]))
    assert whole[2, 0] == pytest.approx(one, abs=1e-5)


def test_discriminant_against_plain_densities():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 1, (300, 3)), rng.normal(1.5, 2, (200, 3))])
    y = np.r_[np.zeros(300, int), np.ones(200, int)]
    m = quality.fit(x, y)
    z = (x - m.center) / m.scale
    for k in range(2):
        low = np.linalg.inv(m.inverse_factors[k])
        cov = low @ low.T
        assert m.log_dets[k] == pytest.approx(np.linalg.slogdet(cov)[1])
        d = z[0] - m.means[k]
        u = m.inverse_factors[k] @ d
        assert u @ u == pytest.approx(d @ np.linalg.inv(cov) @ d)
    assert ((m.scores(x) > 0.5) == y).mean() > 0.8


def test_languages(spark, tables):
    docs, _, rows = tables
    out = {r["doc_id"]: r for r in langid.predict(docs, langid.train(docs)).collect()}
    truth = {r[0]: r[2] for r in rows}
    own = [r["lang_pred"] == truth[i] for i, r in out.items() if i in truth and r["held_out"]]
    assert sum(own) >= 0.95 * len(own)
    assert all(out[i]["lang_pred"] == "und" and out[i]["score"] == 0 for i in (900, 901, 902))
    assert langid.predict(docs.filter("false"), langid.train(docs)).count() == 0
    none = langid.train(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in langid.predict(docs, none).collect()} == {"und"}
    kept = langid.keep(docs, langid.train(docs))
    assert kept.columns == docs.columns and kept.filter("doc_id in (900, 901, 902)").count() == 0


def test_naive_bayes_against_plain_sums():
    s = next(textbuf.slices(pa.array(["Ab c", "", "b"])))
    bucket, doc, letters = langid.grams(s)
    assert letters.tolist() == [3, 0, 1]
    model = langid.NaiveBayes(["x", "y"], np.log(np.random.default_rng(0).dirichlet(np.ones(langid.BUCKETS), 2)).astype(np.float32), np.log([0.5, 0.5]))
    names, score = model.predict(s)
    own = model.log_prob[:, bucket[doc == 0]].astype(float).sum(1)
    p = np.exp(own - own.max())
    assert names[0] == model.langs[int(np.argmax(own))] and score[0] == pytest.approx(float((p / p.sum()).max()), rel=1e-5)


def test_word_hashes_do_not_depend_on_the_place():
    a = textbuf.words(next(textbuf.slices(pa.array(["x Foo bar", "foo"]))), textbuf.NON_SPACE)
    assert a.hash[1] == a.hash[3] and a.doc.tolist() == [0, 0, 0, 1]
    glued = textbuf.words(next(textbuf.slices(pa.array(["ab", "cd", None, ""]))), textbuf.NON_SPACE)
    assert glued.n == 2 and glued.doc.tolist() == [0, 1]


def test_long_texts_and_labels_without_documents_leave_room_for_the_others(spark):
    ids = list(range(400))
    order = [r["doc_id"] for r in spark.createDataFrame([(i,) for i in ids], "doc_id long").orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").collect()]
    free = [i for i in order if crc32_text(i) % 4 != 2]
    sizes = {i: 10 for i in ids} | {free[0]: 5_000, free[1]: 900, free[2]: 400}
    docs = spark.createDataFrame([(i, "x" * n) for i, n in sizes.items()], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids] + [(i, 1) for i in range(1000, 9000)], "doc_id long, quality int")
    got = [i for i, _ in labelled.sample_ids(docs, labels, "quality", 4, 2, 50, 1_000)]
    assert got == free[2:52]
    all_long = [i for i, _ in labelled.sample_ids(docs.filter(F.length("text") > 10), labels, "quality", 4, 2, 50, 1_000)]
    assert all_long == free[2:3]
    assert [i for i, _ in labelled.sample_ids(docs.filter(F.col("doc_id") == free[1]), labels, "quality", 4, 2, 50, 1_000)] == free[1:2]


def test_a_rare_language_is_told_by_its_full_evidence():
    s = next(textbuf.slices(pa.array(["ab " * 400, "ab"])))
    table = np.full((2, langid.BUCKETS), -10.0, np.float32)
    table[1] += 0.05  # the rare language is a little likelier at each n-gram
    names, score = langid.NaiveBayes(["big", "rare"], table, np.log([0.999, 0.001])).predict(s)
    assert names == ["rare", "big"] and 0.5 <= score[0] <= 1


def test_more_languages_than_a_matrix_holds(spark, tables, monkeypatch):
    docs = tables[0]
    whole = langid.train(docs)
    want = sorted(langid.predict(docs, whole).collect(), key=str)
    kept = sorted(map(str, langid.keep(docs, whole).collect()))
    monkeypatch.setattr(langid, "MAX_LANGS", 1)
    model = langid.train(docs)
    assert len(model.langs) == 1 and len(list(model.more())) == 2
    got = sorted(langid.predict(docs, model).collect(), key=str)
    assert [(r["doc_id"], r["lang_pred"]) for r in got] == [(r["doc_id"], r["lang_pred"]) for r in want]
    assert [r["score"] for r in got] == pytest.approx([r["score"] for r in want])
    assert sorted(map(str, langid.keep(docs, model).collect())) == kept


def test_toxicity_learns_from_rows_beyond_any_sample(spark):
    ids = spark.range(12_000).select(F.col("id").alias("doc_id"), F.crc32(F.col("id").cast("string").cast("binary")).alias("crc"))
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id"))
    own = ids.filter("crc % 4 <> 2").withColumn("late", place > 8_000)
    words = F.concat_ws(" ", *(F.concat(F.lit("w"), F.col("doc_id") % m) for m in (50, 37, 11)))
    toxic = F.col("doc_id") % 4 == 0
    rows = own.select("doc_id", F.when(F.col("late"), "xx").otherwise("en").alias("lang"), F.concat_ws(" ", words, F.when(toxic, F.when(F.col("late"), "vile").otherwise("awful"))).alias("text"), toxic.cast("int").alias("toxic")).cache()
    assert rows.filter("lang = 'xx'").count() > 500
    net = toxicity.train(rows, rows.select("doc_id", "toxic"))
    asked = spark.createDataFrame([(1, "w1 vile w2", "xx"), (2, "w1 w2 w3", "xx"), (3, "w1 awful w2", "en")], "doc_id long, text string, lang string")
    assert [r["predicted"] for r in toxicity.score(asked, net).orderBy("doc_id").collect()] == [1, 0, 1]
    assert set(net.thresholds) == {"en", "xx"}
    rows.unpersist()


def test_toxicity_counts_every_training_row(tables):
    docs, labels, _ = tables
    rows = toxicity.training_rows(docs, labels, "toxic", 4, 2)
    total, held = toxicity.class_counts(rows)
    known = labels.filter("doc_id is not null and toxic is not null").select("doc_id", "toxic")
    want = [(r["doc_id"], r["text"], r["toxic"]) for r in docs.join(known, "doc_id").collect() if crc32_text(r["doc_id"]) % 4 != 2]
    assert total.tolist() == [sum(t == k for _, _, t in want) for k in (0, 1)]
    bucket = toxicity.word_ids(next(textbuf.slices(pa.array(["vile"]))))[0][0]
    assert held[:, bucket].tolist() == [sum(t == k and "vile" in x.lower().replace("!", "").split() for _, x, t in want) for k in (0, 1)]


def test_toxicity_of_many_shards_is_the_same_for_any_partitions(tables, monkeypatch):
    docs, labels, rows = tables
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 40)
    assert toxicity.training_rows(docs, labels, "toxic", 4, 2).select("shard").distinct().count() == 5
    scores = []
    for parts in (1, 7):
        out = toxicity.score(docs, toxicity.train(docs.repartition(parts), labels)).filter("doc_id is not null").orderBy("doc_id", "score").collect()
        scores.append([r["score"] for r in out])
    assert scores[0] == pytest.approx(scores[1], abs=1e-6)
    truth = {r[0]: r[4] for r in rows}
    own = [(r["predicted"], truth[r["doc_id"]]) for r in out if r["held_out"] and r["doc_id"] in truth]
    assert sum(a == b for a, b in own) >= 0.9 * len(own)


def test_toxicity_gradient_against_differences(monkeypatch):
    rng = np.random.default_rng(3)
    learner = toxicity.Learner(toxicity.ConvNet.start(rng))
    net = learner.net
    for t in net.tables:
        t[1:60] = rng.normal(size=(59, toxicity.DIM))
    counts, y = np.array([4, 0, 30, 1]), np.array([1, 0, 0, 1], np.float32)
    (a, begin), (b, _) = (toxicity.padded(rng.integers(1, 60, counts.sum()).astype(np.int32), counts) for _ in range(2))
    monkeypatch.setattr(toxicity, "BLOCK_WORDS", 9)

    def loss():
        top = np.stack([r[begin[i] : begin[i + 1]].max(axis=0) for r in [net.responses(a, b)[1]] for i in range(4)])
        z = np.maximum(top, 0).astype(float) @ net.out + net.out_bias
        decay = sum((x.astype(float) ** 2).sum() for x in (*net.kernels.values(), net.out))
        return float((np.log1p(np.exp(z)) - y * z).mean() + 0.5e-4 * decay)

    dense, by, at = learner.gradient(a, b, begin, y)
    v = learner.weights()
    for i in rng.choice(len(v), 40, replace=False):
        ends = []
        for d in (1e-2, -1e-2):
            w = v.copy()
            w[i] += d
            learner.set_weights(w)
            ends.append(loss())
        learner.set_weights(v)
        assert dense[i] == pytest.approx((ends[0] - ends[1]) / 2e-2, abs=2e-3)
    word = a[begin[2] + 1]
    own = by[a[at] == word].sum(axis=0)
    for k in range(toxicity.DIM):
        net.tables[0][word, k] += 1e-2
        up = loss()
        net.tables[0][word, k] -= 2e-2
        down = loss()
        net.tables[0][word, k] += 1e-2
        assert own[k] == pytest.approx((up - down) / 2e-2, abs=2e-3)


def test_filter_before_the_join_loses_no_labelled_row(spark, monkeypatch):
    ids = spark.range(-500, 3_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    known = ids.filter("doc_id % 3 = 0").select("doc_id", F.lit(1).alias("y"))
    got = {r["doc_id"] for r in labelled.may_be_known(ids, known).collect()}
    want = {r["doc_id"] for r in known.collect()}
    assert want <= got and len(got) < 1.1 * len(want)
    monkeypatch.setattr(labelled, "FILTER_BITS", 64)  # full: it leaves all
    assert labelled.may_be_known(ids, known).count() == ids.count()
    assert labelled.may_be_known(ids, known.filter("false")).count() == 0
