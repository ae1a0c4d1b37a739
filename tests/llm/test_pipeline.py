import tracemalloc

import numpy as np
import pyarrow as pa

import corpus_pipeline
from lorekeep.llm import jaccard, langid, textbuf
from lorekeep.llm.session import small_table

BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def _peak(f) -> float:
    """MB that f takes at most, numpy's arrays included."""
    tracemalloc.start()
    try:
        f()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def _column(rng) -> pa.Array:
    words = np.array(["".join(map(chr, rng.integers(97, 123, n))) for n in rng.integers(2, 9, 5_000)])
    return pa.array([" ".join(rng.choice(words, 400)) for _ in range(1_000)])


def test_small_table_needs_no_python_worker(spark, capsys):
    t = small_table(spark, [("fr", 0, 1 << 62), ("de", 1, 3)], "lang string, j int, cut long")
    assert [tuple(r) for r in t.collect()] == [("fr", 0, 1 << 62), ("de", 1, 3)]
    assert t.dtypes == [("lang", "string"), ("j", "int"), ("cut", "bigint")]
    empty = small_table(spark, [], "a long, b long")
    assert empty.collect() == [] and empty.dtypes == [("a", "bigint"), ("b", "bigint")]
    capsys.readouterr()
    t.explain()
    assert "LocalTableScan" in (plan := capsys.readouterr().out) and "RDD" not in plan


def test_every_stage_takes_small_batches(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h", "en"), (2, None, None)], "doc_id long, text string, lang string")
    before = spark.conf.get(BYTES, None)
    try:
        for name, stage in corpus_pipeline.STAGES:
            spark.conf.set(BYTES, str(64 << 20))
            try:
                stage(spark, docs, "/there/is/no/such/folder")
            except Exception:  # stages that read a table: the bound comes first
                assert name in ("quality", "decontamination")
            assert int(spark.conf.get(BYTES)) <= 2 << 20, name
    finally:
        spark.conf.unset(BYTES) if before is None else spark.conf.set(BYTES, before)


def test_memory_of_a_language_batch_is_bounded():
    rng = np.random.default_rng(5)
    column = _column(rng)
    model = langid.NaiveBayes(["de", "en", "fr"], rng.random((3, langid.BUCKETS)).astype(np.float32), np.zeros(3))
    langid._fold_table()
    told = []
    assert _peak(lambda: [told.extend(model.predict(s)[0]) for s in textbuf.slices(column, langid.SLICE_BYTES)]) < 20
    assert told == [x for s in textbuf.slices(column, 1 << 30) for x in model.predict(s)[0]]


def test_memory_of_a_shingle_batch_is_bounded():
    column = _column(np.random.default_rng(6))
    keys = []
    for k in range(2):
        textbuf._POWERS[k] = np.ones(1, np.uint64)
    assert _peak(lambda: [keys.append(jaccard.class_key(t)) for s in textbuf.slices(column, jaccard.SLICE_BYTES) for t in jaccard.shingle_sets(s, 5)]) < 30
    assert keys == [jaccard.class_key(t) for s in textbuf.slices(column, 1 << 30) for t in jaccard.shingle_sets(s, 5)]


def test_powers_are_no_longer_than_needed():
    for k in range(2):
        textbuf._POWERS[k] = np.ones(1, np.uint64)
    power, inverse = textbuf._powers((1 << 20) + 1)
    assert len(textbuf._POWERS[0]) < 1.1 * (1 << 20) and np.all(power * inverse == 1)
    assert np.array_equal(textbuf._powers(3)[0], power[:3])
