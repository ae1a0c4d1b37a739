import random
from datetime import datetime

import numpy as np
from pyspark.sql import functions as F

from lorekeep.streaming.saves import BATCH_ITEMS, RecordStore

ITEM = "pos long, content string, title string, type string, project string, session_id string, ts timestamp_ntz, salience double, vector array<double>"
T = datetime(2024, 1, 1)


def _item(pos, v, content="text", type_="fact", project="p"):
    return (pos, content, None, type_, project, "", T, None, v)


def _brute(batches, limit):
    """Outcomes of each batch: the nearest among stored records and earlier items of the batch."""
    stock, out = [], []
    for number, items in enumerate(batches):
        new, done, to = [], {}, {}
        for it in sorted(items):
            pos, content, type_, project, v = it[0], it[1], it[3], it[4], it[8]
            if not (content or "").replace("<private>x</private>", "").strip() or project is None:
                done[pos] = (None, False)
                continue
            seen = [(-float(np.dot(v, w)), 0, i, t, p) for i, t, p, w in stock if v is not None and len(w) == len(v)]
            seen += [(-float(np.dot(v, x[8])), 1, x[0], x[3], x[4]) for x in new if v is not None and x[8] is not None and len(x[8]) == len(v)]
            best = min(seen, default=None)
            if best and -best[0] > 1 - limit and (best[3], best[4]) == (type_, project):
                done[pos] = (best[2] if best[1] == 0 else done[best[2]][0], False)
            else:
                done[pos] = (number * BATCH_ITEMS + pos, True)
            new.append(it)
        stock += [(number * BATCH_ITEMS + x[0], x[3], x[4], x[8]) for x in new if done[x[0]][1] and x[8] is not None]
        out.append(done)
    return out


def test_save_guards_and_tells_every_item(spark, tmp_path):
    rng = random.Random(1)
    base = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.6, 0.8, 0.0], [0.0, 0.6, 0.8]]
    near = [0.998, 0.0632, 0.0]
    vectors = [*base, near, [0.9798, 0.2, 0.0], None, [1.0]]
    batches = [[_item(k, rng.choice(vectors), rng.choice(["text", "text", " ", "<private>x</private>"]), rng.choice(["fact", "note"]), rng.choice(["p", "p", "q", None])) for k in range(25)] for _ in range(3)]
    store = RecordStore(spark, f"file://{tmp_path}/store", max_distance=0.05)
    want = _brute(batches, 0.05)
    for number, items in enumerate(batches):
        got = {r["pos"]: (r["id"], r["saved"]) for r in store.save(spark.createDataFrame(items, ITEM).withColumn("error", F.lit("x")).withColumn("near", F.lit(1)), number).collect()}
        assert got == want[number]
    assert sorted(r["id"] for r in store.records().collect()) == sorted(i for d in want for i, saved in d.values() if saved)
    assert store.events().filter("duplicate").count() == sum(i is not None and not saved for d in want for i, saved in d.values()) > 0


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    store = RecordStore(spark, f"file://{tmp_path}/store")
    first = store.save(spark.createDataFrame([_item(0, [1.0, 0.0]), _item(1, [0.0, 1.0])], ITEM), 7)
    want = sorted(map(tuple, first.collect()))
    again = store.save(spark.createDataFrame([_item(0, [0.5, 0.5], "other"), _item(9, [0.1, 0.2])], ITEM), 7)
    assert sorted(map(tuple, again.collect())) == want and store.records().count() == 2
    assert store.save(spark.createDataFrame([], ITEM), 8).count() == 0


def test_a_batch_that_broke_off_is_not_seen(spark, tmp_path):
    store = RecordStore(spark, f"file://{tmp_path}/store")
    store.save(spark.createDataFrame([_item(0, [1.0, 0.0])], ITEM), 0)
    store.records().drop("batch").limit(1).write.parquet(f"file://{tmp_path}/store/records/batch=1")
    assert store.records().count() == 1
    assert [(r["pos"], r["saved"]) for r in store.save(spark.createDataFrame([_item(3, [0.0, 1.0])], ITEM), 1).collect()] == [(3, True)]
    assert store.records().count() == 2


def test_the_sink_reflects_across_restarts(spark, tmp_path):
    calls = []
    schema = "pos long, content string, title string, type string, project string, session_id string, ts timestamp, salience double, vector array<double>"
    rows = [[_item(10 * b + k, [float(b == i or k == i) for i in range(4)] + [float(b), float(k)], f"text {b} {k}") for k in range(3)] for b in range(4)]

    def run(b):
        spark.createDataFrame(rows[b], schema).coalesce(1).write.parquet(f"{tmp_path}/in/f{b}")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        store = RecordStore(spark, f"file://{tmp_path}/store", max_distance=-9.0, every=5, reflect=lambda s, b: calls.append((b, s.records().count())))
        q = stream.writeStream.foreachBatch(store.sink()).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination(300)
        return store

    run(0)
    assert calls == []
    store = run(1)
    assert calls == [(1, 6)]
    store.sink()(spark.createDataFrame(rows[1], ITEM), 1)
    assert calls == [(1, 6)] and store.records().count() == 6
