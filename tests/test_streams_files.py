import hashlib
import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lorekeep.sources import files
from lorekeep.streaming import cursors, flows

ACTIONS = [
    ("s", 1, "Bash", "make", "Traceback in app.py"), ("s", 2, "Edit", "src/app.py", "ok"), ("s", 3, "Bash", "pytest test_x", "1 failed"), ("s", 4, "Bash", "pytest test_x", "3 passed"),
    ("s", 5, "Bash", "ls", "x"), ("t", 1, "Edit", "a.py", "ok"), ("t", 2, "End", "", ""),
]
SCHEMA = "session string, seq long, tool string, target string, response string"
WANT = [("s", 2, "error_fix", "src/app.py"), ("s", 4, "test_pass", "pytest test_x"), ("s", 5, "edit_group", "src/app.py"), ("t", 2, "edit_group", "a.py")]


def _events(rows):
    return sorted((r["session"], r["seq"], r["kind"], r["target"]) for r in rows)


def test_actions_in_batch(spark):
    assert _events(flows.action_events(spark.createDataFrame(ACTIONS, SCHEMA)).collect()) == sorted(WANT)


def test_actions_as_a_stream(spark, tmp_path):
    df = spark.createDataFrame(ACTIONS, SCHEMA)
    for i in (1, 2):
        df.filter((F.col("seq") > 3) == (i == 2)).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = flows.action_events(stream).writeStream.format("memory").queryName("acts").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert len(spark.table("acts").collect()) >= 3


def test_streamed_feedback_comes_once(spark, tmp_path):
    rows = [(i, datetime(2024, 1, 1) + timedelta(minutes=i), f"k{i % 3}") for i in range(9)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, key string").coalesce(1).write.json(str(tmp_path / "in"))
    s = spark.readStream.schema("event_id long, ts timestamp, key string").json(str(tmp_path / "in"))
    q = flows.unique_feedback(s).writeStream.format("memory").queryName("fb").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["key"] for r in spark.table("fb").collect()) == ["k0", "k1", "k2"]


def test_feedback_without_a_key_passes(spark):
    rows = [(1, datetime(2024, 1, 1), "a"), (2, datetime(2024, 1, 1), "a"), (3, datetime(2024, 1, 1), None), (4, datetime(2024, 1, 1), None)]
    got = flows.unique_feedback(spark.createDataFrame(rows, "event_id long, ts timestamp, key string")).collect()
    assert sorted(r["key"] or "" for r in got) == ["", "", "a"]


def test_spool_gauges_of_an_empty_spool(spark):
    empty = spark.createDataFrame([], "source string, memory_source string, queued_at timestamp")
    assert tuple(flows.spool_metrics(empty, F.lit(datetime(2024, 1, 1))).first()) == (0, 0) and flows.spool_sources(empty).count() == 0


def test_jobs_fail_the_fifth_time(spark):
    t = datetime(2024, 1, 1)
    jobs = spark.createDataFrame([(1, t, "pending", 3), (2, t, "pending", 4), (3, t, "pending", 0), (4, t, "done", 0)], "id long, created_at timestamp_ntz, status string, attempts int")
    out = spark.createDataFrame([(1, False), (2, False), (3, True)], "id long, ok boolean")
    assert sorted((r["id"], r["status"], r["attempts"]) for r in flows.job_step(jobs, out).collect()) == [(1, "pending", 4), (2, "failed", 5), (3, "done", 0), (4, "done", 0)]


def test_rate_limit_window_starts_with_the_first_request(spark):
    t = datetime(2024, 1, 1, 0, 0, 50)
    rows = [("c", t + timedelta(seconds=s), i) for i, s in enumerate((0, 5, 20, 59, 60, 61))]
    got = flows.rate_limited(spark.createDataFrame(rows, "client string, ts timestamp_ntz, id long"), limit=2).orderBy("id").collect()
    assert [r["allowed"] for r in got] == [True, True, False, False, True, True]


def test_spool_ends_after_eight_attempts(spark):
    now = datetime(2024, 2, 1)
    rows = [(1, "a", 6, now), (2, "b", 7, now), (3, "c", 0, now - timedelta(days=15)), (4, "d", 0, now), (5, "a", 0, now)]
    spool = spark.createDataFrame(rows, "id long, key string, attempts int, queued_at timestamp")
    live, dead = flows.spool_pass(spool, spark.createDataFrame([("d",)], "key string"), F.lit(now))
    assert sorted(r["id"] for r in live.collect()) == [1, 5] and sorted(r["id"] for r in dead.collect()) == [2, 3]


def test_sessions(spark, tmp_path):
    s = {"session_id": "s1", "project": "p", "cwd": "/", "ended_at": "2024-01-01T00:00:00Z", "messages": [
        {"type": "user", "message": {"role": "user", "content": "hello"}}, {"role": "assistant", "content": [{"type": "text", "text": "a"}, {"type": "tool", "text": "no"}, {"type": "text", "text": "b"}]}]}
    (tmp_path / "a.json").write_text(json.dumps(s))
    (tmp_path / "b.json").write_text(json.dumps({k: v for k, v in s.items() if k != "cwd"}))
    rows = files.read_sessions(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r["session_id"], r["role"], r["text"]) for r in rows] == [("s1", "user", "hello"), ("s1", "assistant", "a b")]


def test_migration_counts_bad_lines(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"id":"1","content":"a","metadata":{"salience":"0.7"}}\nnot json\n{"id":"1","content":"b","metadata":{"salience":0.2}}\n{"content":"x"}\n')
    good, bad = files.read_migration(spark, str(tmp_path / "m.jsonl"))
    assert [(r["id"], r["content"], r["salience"]) for r in good.collect()] == [("1", "b", 0.2)]
    assert sorted((r["number"], r["line"]) for r in bad.collect()) == [(2, "not json"), (4, '{"content":"x"}')]


def test_lines_are_numbered_across_blocks(spark, tmp_path):
    rows = [f"{i} " + "x" * (i % 50) for i in range(3000)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("\n".join(rows))
    (tmp_path / "in/b.txt").write_text("one\n\nthree\n")
    (tmp_path / "in/c.txt").write_text("")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        df = files.numbered_lines(spark, str(tmp_path / "in"))
        got = {(r["path"].rsplit("/", 1)[-1], r["line"]): r["value"] for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {**{("a.txt", i + 1): v for i, v in enumerate(rows)}, ("b.txt", 1): "one", ("b.txt", 2): "", ("b.txt", 3): "three"}


@pytest.mark.parametrize(("line", "what"), [("{", "no JSON"), ('{"query": "q"}', "no query or ids"), ('{"gold_ids": ["1"]}', "no query or ids")])
def test_gold_errors_name_the_line(spark, tmp_path, line, what):
    good = '{"query": "q", "gold_ids": ["1", "2"], "k": 5}\n\n{"query": "r", "gold_memory_id": "3"}\n'
    (tmp_path / "g.jsonl").write_text(good)
    assert sorted(tuple(r) for r in files.read_gold(spark, str(tmp_path / "g.jsonl")).collect()) == [("q", "1", 5), ("q", "2", 5), ("r", "3", 10)]
    (tmp_path / "g.jsonl").write_text(good + line + "\n")
    with pytest.raises(Exception, match=f"g.jsonl, line 4: {what}"):
        files.read_gold(spark, str(tmp_path / "g.jsonl")).collect()


def test_spool_keys_are_those_of_sorted_json(spark):
    payloads = [{"b": [1, 2.50, 1e22, None, True], "a": {"z": "é\U0001f600\x7f\n\"/", "y": -0.0}}, {}, {"k": "a:b, c"}, {"n": 12345678901234567890}]
    texts = [json.dumps(p, ensure_ascii=i % 2 == 0, separators=((",", ":") if i % 2 else (" ,  ", ":"))) for i, p in enumerate(payloads)] + ['{"a": {"y": -0.0, "z": "é\U0001f600\x7f\\n\\"/"}, "b": [1, 2.50, 1e22, null, true]}']
    want = [hashlib.sha256(json.dumps(p, sort_keys=True, ensure_ascii=True).encode()).hexdigest() for p in [*payloads, payloads[0]]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, "no json", None])], "i int, t string")
    assert [r["k"] for r in df.select("i", flows.spool_key(F.col("t")).alias("k")).orderBy("i").collect()] == [*want, None, None]


def test_cursor_goes_on_after_a_restart(spark, tmp_path):
    t = datetime(2024, 1, 1)
    events = spark.createDataFrame([(1, t), (2, t), (3, t + timedelta(hours=1))], "event_id long, ts timestamp_ntz")
    path = f"file://{tmp_path}/cursor"
    first = cursors.Cursor(spark, path)
    rows = first.behind(events.filter("event_id < 3")).limit(1)
    assert [r["event_id"] for r in rows.collect()] == [1] and first.at() is None
    first.commit(rows)
    again = cursors.Cursor(spark, path)
    left = again.behind(events)
    assert [r["event_id"] for r in left.collect()] == [2, 3]
    spark.range(1).write.parquet(f"{path}/step=1/_temporary/x")  # a step that broke off
    assert again.at()["event_id"] == 1
    again.commit(left)
    again.commit(left.limit(0))
    assert cursors.Cursor(spark, path).behind(events).count() == 0


def test_every_nth_counts_across_restarts(spark, tmp_path):
    calls = []
    path = f"file://{tmp_path}/counts"
    for epoch, rows in enumerate((3, 1, 2, 9, 0)):
        cursors.every_nth(4, lambda b, e: calls.append((e, b.count())), path)(spark.range(rows), epoch)
    cursors.every_nth(4, lambda b, e: calls.append((e, -1)), path)(spark.range(1), 1)  # Spark repeats a batch
    assert calls == [(1, 1), (3, 9)]


def test_vault_code_and_bubbles(spark, tmp_path):
    (tmp_path / "v/notes").mkdir(parents=True)
    (tmp_path / "v/.git").mkdir()
    (tmp_path / "v/notes/a.md").write_text("# A")
    (tmp_path / "v/.git/b.md").write_text("# B")
    (tmp_path / "v/x.py").write_text("class Q:\n    def run(self): pass\ndef main(): pass\n")
    assert [(r["folder"], r["stem"]) for r in files.read_vault(spark, str(tmp_path / "v")).collect()] == [("notes", "a")]
    assert files.read_code(spark, str(tmp_path / "v")).first()["symbols"] == ["sym:Q", "sym:main", "sym:run"]
    kv = spark.createDataFrame([("bubbleId:c1:1", '{"type":1,"text":"q"}'), ("bubbleId:c1:2", '{"type":2,"text":"a"}'), ("bubbleId:c2:1", '{"type":1,"text":"q"}'), ("other", "{}")], "key string, value string")
    assert [tuple(r) for r in files.key_value_bubbles(kv).collect()] == [("c1", 2, "User: q\n\nAssistant: a")]


@pytest.mark.parametrize(
    ("ending", "code", "names"),
    [
        ("py", 'class Q:\n    """def doc(): it\'s"""\n    async def run(self): return "def no(): pass"  # def nor(this)\n\nx = \'\'\'class Z:\n\'\'\'\ndef été(a="\\"", b=1): pass\nself.def_x = 1\n', ["Q", "run", "été"]),
        ("rs", "pub fn hello<T>(a: [u8; 4]) -> T where T: X {} trait A { fn only(&self); fn full(&self) { let f: fn(u8) = g; } }\n/* fn no() {} */ // fn nor() {}\nlet s = r#\"fn raw() { \" }\"#; let c = '\"'; fn last<'a>(x: &'a str) {}", ["full", "hello", "last"]),
        ("ts", "export default async function main() {}\nfunction over(a: string): void;\nfunction over(a: any) { }\nconst f = function inner() {};\n`function t() {`; 'function u() {'; // function v() {}\n  function $x() {", ["main", "over"]),
        ("tsx", "function View() { return <p>don\u2019t</p> }", ["View"]), ("txt", "def a(): pass", []), ("py", "", []), ("py", '"' + "a" * 100_000 + '"\ndef z(): pass', ["z"]),
    ],
)
def test_symbols_of_code(spark, ending, code, names):
    got = spark.createDataFrame([(code, ending)], "c string, e string").select(files.symbols(F.col("c"), F.col("e")).alias("s")).first()["s"]
    assert got == [f"sym:{n}" for n in names]
