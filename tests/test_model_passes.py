import json

from pyspark.sql import functions as F

from lorekeep.functions.embed import HashEmbedder
from lorekeep.operators import model_passes as mp


def test_transcripts_are_cut(spark):
    rows = [("s", i, "user" if i % 2 else None, "x" * 700 if i == 3 else f"m{i}") for i in range(50)] + [("t", 0, "user", None)]
    got = {r["session"]: r["text"] for r in mp.transcripts(spark.createDataFrame(rows, "session string, pos long, role string, text string")).collect()}
    lines = got["s"].split("\n")
    assert len(lines) == 40 and lines[0] == "unknown: m0" and lines[3] == "user: " + "x" * 600 and got["t"] == "user: "


def test_answers_keep_their_shape(spark):
    def one(answer, f):
        return spark.createDataFrame([(answer,)], "a string").select(f(F.col("a")).alias("x")).first()["x"]

    long = json.dumps({"summary": "s" * 500, "decisions": ["d" * 200, "", None, "b", "c", "e"], "extra": 1})
    got = one(f"```json\n{long}\n```", mp.session_summary)
    assert (got["summary"], got["decisions"], got["next_steps"]) == ("s" * 400, ["d" * 160, "b", "c"], [])
    assert one("no json", mp.session_summary) is None and one(None, mp.session_summary) is None
    items = one('Here: [{"error": "' + "e" * 300 + '", "n": 4}, "plain", {"a": "b"}, {"c": "d"}]', lambda c: mp.capped_items(c, 3, 200))
    assert items == [{"error": "e" * 200, "n": "4"}, {"text": "plain"}, {"a": "b"}]
    assert one("nothing", lambda c: mp.capped_items(c, 3, 200)) == [] and one(None, lambda c: mp.capped_items(c, 3, 200)) == []
    assert [one(t, mp.plain_title) for t in (' "A title" ', "''", "x" * 150, None)] == ["A title", None, "x" * 100, None]
    assert one("a", lambda c: mp.numbered(F.array(c, F.lit("y" * 2001)))) == "[0] a\n\n[1] " + "y" * 2000 + "…"


def _flaky(folder):
    def client(prompts):
        import os

        out = []
        for p in prompts:
            path = os.path.join(folder, p)
            n = len(os.listdir(folder)) and (open(path).read().count("x") if os.path.exists(path) else 0)
            with open(path, "a") as f:
                f.write("x")
            if p.startswith("never") or (p.startswith("third") and n < 2):
                raise RuntimeError("busy")
            out.append(p.upper())
        return out

    return client


def test_a_pass_goes_on_where_it_ended(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    items = spark.createDataFrame([(1, "one"), (2, "third"), (3, "never"), (4, "four"), (5, None), (6, "six")], "id long, prompt string").coalesce(1)
    p = mp.Pass(spark, f"file://{tmp_path}/done", _flaky(str(tmp_path / "calls")), budget=3, retries=2)
    assert sorted(tuple(r) for r in p.run(items).collect()) == [(1, "ONE"), (2, "THIRD")]
    assert [tuple(r) for r in p.failures().collect()] == [(3, 1)]
    spark.range(1).write.parquet(f"file://{tmp_path}/done/run=1/_temporary/x")  # a run that broke off
    again = mp.Pass(spark, f"file://{tmp_path}/done", _flaky(str(tmp_path / "calls")), budget=0, retries=0)
    assert sorted(r["id"] for r in again.run(items).collect()) == [1, 2, 4, 6]
    asked = {f.name: len(f.read_text()) for f in (tmp_path / "calls").iterdir()}
    assert asked["one"] <= 2 and asked["never"] >= 4 and asked["six"] <= 2
    count = dict(asked)
    assert again.run(items).count() == 4
    assert {f.name: len(f.read_text()) for f in (tmp_path / "calls").iterdir() if f.name != "never"} == {k: v for k, v in count.items() if k != "never"}


def test_retitled_vectors(spark):
    memories = spark.createDataFrame([(1, "text"), (2, None), (3, "x"), (4, "y")], "id long, content string")
    answers = spark.createDataFrame([(1, '"New title"'), (2, "Other"), (3, " ")], "id long, answer string")
    got = {r["id"]: (r["title"], r["vector"]) for r in mp.retitled(memories, answers, HashEmbedder(8)).collect()}
    assert got == {1: ("New title", HashEmbedder(8).embed(["New title\n\ntext"])[0].tolist()), 2: ("Other", HashEmbedder(8).embed(["Other\n\n"])[0].tolist())}
    assert mp.retitled(memories, answers, HashEmbedder(8), dim=9).count() == 0
