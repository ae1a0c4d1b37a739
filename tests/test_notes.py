from pyspark.sql import functions as F

from lorekeep.operators import notes

REC = "id long, type string, project string, source string, importance double, ts string, tags string, content string"


def _records(spark):
    rows = [(i, "error_lesson" if i % 2 else "fact", "p", "s", i / 100, "t", "a, b," if i == 1 else None, c) for i, c in enumerate(["Title: one\nbody", 'title ONE', "  ", None, "x" * 70, "untitled", "Untitled 2", "a$b \\ c"] + [f"n{k}" for k in range(24)])]
    return spark.createDataFrame(rows, REC)


def test_names_are_unique(spark):
    got = {r["id"]: r["name"] for r in notes.note_names(_records(spark)).collect()}
    assert (got[0], got[1], got[2], got[3], got[4], got[5], got[6], got[7]) == ("Title one", "title ONE 2", "untitled", "untitled 2 3", "x" * 60, "untitled 3", "Untitled 2", "a$b c")
    assert len({n.lower() for n in got.values()}) == len(got)


def test_note_texts_and_index(spark):
    r = _records(spark)
    names = notes.note_names(r)
    near = spark.createDataFrame([(1, 7, 2), (1, 4, 1), (1, 999, 3)], "query long, id long, rank int")
    got = {x["id"]: (x["path"], x["text"]) for x in notes.notes(r, names, notes.links_of(near, r, names)).collect()}
    assert got[1] == ("error_lesson/title ONE 2.md", f"---\nid: 1\ntype: error_lesson\nproject: p\nsource: s\nimportance: 0.01\ntimestamp: t\ntags:\n  - a\n  - b\n---\n\ntitle ONE\n\n## Related\n- [[fact/{'x' * 60}]]\n- [[error_lesson/a$b c]]\n")
    assert got[3][1].endswith("tags:\n  []\n---\n\n\n")
    index = {x["type"]: x["text"] for x in notes.index(r, names).collect()}
    assert index["error_lesson"].startswith("## Error Lesson (16)\n\n- [[error_lesson/n23]]\n") and index["error_lesson"].endswith("\n- *(+6 more in `error_lesson/`)*")


def test_a_block_is_replaced_as_a_whole(spark):
    rows = [("text",), ("text\n\n",), ("a\n<!-- links -->\nold $1\n<!-- /links -->\nb",), ("",), (None,)]
    df = spark.createDataFrame(rows, "t string").withColumn("l", F.array(F.lit("fact/a$1\\b"), F.lit("c")))
    once = df.withColumn("t", notes.with_block(F.col("t"), F.col("l")))
    block = "<!-- links -->\n## Related\n- [[fact/a$1\\b]]\n- [[c]]\n<!-- /links -->"
    assert [r["t"] for r in once.collect()] == [f"text\n\n\n{block}\n", f"text\n{block}\n", f"a\n{block}\nb", f"\n\n\n{block}\n", None]
    assert once.withColumn("t", notes.with_block(F.col("t"), F.col("l"))).collect() == once.collect()
