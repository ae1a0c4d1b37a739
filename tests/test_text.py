import pytest
from pyspark.sql import functions as F

from lorekeep.functions import chunk, text
from lorekeep.functions.embed import HashEmbedder, backfill


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_private_spans_go(spark):
    s = "keep this <private>API_KEY=sk-abc</private> keep this too <PRIVATE>a\nb</private>!"
    assert one(spark, text.strip_private(F.col("s")), s=s) == "keep this  keep this too !"


@pytest.mark.parametrize(
    ("content", "session", "title"),
    [
        ("[My Doc] intro\n\nbody", None, "My Doc"),
        ("[user] fix the CORS middleware on staging", None, "user: fix the CORS middleware on staging"),
        ("[user] short", None, "user"),
        ("Only one line here", None, "Only one line here"),
        ("  ", "sid-abc", "session sid-abc"),
        (None, None, "Untitled memory"),
        ("[] rest\nmore", None, "[] rest"),
        ("x" * 130, None, "x" * 120),
    ],
)
def test_titles(spark, content, session, title):
    df = spark.createDataFrame([(content, session)], "c string, s string")
    assert df.select(text.derive_title(F.col("c"), F.col("s"))).first()[0] == title


def test_entities_are_cleaned(spark):
    names = ["React", " react ", "git", "x", "--", None, "PostgreSQL"]
    df = spark.createDataFrame([(names,)], "n array<string>")
    assert df.select(text.clean_entities(F.col("n"))).first()[0] == ["React", "PostgreSQL"]
    many = spark.createDataFrame([([f"name{i}" for i in range(20)],)], "n array<string>")
    assert len(many.select(text.clean_entities(F.col("n"))).first()[0]) == 12


def test_types_intents_and_triviality(spark):
    def t(c):
        return one(spark, text.normalize_type(F.col("s")), s=c)

    assert [t(x) for x in ("ErrorLesson", "bug", "insight", "project-context", " ", "fact")] == ["error_lesson", "conversation", "pattern", "project_context", "conversation", "fact"]
    assert one(spark, text.classify_intent(F.col("s")), s="Why is it failing, what did we decide") == "solution"
    assert one(spark, text.classify_intent(F.col("s")), s="nothing") is None
    assert one(spark, text.classify_trivial(F.col("s"), F.lit("reflection")), s="These memories are related to each other") == "reflection_meta"
    assert one(spark, text.classify_trivial(F.col("s"), F.lit("user")), s="short") == "too_short"
    assert one(spark, text.noisy_reflection(F.col("s")), s="As an AI I can't say much about this at all") is True


def test_query_tokens(spark):
    assert one(spark, text.sanitize_query(F.col("s")), s="Re-ranking OR don't é x 42!") == ["Re-ranking", "OR", "don't", "é", "42"]
    assert one(spark, text.index_words(F.col("s")), s="Re-ranking don't É—x a_b 42!") == ["Re", "ranking", "don", "t", "É—x", "a", "b", "42"]
    assert one(spark, text.index_words(F.col("s")), s=None) == [] and one(spark, text.ascii_lower(F.col("s")), s="ÉA") == "Éa"


def test_barrier(spark):
    rows = spark.createDataFrame([(17_000,), (18_000,), (21_500,), (99_000,)], "n long").select(F.round(text.barrier_threshold(F.col("n")), 4)).collect()
    assert [r[0] for r in rows] == [0.0, 0.0, 0.3875, 1.0]


def test_section_chunks(spark):
    c, t = F.col("c"), F.lit("doc")
    body = " ".join(f"w{i}" for i in range(61))

    def got(column, text):
        return [tuple(x) for x in one(spark, column, c=text)]

    assert got(chunk.sections(c, t), f"# One\n{body}\n## Two\nfew\n### Three\n{body}") == [("One", body), ("Three", body)]
    assert got(chunk.sections(c, t), f"{body}\n#none\n#### Four\n# One\nfew") == [("doc", f"{body}\n#none\n#### Four")]
    assert got(chunk.sections(c, t), "short") == [("doc", "short")] and got(chunk.sections(c, t), "") == [("doc", "")]
    four = "\n\n".join([body] * 4)
    assert [x for x, _ in got(chunk.paragraphs(c, t, 100), four)] == ["doc (part 1)", "doc (part 2)"]
    assert got(chunk.paragraphs(c, t, 100), f"{four}\n\n\n tail ") == [("doc (part 1)", f"{body}\n\n{body}"), ("doc (part 2)", f"{body}\n\n{body}")]
    assert one(spark, chunk.undoubled(c), c=" CCoonncclluussiióónn ") == "Conclusión" and one(spark, chunk.undoubled(c), c="little") == "little"
    for title, bad in [("a|b|c", True), ("12.", True), ("Date: x", True), ("IX. FOO", True), ("a ─ b", True), ("A real title", False), ("Dated", False)]:
        assert one(spark, chunk.garbage_title(c), c=title) is bad
    big = "\n\n".join([" ".join(["word"] * 300)] * 4)
    parts = chunk.refined(F.array(F.struct(F.lit(" - Part  one is here:").alias("title"), c.alias("body"))), F.lit("stem"), 800)
    assert [x for x, _ in got(parts, big)] == ["stem — Part one is here (part 1)", "stem — Part one is here (part 2)"]
    assert got(parts, "few words") == [("Part one is here", "few words")] and got(parts, " ") == [("stem", " ")]
    split = "# a\n" + "x" * 50 + "\n# b\n" + "y" * 200
    pieces = one(spark, chunk.heading_split(c, 100), c=split)
    assert "".join(pieces) == split and [len(x) for x in pieces] == [55, 100, 100, 4]
    words = " ".join(["w"] * 1290)
    assert [(x, len(y.split())) for x, y in got(chunk.word_chunks(c, t), words)] == [("doc (part 1)", 600), ("doc (part 2)", 600), ("doc (part 3)", 90)]
    pages = "".join(f"--- page {i} ---\n{body} {body}\n" for i in range(1, 17))
    assert [x for x, _ in got(chunk.page_chunks(c, t), pages)] == ["doc (pages 1-15)", "doc (pages 16-30)"]


def test_chunked_rows(spark):
    rows = [(1, "s", None), (2, None, "few"), (3, "s", " ".join(["w"] * 900))]
    out = chunk.chunked(spark.createDataFrame(rows, "id long, stem string, content string")).collect()
    assert sorted((r["id"], r["pos"], r["title"], r["words"]) for r in out) == [(2, 0, "", 1), (3, 0, "s (part 1)", 900)]


def test_pairs_skip_other_roles(spark):
    rows = [(1, 0, "user", "u" * 30), (1, 1, "system", "s"), (1, 2, "assistant", "a" * 30), (1, 3, "user", "tiny"), (1, 4, "assistant", "x"), (1, 5, "assistant", "y" * 99)]
    got = chunk.pair_chunks(spark.createDataFrame(rows, "session long, pos int, role string, text string")).collect()
    assert [(r["pos"], r["content"]) for r in got] == [(0, "User: " + "u" * 30 + "\n\nAssistant: " + "a" * 30)]


def test_episode_stops_at_first_overflow(spark):
    rows = [(1, i, "user", c * 40) for i, c in enumerate("abc")] + [(1, 9, "user", "<timestamp>" + "z" * 40)]
    df = spark.createDataFrame(rows, "session long, pos int, role string, text string")
    r = chunk.episode_text(df, most=100).first()
    assert r["n_parts"] == 2 and r["text"] == "User: " + "a" * 40 + "\n\nUser: " + "b" * 40


def test_hash_embedder():
    e = HashEmbedder(16)
    a, b, c = e.embed(["one", "two", "one"])
    assert abs((a * a).sum() - 1) < 1e-9 and (a == c).all() and abs(a @ b) < 0.99

    def slow(t, i):
        h = (0xCBF29CE484222325 + i) % 2**64
        for x in t.encode():
            h = (h ^ x) * 0x100000001B3 % 2**64
            h ^= h >> 32
        return (h - 2**64 if h >= 2**63 else h) / (2**63 - 1)

    raw = [slow("two", i) for i in range(16)]
    norm = sum(x * x for x in raw) ** 0.5
    assert max(abs(x / norm - y) for x, y in zip(raw, b, strict=True)) < 1e-12


def test_backfill_leaves_known_vectors(spark):
    df = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "b", None), (3, None, None)], "id long, content string, vector array<double>")
    got = {r["id"]: r["vector"] for r in backfill(df, HashEmbedder(2)).collect()}
    assert got[1] == [1.0, 0.0] and len(got[2]) == 2 and got[3] is None


@pytest.mark.parametrize(
    ("content", "title"),
    [
        ("# A fine heading\ntext", "A fine heading"), ("## abc\nShort. no\nA sentence that is long enough. And more", "A sentence that is long enough"), ("> **Quoted bold** more", "Quoted bold"),
        ("- **Label**: first part. second", "Label: first part"), ("**Only a label**: abc. x", "Only a label"), ("**Bold alone here**", "Bold alone here"), ("`code line that is long`\n[link line that is long](x)", None),
        ("- see [the _page_](http://x) for more! ok", "see the _page_ for more"), ("", None), (None, None), ("\n\n  # " + "x" * 90, "x" * 77 + "..."), ("\n".join(["-"] * 8 + ["# Too late to count"]), None), ("**ab**: cd\n***\n#### Level four", "Level four"),
    ],
)
def test_markdown_titles(spark, content, title):
    from lorekeep.functions import titles

    assert one(spark, titles.markdown_title(F.col("s")), s=content) == title
