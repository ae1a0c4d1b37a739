"""File sources and sinks: sessions, transcripts, threads, vaults, key-value exports, JSONL and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import strip_ws

_PART = "struct<type: string, text: string>"
SESSION_FIELDS = ["session_id", "project", "cwd", "ended_at", "messages"]


def message_text(content: Column) -> Column:
    """The text of a message whose content is a JSON string or a list of parts."""
    parts = F.from_json(content, f"array<{_PART}>")
    texts = F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: p["text"])
    return strip_ws(F.when(content.startswith("["), F.array_join(texts, " ")).otherwise(content))


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """(session_id, project, cwd, ended_at, pos, role, text) of session JSON files.

    A message is nested under `message` or flat; files without one of the five
    fields give nothing.
    """
    message = "struct<type: string, role: string, content: string, message: struct<role: string, content: string>>"
    schema = f"session_id string, project string, cwd string, ended_at string, messages array<{message}>"
    rows = spark.read.schema(schema).json(path, multiLine=True, recursiveFileLookup=True)
    for f in SESSION_FIELDS:
        rows = rows.filter(F.col(f).isNotNull())
    m = rows.select("session_id", "project", "cwd", F.try_to_timestamp("ended_at").alias("ended_at"), F.posexplode("messages").alias("pos", "m"))
    role = F.coalesce("m.message.role", "m.role", "m.type")
    return m.select("session_id", "project", "cwd", "ended_at", "pos", role.alias("role"), message_text(F.coalesce("m.message.content", "m.content", F.lit(""))).alias("text"))


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Transcript JSONL (sessionId, timestamp, type, message) gathered to one row a session."""
    schema = "sessionId string, timestamp string, type string, cwd string, message struct<role: string, content: string>"
    rows = spark.read.schema(schema).json(path, recursiveFileLookup=True).filter("sessionId is not null and type in ('user', 'assistant')")
    m = F.struct("timestamp", F.col("message.role").alias("role"), message_text(F.coalesce("message.content", F.lit(""))).alias("text"))
    return rows.groupBy(F.col("sessionId").alias("session_id")).agg(F.max("timestamp").alias("ended_at"), F.max("cwd").alias("cwd"), F.array_sort(F.collect_list(m)).alias("messages"))


def read_threads(spark: SparkSession, path: str) -> DataFrame:
    """(title, tags, content, ts) of thread JSON files: first 6 messages as 200-character previews."""
    schema = "title string, created_at string, updated_at string, messages array<struct<role: string, content: string>>"
    rows = spark.read.schema(schema).json(path, multiLine=True, recursiveFileLookup=True)
    previews = F.transform(F.slice("messages", 1, 6), lambda m: F.concat(F.when(m["role"] == "user", "Q: ").otherwise("A: "), F.substring(F.coalesce(m["content"], F.lit("")), 1, 200)))
    tags = F.slice(F.filter(F.split(F.lower(F.coalesce("title", F.lit(""))), r"\s+"), lambda w: F.length(w) > 3), 1, 6)
    return rows.select("title", tags.alias("tags"), F.array_join(previews, " | ").alias("content"), F.coalesce(F.try_to_timestamp("created_at"), F.try_to_timestamp("updated_at"), F.col("_metadata.file_modification_time")).alias("ts"))


def read_vault(spark: SparkSession, path: str, skip: tuple[str, ...] = (".git", ".trash", "node_modules")) -> DataFrame:
    """(path, folder, stem, content) of all markdown files outside skipped folders."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md").select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    parts = F.split("path", "/")
    for s in skip:
        rows = rows.filter(~F.array_contains(F.split("path", "/"), s))
    return rows.select("path", F.element_at(parts, -2).alias("folder"), F.regexp_replace(F.element_at(parts, -1), r"\.md$", "").alias("stem"), "content")


def read_code(spark: SparkSession, path: str, pattern: str = "*.py") -> DataFrame:
    """(path, symbols, content) of source files, with `sym:` tags of functions and classes."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    where = F.col("_metadata.file_path")
    return rows.select(where.alias("path"), symbols(F.col("value"), F.substring_index(where, ".", -1)).alias("symbols"), F.col("value").alias("content"))


_STRING = r'"[^"\\]*+(?:\\(?s:.)[^"\\]*+)*+"'
_QUOTED = r"'[^'\\\n]*+(?:\\(?s:.)[^'\\\n]*+)*+'"
_BLOCK_COMMENT, _LINE_COMMENT = r"/\*(?s:.*?)\*/", r"//[^\n]*"
#: For each language its file endings, what is no code (the first that begins ends first), and its declarations with a body, the name as group 1.
LANGUAGES = [
    (["py"], [r'"""(?s:.*?)"""', r"'''(?s:.*?)'''", _STRING, _QUOTED, r"#[^\n]*"], r"(?<![\w.])(?:def|class)\s+([\p{L}_][\p{L}\p{N}_]*)"),
    (["rs"], [r'r(#*)"(?s:.*?)"\1', _STRING, r"'(?:\\(?:u\{[^}]*\}|.)|[^'\\\n])'", _LINE_COMMENT, _BLOCK_COMMENT], r"(?<!\w)fn\s+(?:r#)?([\p{L}_]\w*)(?=(?:\[[^\]]*+\]|[^;{\[])*+\{)"),
    (["ts", "mts", "cts", "tsx"], [_STRING, _QUOTED, r"`[^`\\]*+(?:\\(?s:.)[^`\\]*+)*+`", _LINE_COMMENT, _BLOCK_COMMENT], r"(?:^|[;{}\n])\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+([\p{L}_][\w$]*)(?=(?:\[[^\]]*+\]|[^;{\[])*+\{)"),
]


def symbols(code: Column, ending: Column) -> Column:
    """Sorted distinct names that a file declares: functions, in Python classes too; none for other languages.

    Strings and comments go first, in one pass from left to right, so a quote in
    a comment or a keyword in a string is neither.  Declarations without a body
    (of traits, overloads) and functions that are part of an expression don't count.
    """
    found = F.array().cast("array<string>")
    for endings, other, names in LANGUAGES:
        plain = F.regexp_replace(code, "|".join(other), " ")
        found = F.when(ending.isin(endings), F.regexp_extract_all(plain, F.lit(f"(?m){names}"), F.lit(1))).otherwise(found)
    return F.transform(F.array_sort(F.array_distinct(found)), lambda n: F.concat(F.lit("sym:"), n))


def key_value_bubbles(rows: DataFrame, least: int = 2) -> DataFrame:
    """(composer, n, text) of an editor's key-value export (key `bubbleId:composer:bubble`, JSON value), composers of least messages or more."""
    k = F.split("key", ":")
    v = F.from_json("value", "type int, text string")
    b = rows.filter("key like 'bubbleId:%'").select(k[1].alias("composer"), k[2].alias("bubble"), v["type"].alias("kind"), strip_ws(F.coalesce(v["text"], F.lit(""))).alias("text")).filter("text <> '' and kind in (1, 2)")
    line = F.concat(F.when(F.col("kind") == 1, "User: ").otherwise("Assistant: "), F.col("text"))
    g = b.groupBy("composer").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("bubble", line.alias("line")))).alias("ls"))
    return g.filter(F.col("n") >= least).select("composer", "n", F.array_join(F.transform("ls", lambda s: s["line"]), "\n\n").alias("text"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, value): the lines of text files, each with its number in its file, from 1.

    Spark reads a file in blocks.  Lines of a block come in order, so their
    running numbers less the block's smallest one count them; the lines of
    earlier blocks are added.  What is grouped is a row a block, not the lines.
    """
    rows = spark.read.text(path, recursiveFileLookup=True)
    rows = rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    blocks = rows.groupBy("path", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = blocks.select("path", "block", (F.coalesce(earlier, F.lit(0)) - F.col("first") + 1).alias("shift"))
    return rows.join(starts, ["path", "block"]).select("path", (F.col("at") + F.col("shift")).alias("line"), "value")


def read_migration(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad lines) of a JSONL import: numbers may be strings, of repeated ids the last line (of the last path) stays; bad lines (path, number, line)."""
    schema = "id string, content string, metadata map<string, string>, embedding array<double>, _bad string"
    lines = numbered_lines(spark, path).filter(strip_ws(F.col("value")) != "")
    rows = lines.withColumn("r", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    ok = F.col("r").isNotNull() & F.col("r._bad").isNull() & F.col("r.id").isNotNull() & F.col("r.content").isNotNull()
    good = rows.filter(ok).groupBy("r.id").agg(F.max_by(F.struct("r.content", "r.metadata", "r.embedding"), F.struct("path", "line")).alias("r"))
    good = good.select("id", "r.content", F.coalesce(F.try_to_number(F.col("r.metadata")["salience"], F.lit("9.999999")).cast("double"), F.lit(0.5)).alias("salience"), F.col("r.metadata")["project"].alias("project"), "r.embedding")
    return good, rows.filter(~F.coalesce(ok, F.lit(False))).select("path", F.col("line").alias("number"), F.col("value").alias("line"))


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """(query, gold, k) of a gold JSONL: one id or a list; a line that is no JSON, or has no query or ids, is an error that names the file and the line."""
    schema = "query string, gold_ids array<string>, gold_memory_id string, k int, _bad string"
    lines = numbered_lines(spark, path).filter(strip_ws(F.col("value")) != "")
    rows = lines.withColumn("r", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    gold = F.coalesce("r.gold_ids", F.when(F.col("r.gold_memory_id").isNotNull(), F.array("r.gold_memory_id")))
    wrong = F.when(F.col("r").isNull() | F.col("r._bad").isNotNull(), "no JSON").when(F.col("r.query").isNull() | gold.isNull(), "no query or ids")
    told = F.raise_error(F.concat(F.col("path"), F.lit(", line "), F.col("line").cast("string"), F.lit(": "), wrong)).cast("array<string>")
    return rows.select(F.col("r.query").alias("query"), F.explode(F.when(wrong.isNotNull(), told).otherwise(gold)).alias("gold"), F.coalesce("r.k", F.lit(10)).alias("k"))


def export_jsonl(rows: DataFrame, path: str, since: str | None = None) -> None:
    """Rows as JSON lines, with since only those whose ts isn't older; nulls are left out."""
    out = rows if since is None else rows.filter(F.col("ts") >= F.lit(since).cast("timestamp"))
    out.withColumn("schema_version", F.lit(1)).write.json(path, mode="overwrite", ignoreNullFields=True)


def prometheus(stats: DataFrame, prefix: str = "lorekeep") -> DataFrame:
    """(line) gauges of a table (metric, label, value)."""
    label = F.when(F.col("label").isNull(), "").otherwise(F.concat(F.lit('{kind="'), F.col("label"), F.lit('"}')))
    return stats.select(F.concat(F.lit(prefix + "_"), F.col("metric"), label, F.lit(" "), F.col("value").cast("string")).alias("line"))
