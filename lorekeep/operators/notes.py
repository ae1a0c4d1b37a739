"""Records as linked notes: file names, note texts, an index by type, and a managed block of links that is replaced as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import strip_ws
from .ranks import positions

# fixed values: characters that file names don't hold, lengths, entries of a type in the index
UNSAFE, NAME_CHARS, UNTITLED, INDEX_ENTRIES = r'[\\/:*?"<>|#^\[\]]', 60, "untitled", 10
#: Marks around the managed block.
OPEN, CLOSE = "<!-- links -->", "<!-- /links -->"


def note_name(content: Column) -> Column:
    """The first line without unsafe characters, cut; untitled if nothing is left."""
    line = F.regexp_extract(strip_ws(F.coalesce(content, F.lit(""))), r"^([^\r\n]*)", 1)
    name = F.substring(strip_ws(F.regexp_replace(F.regexp_replace(line, UNSAFE, ""), r"\s+", " ")), 1, NAME_CHARS)
    return F.when(name == "", UNTITLED).otherwise(name)


def note_names(records: DataFrame) -> DataFrame:
    """(id, name) of records (id, content): of equal names (case aside) the second in order of ids gets a 2 and so on, and one that is taken by then its id."""
    rows = records.select("id", note_name(F.col("content")).alias("base")).withColumn("low", F.lower("base"))
    placed = positions(rows, ["low"], F.floor(F.col("id") / 65_536), ["id"], "k")
    named = placed.select("id", "k", F.when(F.col("k") == 1, F.col("base")).otherwise(F.concat("base", F.lit(" "), F.col("k").cast("string"))).alias("name"))
    firsts = named.filter("k = 1").select(F.lower("name").alias("taken"))
    again = named.filter("k > 1").join(firsts, F.lower("name") == F.col("taken"), "left")
    again = again.select("id", F.when(F.col("taken").isNull(), F.col("name")).otherwise(F.concat("name", F.lit(" "), F.col("id").cast("string"))).alias("name"))
    return named.filter("k = 1").select("id", "name").union(again)


def links_of(near: DataFrame, records: DataFrame, names: DataFrame) -> DataFrame:
    """(id, links) of near (query, id, rank), few a query: `type/name` of each that has a note, in order."""
    to = near.join(records.select("id", "type"), "id").join(names, "id").select("query", "rank", F.concat("type", F.lit("/"), "name").alias("link"))
    return to.groupBy(F.col("query").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "link"))), lambda s: s["link"]).alias("links"))


def notes(records: DataFrame, names: DataFrame, links: DataFrame) -> DataFrame:
    """(id, path, text) of records (id, type, project, source, importance, ts, tags, content): front matter, content, related links."""
    rows = records.join(names, "id").join(links, "id", "left")
    tags = F.filter(F.transform(F.split(F.coalesce("tags", F.lit("")), ","), strip_ws), lambda t: t != "")
    listed = F.when(F.size(tags) > 0, F.array_join(F.transform(tags, lambda t: F.concat(F.lit("  - "), t)), "\n")).otherwise("  []")
    fields = [F.concat(F.lit(f"{label}: "), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("\n")) for label, c in (("id", "id"), ("type", "type"), ("project", "project"), ("source", "source"), ("importance", "importance"), ("timestamp", "ts"))]
    related = F.when(F.size("links") > 0, F.concat(F.lit("\n## Related\n"), F.array_join(F.transform("links", lambda x: F.concat(F.lit("- [["), x, F.lit("]]"))), "\n"), F.lit("\n"))).otherwise("")
    text = F.concat(F.lit("---\n"), *fields, F.lit("tags:\n"), listed, F.lit("\n---\n\n"), strip_ws(F.coalesce("content", F.lit(""))), F.lit("\n"), related)
    return rows.select("id", F.concat("type", F.lit("/"), "name", F.lit(".md")).alias("path"), text.alias("text"))


def index(records: DataFrame, names: DataFrame) -> DataFrame:
    """(type, text): heading, the most important notes, and how many more there are; a row a type."""
    rows = records.join(names, "id").select("id", "type", "name", "importance")
    n = rows.groupBy("type").agg(F.count("*").alias("n"))
    first = rows.withColumn("k", F.row_number().over(Window.partitionBy("type").orderBy(F.desc("importance"), "id"))).filter(F.col("k") <= INDEX_ENTRIES)
    entry = F.concat(F.lit("- [["), F.col("type"), F.lit("/"), F.col("name"), F.lit("]]"))
    listed = first.groupBy("type").agg(F.array_sort(F.collect_list(F.struct("k", entry.alias("e")))).alias("es"))  # INDEX_ENTRIES rows
    head = F.concat(F.lit("## "), F.initcap(F.regexp_replace("type", "_", " ")), F.lit(" ("), F.col("n").cast("string"), F.lit(")"))
    more = F.when(F.col("n") > INDEX_ENTRIES, F.concat(F.lit("\n- *(+"), (F.col("n") - INDEX_ENTRIES).cast("string"), F.lit(" more in `"), F.col("type"), F.lit("/`)*"))).otherwise("")
    return listed.join(n, "type").select("type", F.concat(head, F.lit("\n\n"), F.array_join(F.transform("es", lambda s: s["e"]), "\n"), more).alias("text"))


def with_block(text: Column, links: Column) -> Column:
    """text with the managed block of links: in place of the one it has, else at its end.  A second time changes nothing."""
    block = F.concat(F.lit(f"{OPEN}\n## Related\n"), F.array_join(F.transform(links, lambda x: F.concat(F.lit("- [["), x, F.lit("]]"))), "\n"), F.lit(f"\n{CLOSE}"))
    held = F.concat(F.lit(f"(?s){OPEN}.*?{CLOSE}"))
    plain = F.replace(F.replace(block, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))  # as a replacement text
    end = F.when(text.endswith("\n\n"), "\n").otherwise("\n\n\n")
    return F.when(text.rlike(f"(?s){OPEN}.*?{CLOSE}"), F.regexp_replace(text, held, plain)).otherwise(F.concat(F.regexp_replace(text, r"\n+\z", ""), end, block, F.lit("\n")))
