"""The supplied Parquet tables, and the views of them that stand for records, edges, feedback and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import derive_title


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Record types that stand for the languages of documents.
LANG_TYPES = {"en": "solution", "fr": "decision", "de": "fact", "es": "project_context"}


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records: type stands for lang, project is source; time and session come from the event of the same number."""
    lang_type = F.create_map(*[F.lit(x) for kv in LANG_TYPES.items() for x in kv])[F.col("lang")]
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), lang_type.alias("type"), F.col("source").alias("project"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("quality"))
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("user_id").cast("string").alias("session_id"))
    rows = docs.join(labels, "id", "left").join(events, "id", "left")
    return rows.select(
        "id", "content", derive_title(F.col("content"), F.col("session_id")).alias("title"), "type", "project", F.coalesce("session_id", F.lit("")).alias("session_id"),
        F.coalesce("ts", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias("ts"), F.coalesce("quality", F.lit(0.5)).alias("salience"),
        F.when(F.col("id") % 11 == 5, F.col("id") - 1).alias("superseded_by"), F.when(F.col("id") % 7 == 3, F.col("id") - 1).alias("parent_id"),
    )


_WS = r"'^\s+|\s+$', '', 'g'"
#: The same view in SQL.
MEMORIES_SQL = rf"""
memories AS (
  SELECT d.doc_id AS id, d.text AS content,
    CASE WHEN regexp_replace(d.text, {_WS}) = '' OR d.text IS NULL THEN CASE WHEN e.user_id IS NOT NULL THEN 'session ' || e.user_id ELSE 'Untitled memory' END
      ELSE substr(regexp_replace(regexp_extract(regexp_replace(d.text, {_WS}), '^([^\r\n]*)', 1), {_WS}), 1, 120) END AS title,
    CASE d.lang WHEN 'en' THEN 'solution' WHEN 'fr' THEN 'decision' WHEN 'de' THEN 'fact' WHEN 'es' THEN 'project_context' END AS type, d.source AS project, coalesce(CAST(e.user_id AS VARCHAR), '') AS session_id, coalesce(e.ts, TIMESTAMP '2024-01-01 00:00:00') AS ts,
    coalesce(CAST(l.quality AS DOUBLE), 0.5) AS salience, CASE WHEN d.doc_id % 11 = 5 THEN d.doc_id - 1 END AS superseded_by, CASE WHEN d.doc_id % 7 = 3 THEN d.doc_id - 1 END AS parent_id
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN events e ON e.event_id = d.doc_id
)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, vector) of non-null embeddings."""
    return table(spark, sf_dir, "embeddings").filter("embedding is not null").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(memory, entity), as often as orders mention parts."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("memory"), F.col("l_partkey").alias("entity"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct pairs of them."""
    return mentions(spark, sf_dir).distinct()


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity"), F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("name"))


#: Feedback types of the event types, fixed values.
FEEDBACK_TYPES = {"view": "search_hit", "click": "accepted", "error": "rejected", "purchase": "accepted", "signup": "session_end"}


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as feedback with an idempotency key that repeats: user, type and day."""
    kinds = F.create_map(*[F.lit(x) for kv in FEEDBACK_TYPES.items() for x in kv])
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), kinds[F.col("event_type")].alias("kind"), (F.col("user_id") % 97).alias("memory"), F.col("user_id").cast("string").alias("session_id"), "props",
        F.concat_ws("|", F.col("user_id").cast("string"), "event_type", F.date_format("ts", "yyyy-MM-dd")).alias("key"),
    )


FEEDBACK_SQL = """
feedback AS (
  SELECT event_id, ts, CASE event_type WHEN 'view' THEN 'search_hit' WHEN 'click' THEN 'accepted' WHEN 'error' THEN 'rejected' WHEN 'purchase' THEN 'accepted' WHEN 'signup' THEN 'session_end' END AS kind,
    user_id % 97 AS memory, CAST(user_id AS VARCHAR) AS session_id, props, user_id || '|' || event_type || '|' || strftime(ts, '%Y-%m-%d') AS key
  FROM events
)"""
