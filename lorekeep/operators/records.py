"""Scans, listings, aggregates and changes of record tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import derive_title, micros, strip_private, strip_ws
from .ranks import positions


def multi_get(memories: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows by ids (pos, id) in request order; missing ones skipped, repeated ones repeated."""
    return ids.join(memories, "id").select("pos", "id", "content")


def list_page(memories: DataFrame, offset: int, limit: int, *conditions: Column) -> DataFrame:
    """Newest first, with the total before paging; limit at most 5000."""
    rows = memories
    for c in conditions:
        rows = rows.filter(c)
    total = rows.agg(F.count("*").alias("total"))
    page = rows.select("id", "type", "project", "ts").orderBy(F.desc("ts"), "id").offset(offset).limit(min(limit, 5000))
    return page.crossJoin(F.broadcast(total))  # one row


def stats(memories: DataFrame, feedback: DataFrame) -> DataFrame:
    """One row: totals, distinct non-empty sessions, feedback count and last time."""
    m = memories.agg(F.count("*").alias("total"), F.countDistinct(F.when(F.col("session_id") != "", F.col("session_id"))).alias("sessions"))
    f = feedback.agg(F.count("*").alias("feedback"), F.max("ts").alias("last_feedback"))
    return m.crossJoin(f)  # one row each


def timeline(memories: DataFrame, anchors: DataFrame, before: int = 3, after: int = 3, key: str | None = None) -> DataFrame:
    """(anchor, id, offset): rows around each anchor in time, ties with the anchor left out.

    Within key, the session say, or without one over the whole table: times are
    numbered day by day, and an anchor meets its neighbours by an equi-join on
    (key, position).
    """
    part = F.col(key) if key else F.lit(0)
    t = memories.select("id", "ts", part.alias("k"))
    dense = positions(t.select("k", "ts").distinct(), ["k"], F.to_date("ts"), ["ts"], "d")
    a = t.join(anchors.select(F.col("anchor").alias("id")), "id", "left_semi").select(F.col("id").alias("anchor"), "k", F.col("ts").alias("at"))
    # only so many distinct times either side can matter
    spans = a.join(dense.withColumnRenamed("ts", "at"), ["k", "at"]).select("anchor", "k", "at", F.explode(F.sequence(F.col("d") - before, F.col("d") + after)).alias("d"))
    near = spans.join(dense, ["k", "d"]).join(t, ["k", "ts"]).filter((F.col("ts") != F.col("at")) | (F.col("id") == F.col("anchor")))
    side = F.signum(micros(F.col("ts")) - micros(F.col("at")))
    n = F.row_number().over(Window.partitionBy("anchor", side).orderBy(F.abs(micros(F.col("ts")) - micros(F.col("at"))), F.when(side < 0, -F.col("id")).otherwise(F.col("id"))))
    return near.withColumn("side", side).withColumn("n", n).filter(((F.col("side") < 0) & (F.col("n") <= before)) | ((F.col("side") > 0) & (F.col("n") <= after)) | (F.col("side") == 0)).select("anchor", "id", (F.col("side") * F.when(F.col("side") == 0, 0).otherwise(F.col("n"))).cast("int").alias("offset"))


def episode_of(memories: DataFrame) -> DataFrame:
    """(id, episode): a fact's parent where it exists, else the record itself."""
    p = memories.select(F.col("id").alias("pid"))
    return memories.join(p, F.col("parent_id") == F.col("pid"), "left").select("id", F.coalesce("pid", "id").alias("episode"))


def upsert(base: DataFrame, new: DataFrame, key: str = "id", keep_if_null: tuple[str, ...] = ("embedding",)) -> DataFrame:
    """New rows replace old ones of the same key; a null in a keep_if_null column keeps the old value."""
    b, n = base.alias("b"), new.alias("n")
    joined = b.join(n, F.col(f"b.{key}") == F.col(f"n.{key}"), "full_outer")
    has = F.col(f"n.{key}").isNotNull()

    def pick(c: str) -> Column:
        if c in keep_if_null:
            return F.coalesce(F.col(f"n.{c}"), F.col(f"b.{c}")).alias(c)
        return F.when(has, F.col(f"n.{c}")).otherwise(F.col(f"b.{c}")).alias(c)

    return joined.select(*[pick(c) for c in base.columns])


def delete(memories: DataFrame, ids: DataFrame) -> DataFrame:
    return memories.join(ids, "id", "left_anti")


def supersede(memories: DataFrame, pairs: DataFrame) -> DataFrame:
    """Set superseded_by from pairs (old, new)."""
    p = pairs.groupBy("old").agg(F.max("new").alias("_new"))
    return memories.join(p, F.col("id") == F.col("old"), "left").withColumn("superseded_by", F.coalesce("_new", "superseded_by")).drop("old", "_new")


def merge_missing(target: DataFrame, source: DataFrame, key: str = "id") -> DataFrame:
    """target and the rows of source whose key it lacks."""
    return target.unionByName(source.join(target.select(key), key, "left_anti").select(*target.columns))


def exact_dedup(memories: DataFrame) -> DataFrame:
    """(id, keep): the smallest id of each content is kept."""
    least = memories.groupBy(F.sha2(F.coalesce("content", F.lit("")), 256).alias("h")).agg(F.min("id").alias("least"))
    return memories.select("id", F.sha2(F.coalesce("content", F.lit("")), 256).alias("h")).join(least, "h").select("id", (F.col("id") == F.col("least")).alias("keep"))


def title_dedup(memories: DataFrame) -> DataFrame:
    """ids to delete: all but the oldest of each (project, title)."""
    w = Window.partitionBy("project", "title").orderBy("ts", "id")
    return memories.filter("title is not null").select("id", "project", "title", F.row_number().over(w).alias("k")).filter("k > 1").select("id", "project", "k")


def append_feedback(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows of incoming that are new: the first of each key that existing lacks; null keys always."""
    keyed = incoming.filter("key is not null").withColumn("_k", F.row_number().over(Window.partitionBy("key").orderBy("ts", "event_id"))).filter("_k = 1").drop("_k")
    return keyed.join(existing.filter("key is not null").select("key").distinct(), "key", "left_anti").select(*incoming.columns).unionByName(incoming.filter("key is null"))


def nudged_salience(memories: DataFrame, feedback: DataFrame, accepted: float = 0.05, rejected: float = -0.10) -> DataFrame:
    """(id, salience) after feedback in order: each step is clamped to [0.1, 1]; null and 0 start at 0.5."""
    step = F.when(F.col("kind") == "accepted", accepted).when(F.col("kind") == "rejected", rejected)
    moves = feedback.withColumn("d", step).filter("d is not null").groupBy("memory").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "d"))).alias("moves"))
    start = F.when(F.coalesce("salience", F.lit(0.0)) == 0, 0.5).otherwise(F.col("salience"))
    after = F.aggregate("moves", start, lambda s, m: F.greatest(F.lit(0.1), F.least(F.lit(1.0), s + m["d"])))
    return memories.join(moves, F.col("id") == F.col("memory")).select("id", F.round(after, 6).alias("salience"))


def rollback_batch(memories: DataFrame, curation: DataFrame, batches: DataFrame, batch_id: str) -> tuple[DataFrame, DataFrame]:
    """Memories and batches after undoing a batch: its facts go, what they superseded is active again, the batch is marked."""
    facts = curation.filter((F.col("batch_id") == batch_id) & F.col("decision").isin("ADD", "UPDATE", "MERGE")).select(F.col("fact_id").alias("id")).distinct()
    gone = facts.select(F.col("id").alias("superseded_by"), F.lit(True).alias("_gone"))
    left = memories.join(facts, "id", "left_anti").join(gone, "superseded_by", "left")
    left = left.withColumn("superseded_by", F.when(F.col("_gone"), F.lit(None)).otherwise(F.col("superseded_by"))).select(*memories.columns)
    own = F.col("batch_id") == batch_id
    marked = batches
    for c, v in (("rolled_back", 1), ("facts_inserted", 0), ("facts_superseded", 0)):
        marked = marked.withColumn(c, F.when(own, F.lit(v)).otherwise(F.col(c)))
    return left, marked


def log_curation(log: DataFrame, decisions: DataFrame, ts: Column) -> DataFrame:
    """log and the decisions (fact_id, decision, sim, reason, model, batch_id), each with an id of its own and the time ts."""
    new = decisions.withColumn("id", F.expr("uuid()")).withColumn("ts", ts)
    return log.unionByName(new.select(*log.columns))


def start_batches(batches: DataFrame, new: DataFrame, ts: Column) -> DataFrame:
    """batches and those of new (batch_id, project, p1_before) that are not there yet, as started at ts."""
    fresh = new.dropDuplicates(["batch_id"]).join(batches.select("batch_id"), "batch_id", "left_anti")
    return batches.unionByName(fresh.withColumn("started_at", ts).withColumn("rolled_back", F.lit(0)), allowMissingColumns=True)


def finish_batches(batches: DataFrame, results: DataFrame, ts: Column) -> DataFrame:
    """batches with the outcome of results (batch_id, p1_after, facts_inserted, facts_superseded, rolled_back), one row a batch, at ts; results of unknown batches go."""
    sets = ["p1_after", "facts_inserted", "facts_superseded", "rolled_back"]
    r = results.select(F.col("batch_id").alias("_batch"), *[F.col(c).alias(f"_{c}") for c in sets])
    done = F.col("_batch").isNotNull()
    out = batches.join(r, F.col("batch_id") == F.col("_batch"), "left").withColumn("finished_at", F.when(done, ts).otherwise(F.col("finished_at")))
    for c in sets:
        out = out.withColumn(c, F.when(done, F.col(f"_{c}")).otherwise(F.col(c)))
    return out.select(*batches.columns)


def prepared(incoming: DataFrame) -> DataFrame:
    """Rows to save: private spans cut, titles derived, and an error for rows without content or with an unknown project."""
    clean = strip_private(F.coalesce("content", F.lit("")))
    title = F.when(strip_ws(F.coalesce("title", F.lit(""))) != "", F.col("title")).otherwise(derive_title(clean, F.col("session_id")))
    error = F.when(strip_ws(clean) == "", "empty content").when(F.col("project").isNull(), "no project")
    return incoming.withColumn("title", title).withColumn("content", clean).withColumn("error", error)


def event_times(memories: DataFrame, sessions: DataFrame, newest: str = "2025-07-01", oldest: str = "2025-01-01") -> DataFrame:
    """(id, event_time): the session's end, else newest for records with a session, else oldest; set times stay."""
    s = sessions.select("session_id", F.col("ended_at").alias("_end"))
    ts = lambda x: F.lit(f"{x} 00:00:00").cast("timestamp_ntz")
    return memories.join(s, "session_id", "left").select("id", F.coalesce("event_time", "_end", F.when(F.col("session_id") != "", ts(newest)).otherwise(ts(oldest))).alias("event_time"))
