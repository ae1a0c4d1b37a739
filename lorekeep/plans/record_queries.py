"""Scans, listings, aggregates, changes, text functions and the graph, over whole tables."""

# ruff: noqa: E501
from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import chunk, text
from ..operators import graph, records
from ..sources.tables import FEEDBACK_SQL, MEMORIES_SQL, edges, entities, feedback, memories, mentions, table
from .registry import query

EDGES = "edges AS (SELECT DISTINCT l_orderkey AS memory, l_partkey AS entity FROM lineitem), entities AS (SELECT p_partkey AS entity, p_name || ' ' || p_partkey AS name FROM part)"
M = f"WITH {MEMORIES_SQL}"
WS = r"'^\s+|\s+$', '', 'g'"


@query(f"{M}, {FEEDBACK_SQL} SELECT * FROM (SELECT count(*) AS total, count(DISTINCT nullif(session_id, '')) AS sessions FROM memories), (SELECT count(*) AS feedback, max(ts) AS last_feedback FROM feedback)")
def stats_bundle(spark, d):
    return records.stats(memories(spark, d), feedback(spark, d))


@query(f"{M} SELECT type, count(*) AS n FROM memories GROUP BY type")
def count_by_type(spark, d):
    return memories(spark, d).groupBy("type").agg(F.count("*").alias("n"))


@query(f"{M} SELECT id, type, ts FROM memories ORDER BY ts DESC, id")
def newest_first(spark, d):
    return memories(spark, d).select("id", "type", "ts").orderBy(F.desc("ts"), "id")


@query(f"{M}, r AS (SELECT * FROM memories WHERE type = 'solution') SELECT id, type, project, ts, (SELECT count(*) FROM r) AS total FROM r ORDER BY ts DESC, id LIMIT 50 OFFSET 10")
def list_page(spark, d):
    return records.list_page(memories(spark, d), 10, 50, F.col("type") == "solution")


@query(f"{M} SELECT id, title, type, substr(content, 1, 120) AS snippet FROM memories")
def compact_projection(spark, d):
    return memories(spark, d).select("id", "title", "type", text.snippet(F.col("content"), 120).alias("snippet"))


def _requests(spark, d):
    b = table(spark, d, "benchmark")
    return b.select(F.col("item_id").alias("pos"), (F.col("item_id") * 37 % 1200 - F.col("item_id") % 2 * 37).alias("id"))


@query(f"{M} SELECT b.item_id AS pos, m.id, m.content FROM benchmark b JOIN memories m ON m.id = b.item_id * 37 % 1200 - b.item_id % 2 * 37")
def multi_get(spark, d):
    return records.multi_get(memories(spark, d), _requests(spark, d))


@query(f"""{M}, p AS (
  SELECT a.id AS anchor, b.id, CASE WHEN b.ts < a.ts THEN -1 WHEN b.ts > a.ts THEN 1 ELSE 0 END AS side, a.ts AS ats, b.ts AS bts
  FROM memories a JOIN memories b USING (session_id) WHERE a.ts <> b.ts OR a.id = b.id
), n AS (SELECT *, row_number() OVER (PARTITION BY anchor, side ORDER BY abs(epoch_us(ats) - epoch_us(bts)), CASE WHEN side < 0 THEN -id ELSE id END) AS n FROM p)
SELECT anchor, id, CAST(side * CASE WHEN side = 0 THEN 0 ELSE n END AS INTEGER) AS offset FROM n WHERE side = 0 OR n <= 3""")
def timeline_around(spark, d):
    m = memories(spark, d)
    return records.timeline(m, m.select(F.col("id").alias("anchor")), 3, 3, "session_id")


@query(f"{M} SELECT parent_id, id, row_number() OVER (PARTITION BY parent_id ORDER BY salience DESC, ts, id) AS pos FROM memories WHERE parent_id IS NOT NULL AND superseded_by IS NULL")
def facts_of_episode(spark, d):
    w = Window.partitionBy("parent_id").orderBy(F.desc("salience"), "ts", "id")
    return memories(spark, d).filter("parent_id is not null and superseded_by is null").select("parent_id", "id", F.row_number().over(w).alias("pos"))


@query(f"{M} SELECT m.id, coalesce(p.id, m.id) AS episode FROM memories m LEFT JOIN memories p ON p.id = m.parent_id")
def get_episode(spark, d):
    return records.episode_of(memories(spark, d))


def _orders(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("content"), F.col("o_orderstatus").alias("type"))


@query(f"WITH {EDGES} SELECT o_orderkey AS id, substr(o_orderpriority || ' ' || o_orderstatus, 1, 160) AS snippet, string_agg(name, '|' ORDER BY name) AS entities FROM orders JOIN edges ON memory = o_orderkey JOIN entities USING (entity) GROUP BY 1, 2")
def linked_memories(spark, d):
    return graph.linked(_orders(spark, d), edges(spark, d), entities(spark, d))


@query(f"WITH {EDGES} SELECT entity, name, count(DISTINCT memory) AS n FROM edges JOIN entities USING (entity) GROUP BY 1, 2")
def entity_counts(spark, d):
    return graph.entity_counts(edges(spark, d), entities(spark, d))


@query(f"WITH {EDGES}, s AS (SELECT o_orderkey AS seed FROM orders WHERE o_orderpriority = '1-URGENT') SELECT DISTINCT seed, y.memory AS neighbor FROM s JOIN edges x ON x.memory = seed JOIN edges y ON x.entity = y.entity WHERE y.memory NOT IN (SELECT seed FROM s)")
def neighbors(spark, d):
    seeds = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("seed"))
    return graph.neighbors(seeds, edges(spark, d))


@query(f"WITH {EDGES} SELECT memory, count(DISTINCT x.entity) AS n_edges, count(DISTINCT CASE WHEN y.memory <> x.memory THEN y.memory END) AS degree FROM (SELECT memory, entity FROM edges) x JOIN (SELECT memory, entity FROM edges) y ON x.entity = y.entity GROUP BY x.memory".replace("SELECT memory, count(DISTINCT x", "SELECT x.memory, count(DISTINCT x"))
def neighbor_degree(spark, d):
    return graph.neighbor_degree(mentions(spark, d))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) AND o_orderstatus IN ('O', 'F')")
def edgeless_durable(spark, d):
    return graph.edgeless(_orders(spark, d), edges(spark, d), ["O", "F"])


@query(f"WITH {EDGES}, s AS (SELECT entity FROM edges WHERE memory IN (SELECT o_orderkey FROM orders WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders))) SELECT memory AS src, entity AS dst FROM edges WHERE entity IN (SELECT entity FROM s)")
def ego_graph(spark, d):
    o = table(spark, d, "orders")
    top = o.agg(F.max("o_totalprice").alias("o_totalprice"))
    return graph.ego_graph(o.join(F.broadcast(top), "o_totalprice").select(F.col("o_orderkey").alias("seed")), edges(spark, d))


@query(f"WITH {EDGES} SELECT 'm:' || memory AS node, 'memory' AS kind, count(*) AS degree FROM edges GROUP BY memory UNION ALL SELECT 'e:' || entity, 'entity', count(*) FROM edges GROUP BY entity")
def bipartite_nodes(spark, d):
    return graph.bipartite_nodes(edges(spark, d))


@query("SELECT lower(p_name) AS norm, arg_min(p_name, p_partkey) AS name, count(DISTINCT l_orderkey) AS n FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY 1")
def link_entities(spark, d):
    pairs = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("memory"), F.col("p_name").alias("name"), F.col("p_partkey").alias("pos"))
    ents, links = graph.link_entities(spark.createDataFrame([], "norm string, name string"), spark.createDataFrame([], "memory long, norm string"), pairs)
    return links.groupBy("norm").agg(F.count("*").alias("n")).join(ents, "norm").select("norm", "name", "n")


@query(f"{M} SELECT id, id = min(id) OVER (PARTITION BY content) AS keep FROM memories")
def exact_dedup(spark, d):
    return records.exact_dedup(memories(spark, d))


@query(f"{M} SELECT * FROM (SELECT id, project, row_number() OVER (PARTITION BY project, title ORDER BY ts, id) AS k FROM memories WHERE title IS NOT NULL) WHERE k > 1")
def title_dedup(spark, d):
    return records.title_dedup(memories(spark, d))


@query("SELECT vec_id AS id, 'vectors' AS origin FROM embeddings UNION ALL SELECT doc_id, 'documents' FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def merge_missing(spark, d):
    a = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.lit("vectors").alias("origin"))
    return records.merge_missing(a, table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit("documents").alias("origin")))


@query("SELECT d.doc_id AS id FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id WHERE e.embedding IS NULL")
def unembedded(spark, d):
    e = table(spark, d, "embeddings").filter("embedding is not null").select(F.col("vec_id").alias("id"))
    return table(spark, d, "documents").select(F.col("doc_id").alias("id")).join(e, "id", "left_anti")


@query(f"WITH {FEEDBACK_SQL} SELECT event_id, kind, key FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, event_id) AS k FROM feedback) WHERE k = 1")
def feedback_dedupe(spark, d):
    f = feedback(spark, d)
    return records.append_feedback(f.filter("false"), f).select("event_id", "kind", "key")


@query(f"WITH {FEEDBACK_SQL} SELECT event_id, ts, kind FROM feedback WHERE ts >= (SELECT max(ts) FROM feedback) - INTERVAL 7 DAY")
def feedback_since(spark, d):
    f = feedback(spark, d)
    last = f.agg((F.max("ts") - F.expr("interval 7 days")).alias("since"))
    return f.join(F.broadcast(last), F.col("ts") >= F.col("since")).select("event_id", "ts", "kind")


@query(f"WITH {FEEDBACK_SQL} SELECT event_id, ts, kind FROM feedback WHERE ts > TIMESTAMP '2024-01-10 00:00:00' OR (ts = TIMESTAMP '2024-01-10 00:00:00' AND event_id > 500) ORDER BY ts, event_id")
def digest_cursor(spark, d):
    from ..streaming.flows import digest_since

    return digest_since(feedback(spark, d).select("event_id", "ts", "kind"), F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"), F.lit(500))


@query(f"{M}, {FEEDBACK_SQL} SELECT kind, count(*) AS n, round(avg(salience), 6) AS mean_salience FROM feedback JOIN memories ON memory = id GROUP BY kind")
def feedback_by_type_mean(spark, d):
    return feedback(spark, d).join(memories(spark, d), F.col("memory") == F.col("id")).groupBy("kind").agg(F.count("*").alias("n"), F.round(F.avg("salience"), 6).alias("mean_salience"))


@query(f"""{M}, {FEEDBACK_SQL}, s AS (
  SELECT memory, list(CASE kind WHEN 'accepted' THEN 0.05::DOUBLE ELSE -0.10::DOUBLE END ORDER BY ts, event_id) AS ds FROM feedback WHERE kind IN ('accepted', 'rejected') GROUP BY memory
) SELECT id, round(list_reduce(list_prepend(CASE WHEN coalesce(salience, 0) = 0 THEN 0.5::DOUBLE ELSE salience END, ds), lambda s, x: greatest(0.1::DOUBLE, least(1.0::DOUBLE, s + x))), 6) AS salience FROM memories JOIN s ON memory = id""")
def feedback_salience_nudge(spark, d):
    return records.nudged_salience(memories(spark, d).select("id", "salience"), feedback(spark, d).select("memory", "ts", "event_id", "kind"))


@query(f"""{M}, c AS (SELECT event_id AS fact_id, CASE event_type WHEN 'click' THEN 'ADD' WHEN 'view' THEN 'UPDATE' WHEN 'purchase' THEN 'MERGE' ELSE 'IGNORE' END AS decision, 'b' || user_id % 5 AS batch_id FROM events),
f AS (SELECT DISTINCT fact_id FROM c WHERE batch_id = 'b2' AND decision IN ('ADD', 'UPDATE', 'MERGE'))
SELECT id, CASE WHEN superseded_by IN (SELECT fact_id FROM f) THEN NULL ELSE superseded_by END AS superseded_by FROM memories WHERE id NOT IN (SELECT fact_id FROM f)""")
def rollback_batch(spark, d):
    e = table(spark, d, "events")
    decision = F.when(F.col("event_type") == "click", "ADD").when(F.col("event_type") == "view", "UPDATE").when(F.col("event_type") == "purchase", "MERGE").otherwise("IGNORE")
    cur = e.select(F.col("event_id").alias("fact_id"), decision.alias("decision"), F.concat(F.lit("b"), F.col("user_id") % 5).alias("batch_id"))
    batches = spark.createDataFrame([("b2", 0, 1, 1)], "batch_id string, rolled_back int, facts_inserted int, facts_superseded int")
    return records.rollback_batch(memories(spark, d).select("id", "superseded_by"), cur, batches, "b2")[0]


@query(f"{M} SELECT m.id, coalesce(p.id, m.superseded_by) AS superseded_by FROM memories m LEFT JOIN (SELECT parent_id, max(id) AS id FROM memories WHERE parent_id IS NOT NULL GROUP BY 1) p ON p.parent_id = m.id")
def supersede(spark, d):
    m = memories(spark, d)
    return records.supersede(m.select("id", "superseded_by"), m.filter("parent_id is not null").select(F.col("parent_id").alias("old"), F.col("id").alias("new")))


@query("SELECT coalesce(l.doc_id, d.doc_id) AS id, CASE WHEN l.doc_id IS NOT NULL THEN 'labels' ELSE 'documents' END AS origin, coalesce(CAST(l.quality AS VARCHAR), d.lang) AS embedding FROM documents d FULL JOIN labels l ON l.doc_id = d.doc_id")
def upsert(spark, d):
    base = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit("documents").alias("origin"), F.col("lang").alias("embedding"))
    return records.upsert(base, table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.lit("labels").alias("origin"), F.col("quality").cast("string").alias("embedding")))


@query(f"""{M} SELECT id, CASE WHEN id % 3 = 0 THEN TIMESTAMP '2024-05-05 05:05:05' WHEN CAST(session_id AS INTEGER) % 2 = 0 THEN TIMESTAMP '2024-06-06 06:06:06' WHEN session_id <> '' THEN TIMESTAMP '2025-07-01' ELSE TIMESTAMP '2025-01-01' END AS event_time
FROM (SELECT id, nullif(session_id, '') AS session_id FROM memories)""")
def event_time_stamp(spark, d):
    m = memories(spark, d).withColumn("event_time", F.when(F.col("id") % 3 == 0, F.lit("2024-05-05 05:05:05").cast("timestamp_ntz")))
    s = m.filter("session_id <> '' and cast(session_id as int) % 2 = 0").select("session_id", F.lit("2024-06-06 06:06:06").cast("timestamp_ntz").alias("ended_at")).distinct()
    return records.event_times(m, s)


@query("SELECT doc_id, regexp_replace(text || ' <Private>' || source || E'\\n</PRIVATE> end <private>x</private>', '(?is)<private>.*?</private>', '', 'g') AS content FROM documents")
def privacy_strip(spark, d):
    c = F.concat(F.col("text"), F.lit(" <Private>"), F.col("source"), F.lit("\n</PRIVATE> end <private>x</private>"))
    return table(spark, d, "documents").select("doc_id", text.strip_private(c).alias("content"))


@query(f"{M} SELECT id, title FROM memories")
def title_derive(spark, d):
    return memories(spark, d).select("id", "title")


def _contains(c: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, '{w.replace(chr(39), chr(39) * 2)}')" for w in words) + ")"


_REMARK = "CASE conv_id % 7 WHEN 0 THEN ' No Actionable items' WHEN 1 THEN ' these memories' ELSE '' END"


@query(f"""SELECT conv_id, turn, CASE WHEN length(regexp_replace(c, {WS})) < 30 THEN 'too_short' WHEN s = 'reflection' AND {_contains('lower(c)', text.REFLECTION_META)} THEN 'reflection_meta' WHEN {_contains('lower(c)', text.TRIVIAL_CONTENT)} THEN 'trivial_content' END AS reason
FROM (SELECT conv_id, turn, text || {_REMARK} AS c, CASE WHEN role = 'system' THEN 'reflection' ELSE role END AS s FROM conversations)""")
def trivial_classify(spark, d):
    c = table(spark, d, "conversations")
    remark = F.when(F.col("conv_id") % 7 == 0, " No Actionable items").when(F.col("conv_id") % 7 == 1, " these memories").otherwise("")
    source = F.when(F.col("role") == "system", "reflection").otherwise(F.col("role"))
    return c.select("conv_id", "turn", text.classify_trivial(F.concat("text", remark), source).alias("reason"))


@query(f"SELECT conv_id, turn, (octet_length(encode(regexp_replace(text || {_REMARK}, {WS}))) < 30 OR {_contains(f'lower(text || {_REMARK})', text.NOISY_REFLECTION)}) AS noisy FROM conversations")
def noisy_reflections(spark, d):
    remark = F.when(F.col("conv_id") % 7 == 0, " No Actionable items").when(F.col("conv_id") % 7 == 1, " these memories").otherwise("")
    return table(spark, d, "conversations").select("conv_id", "turn", text.noisy_reflection(F.concat("text", remark)).alias("noisy"))


@query("SELECT conv_id, turn FROM (SELECT *, CASE turn % 3 WHEN 0 THEN 'ran COMMAND: ' WHEN 1 THEN 'Edited ' ELSE '' END || text AS c FROM conversations) WHERE c ILIKE 'Ran command:%' OR c ILIKE 'Edited %'")
def bad_data_predicates(spark, d):
    c = F.concat(F.when(F.col("turn") % 3 == 0, "ran COMMAND: ").when(F.col("turn") % 3 == 1, "Edited ").otherwise(""), "text")
    return table(spark, d, "conversations").withColumn("c", c).filter(F.col("c").ilike("Ran command:%") | F.col("c").ilike("Edited %")).select("conv_id", "turn")


@query(r"SELECT item_id, array_to_string(list_filter(string_split(regexp_replace(text, '[^\p{L}\p{N}''-]+', ' ', 'g'), ' '), lambda t: octet_length(encode(t)) >= 2), ' ') AS tokens FROM benchmark")
def query_sanitize(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(text.sanitize_query(F.col("text")), " ").alias("tokens"))


_PHRASES = ["Why does this FAIL", "what did we decide about it", "status of the build", "how many rows", "plain words"]


@query(f"""SELECT conv_id, turn, CASE WHEN {_contains('q', text.TROUBLESHOOT)} THEN 'solution' WHEN {_contains('q', text.DECISION)} THEN 'decision' WHEN {_contains('q', text.STATUS)} THEN 'status' WHEN {_contains('q', text.FACTUAL)} THEN 'fact' END AS intent
FROM (SELECT conv_id, turn, lower(text || ' ' || (['{"', '".join(_PHRASES)}'])[(conv_id % 5 + 1)::INTEGER]) AS q FROM conversations)""")
def intent_route(spark, d):
    q = F.concat_ws(" ", "text", F.element_at(F.array(*map(F.lit, _PHRASES)), (F.col("conv_id") % 5 + 1).cast("int")))
    return table(spark, d, "conversations").select("conv_id", "turn", text.classify_intent(q).alias("intent"))


@query(r"SELECT p_partkey, lower(regexp_replace(regexp_replace('  ' || upper(p_name) || '   ' || p_brand, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS norm FROM part")
def entity_normalize(spark, d):
    return table(spark, d, "part").select("p_partkey", text.normalize_entity(F.concat(F.lit("  "), F.upper("p_name"), F.lit("   "), F.col("p_brand"))).alias("norm"))


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 'fact' WHEN 'click' THEN 'error_lesson' WHEN 'error' THEN 'error_lesson' WHEN 'purchase' THEN 'project_context' ELSE 'conversation' END AS type FROM events")
def type_aliases(spark, d):
    raw = F.when(F.col("event_type") == "view", "Knowledge").when(F.col("event_type") == "click", "ErrorLesson").when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "project-context").otherwise(F.col("event_type"))
    return table(spark, d, "events").select("event_id", text.normalize_type(raw).alias("type"))


@query(r"""WITH s AS (SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY p_partkey) AS k FROM s)
SELECT p_partkey, slug || CASE WHEN k > 1 THEN ' ' || k ELSE '' END AS note FROM n""")
def unique_slugs(spark, d):
    rows = table(spark, d, "part").select("p_partkey", text.slug(F.col("p_name")).alias("slug"))
    k = F.row_number().over(Window.partitionBy("slug").orderBy("p_partkey"))
    return rows.withColumn("k", k).select("p_partkey", F.concat("slug", F.when(F.col("k") > 1, F.concat(F.lit(" "), F.col("k"))).otherwise("")).alias("note"))


_MESSAGES = "m AS (SELECT conv_id AS session, turn AS pos, role, coalesce(text, '') AS text FROM conversations)"


def _messages(spark, d):
    return table(spark, d, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("pos"), "role", "text")


@query(f"""WITH {_MESSAGES}, n AS (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS reply FROM m WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY session ORDER BY pos))
SELECT session, pos, 'Chunk ' || substr(CAST(session AS VARCHAR), 1, 12) || ' · ' || substr(text, 1, 72) || CASE WHEN length(text) > 72 THEN '…' ELSE '' END AS title, 'User: ' || text || E'\\n\\nAssistant: ' || reply AS content
FROM n WHERE role = 'user' AND next_role = 'assistant' AND length(text) + length(reply) >= 50""")
def pair_chunks(spark, d):
    return chunk.pair_chunks(_messages(spark, d))


@query(f"""WITH {_MESSAGES}, p AS (SELECT session, pos, CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || substr(regexp_replace(text, {WS}), 1, 800) AS part FROM m WHERE role IN ('user', 'assistant') AND length(regexp_replace(text, {WS})) >= 30),
t AS (SELECT *, sum(length(part)) OVER (PARTITION BY session ORDER BY pos ROWS UNBOUNDED PRECEDING) AS total FROM p)
SELECT session, count(*) AS n_parts, string_agg(part, E'\\n\\n' ORDER BY pos) AS text FROM t WHERE total <= 6000 GROUP BY session""")
def episode_text(spark, d):
    return chunk.episode_text(_messages(spark, d))


@query()
def section_chunks(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("stem"), F.col("text").alias("content"))
    return chunk.chunked(docs)


@query("SELECT n, CASE WHEN n > 18000 THEN 0.3 + 0.7 * pow(least((n - 18000) / 7000.0, 1.0), 3) ELSE 0.0 END AS threshold FROM (SELECT l_partkey * 13 AS n FROM (SELECT DISTINCT l_partkey FROM lineitem))".replace("0.3 + 0.7 * pow", "round(0.3 + 0.7 * pow").replace(", 3) ELSE", ", 3), 6) ELSE"))
def corpus_barrier(spark, d):
    n = table(spark, d, "lineitem").select((F.col("l_partkey") * 13).alias("n")).distinct()
    return n.select("n", F.round(text.barrier_threshold(F.col("n")), 6).alias("threshold"))


@query(f"{M} SELECT id, salience < 0.40 AS low_trust FROM memories WHERE salience IS NULL OR salience >= 0.5")
def min_salience(spark, d):
    return memories(spark, d).filter("salience is null or salience >= 0.5").select("id", (F.col("salience") < 0.40).alias("low_trust"))


@query(f"{M}, s AS (SELECT id, session_id, ts, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, id) AS pos FROM memories WHERE type = 'project_context') SELECT session_id, pos, id FROM s WHERE pos <= 3")
def session_summaries(spark, d):
    w = Window.partitionBy("session_id").orderBy(F.desc("ts"), "id")
    return memories(spark, d).filter("type = 'project_context'").select("session_id", F.row_number().over(w).alias("pos"), "id").filter("pos <= 3")


@query(f"{M}, f AS (SELECT id, row_number() OVER (PARTITION BY substr(content, 1, 80) ORDER BY id) AS k FROM memories) SELECT id FROM f WHERE k = 1")
def first_by_prefix(spark, d):
    w = Window.partitionBy(F.substring("content", 1, 80)).orderBy("id")
    return memories(spark, d).withColumn("k", F.row_number().over(w)).filter("k = 1").select("id")


@query(f"{M} SELECT project, count(*) AS n, round(avg(salience), 6) AS mean_salience, round(quantile_cont(CAST(length(content) AS DOUBLE), 0.9), 6) AS p90_chars, count(*) FILTER (WHERE length(content) >= 4000) AS long_ones FROM memories GROUP BY project")
def project_profile(spark, d):
    n = F.length("content")
    return memories(spark, d).groupBy("project").agg(
        F.count("*").alias("n"), F.round(F.avg("salience"), 6).alias("mean_salience"), F.round(F.percentile(n.cast("double"), F.lit(0.9)), 6).alias("p90_chars"), F.sum((n >= 4000).cast("long")).alias("long_ones")
    )


@query("SELECT event_type, round(corr(value, CAST(json_extract(props, '$.k') AS DOUBLE)), 6) AS r, count(*) AS n FROM events GROUP BY event_type")
def pearson(spark, d):
    k = F.get_json_object("props", "$.k").cast("double")
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.corr("value", k), 6).alias("r"), F.count("*").alias("n"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY 1, 2")
def hourly_events(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.window("ts", "1 hour")["start"].cast("timestamp_ntz").alias("hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM s GROUP BY user_id, k""")
def activity_sessions(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    g = e.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.min("ts").cast("timestamp_ntz").alias("first_ts"), F.max("ts").cast("timestamp_ntz").alias("last_ts"), F.count("*").alias("n"))
    return g.select("user_id", "first_ts", "last_ts", "n")


@query(f"{M} SELECT 'lorekeep_memories{{kind=\"' || type || '\"}} ' || count(*) AS line FROM memories GROUP BY type")
def prometheus_lines(spark, d):
    from ..sources.files import prometheus

    return prometheus(memories(spark, d).groupBy(F.col("type").alias("label")).agg(F.count("*").alias("value")).withColumn("metric", F.lit("memories")))


@query(f"{M} SELECT id, type FROM (SELECT id, type, row_number() OVER (PARTITION BY type ORDER BY md5(id || ':42'), id) AS r, count(*) OVER (PARTITION BY type) AS n FROM memories) WHERE r <= greatest(1, round(n * 0.1::DOUBLE))")
def stratified_sample(spark, d):
    from ..operators.evalir import stratified_sample as sample

    return sample(memories(spark, d).select("id", "type"), "type", 0.1)


@query()
def mock_embeddings(spark, d):
    from ..functions.embed import HashEmbedder, embedded

    return embedded(memories(spark, d).select("id", "content"), HashEmbedder(16)).select("id", "vector")


@query("""SELECT event_id, sha256('{"a": "\\u00e9", "props": {"k": ' || json_extract_string(props, '$.k') || '}, "user": ' || user_id || '}') AS key FROM events""")
def spool_keys(spark, d):
    from ..streaming.flows import spool_key

    payload = F.concat(F.lit('{"user":'), "user_id", F.lit(',"props" : '), "props", F.lit(', "a":"é"}'))
    return table(spark, d, "events").select("event_id", spool_key(payload).alias("key"))
