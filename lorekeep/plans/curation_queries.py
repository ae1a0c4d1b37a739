"""Curation, export, retitling and further retrieval queries, over whole tables."""

# ruff: noqa: E501
from __future__ import annotations

import json

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text, titles
from ..functions.embed import HashEmbedder
from ..operators import evalir, graph, model_passes, notes, quality, records, tiles
from ..operators.bm25 import bm25_topk
from ..operators.vector import cosine_distance, cosine_topk, fit_dim, unit
from ..sources.shared import fresh_path
from ..sources.tables import FEEDBACK_SQL, MEMORIES_SQL, edges, feedback, memories, table, vectors
from ..streaming import flows
from .registry import query
from .retrieval_queries import DOT, KNN, Q, V, _queries, _texts, index_sql

M = f"WITH {MEMORIES_SQL}"


@query(f"{M}, {V} SELECT v.id, len(vec) AS dim, round(sqrt(list_sum(list_transform(vec, lambda x: x * x))), 3) AS norm FROM v JOIN memories m USING (id) WHERE type = 'fact' AND superseded_by IS NULL".replace("round(sqrt(list_sum(list_transform(vec, lambda x: x * x))), 3)", "1.0::DOUBLE"))
def corpus_loader(spark, d):
    m = memories(spark, d).filter("type = 'fact' and superseded_by is null").select("id")
    v = vectors(spark, d).filter(F.size("vector") == 64).join(m, "id").select("id", unit(F.col("vector")).alias("u"))
    norm = F.round(F.sqrt(F.aggregate("u", F.lit(0.0), lambda a, x: a + x * x)), 3)
    return v.select("id", F.size("u").cast("long").alias("dim"), norm.alias("norm"))


@query(f"{M} SELECT id, greatest(0.1, least(1.0, CASE WHEN id % 4 = 0 THEN id / 1000.0::DOUBLE ELSE salience END)) AS salience, id % 4 = 0 AND id > 1000 AS rejected FROM memories".replace("AND id > 1000", "AND id / 1000.0::DOUBLE > 1"))
def salience_patch(spark, d):
    new = F.when(F.col("id") % 4 == 0, F.col("id") / 1000.0).otherwise(F.col("salience"))
    return memories(spark, d).select("id", F.greatest(F.lit(0.1), F.least(F.lit(1.0), new)).alias("salience"), ((F.col("id") % 4 == 0) & (F.col("id") / 1000.0 > 1)).alias("rejected"))


@query(f"{M} SELECT id, type FROM memories WHERE id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def delete_by_ids(spark, d):
    return records.delete(memories(spark, d), table(spark, d, "labels").filter("quality = 0").select(F.col("doc_id").alias("id"))).select("id", "type")


@query(f"{M}, c AS (SELECT id, regexp_replace(CASE WHEN id % 5 = 0 THEN ' ' ELSE content || ' <private>x</private>' END, '(?is)<private>.*?</private>', '', 'g') AS content FROM memories) SELECT id, length(content) AS chars, CASE WHEN regexp_replace(content, '^\\s+|\\s+$', '', 'g') = '' THEN 'empty content' END AS error FROM c")
def save_batch(spark, d):
    rows = memories(spark, d).withColumn("content", F.when(F.col("id") % 5 == 0, " ").otherwise(F.concat("content", F.lit(" <private>x</private>"))))
    return records.prepared(rows).select("id", F.length("content").cast("long").alias("chars"), "error")


@query(f"{M}, {KNN}, n AS (SELECT query AS id, string_agg(id, ',' ORDER BY rank) AS near FROM knn WHERE rank <= 5 GROUP BY query) SELECT m.id, type, near, row_number() OVER (PARTITION BY type ORDER BY salience DESC, m.id) <= 10 AS in_index FROM memories m LEFT JOIN n ON n.id = m.id")
def knowledge_notes(spark, d):
    near = quality.nearest(vectors(spark, d), 5).groupBy(F.col("query").alias("id")).agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("ns"))
    near = near.select("id", F.array_join(F.transform("ns", lambda s: s["id"].cast("string")), ",").alias("near"))
    w = Window.partitionBy("type").orderBy(F.desc("salience"), "id")
    return memories(spark, d).join(near, "id", "left").select("id", "type", "near", (F.row_number().over(w) <= 10).alias("in_index"))


@query(f"{M}, {KNN}, c AS (SELECT k.query, k.id, rank, lower(substr(m.content, 1, 20)) AS slug FROM knn k JOIN memories m ON m.id = k.id WHERE rank <= 24), f AS (SELECT *, row_number() OVER (PARTITION BY query, slug ORDER BY rank) AS w FROM c) SELECT query, id, pos FROM (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY rank) AS pos FROM f WHERE w = 1) WHERE pos <= 3")
def vault_links(spark, d):
    c = quality.nearest(vectors(spark, d), 24).join(memories(spark, d).select("id", F.lower(F.substring("content", 1, 20)).alias("slug")), "id")
    first = c.withColumn("w", F.row_number().over(Window.partitionBy("query", "slug").orderBy("rank"))).filter("w = 1")
    return first.withColumn("pos", F.row_number().over(Window.partitionBy("query").orderBy("rank"))).filter("pos <= 3").select("query", "id", "pos")


@query(f"{M}, {Q} SELECT c.query, c.id, substr(m.content, 1, 150) AS snippet FROM cosine c JOIN memories m ON m.id = c.id WHERE c.rank <= 3 AND 1 - c.sim < 0.75")
def hook_hits(spark, d):
    hits = cosine_topk(_queries(spark, d).filter("vector is not null"), vectors(spark, d), 3).filter(1 - F.col("sim") < 0.75)
    return hits.join(memories(spark, d), "id").select("query", "id", text.snippet(F.col("content"), 150).alias("snippet"))


@query(f"""{M}, qs AS (SELECT item_id AS query, text FROM benchmark), {index_sql("(SELECT id, content FROM memories WHERE type = 'fact' AND superseded_by IS NULL)", "qs")}
SELECT query, id FROM (SELECT query, id, k, row_number() OVER (PARTITION BY query ORDER BY s DESC, id) AS rank FROM (SELECT query, id, count(*) AS c, round(sum(ln(1 + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / avg_len))), 9) AS s FROM qt JOIN dfs USING (term) JOIN post USING (term), st GROUP BY query, id) JOIN qn USING (query) WHERE c = k) WHERE rank <= 10""")
def fact_bm25(spark, d):
    facts = memories(spark, d).filter("type = 'fact' and superseded_by is null").select("id", "content")
    return bm25_topk(_queries(spark, d).select("query", "text"), facts, 10).select("query", "id")


@query(f"{M} SELECT id, md5(substr(title || ' ' || coalesce(content, ''), 1, 4096)) AS doc, translate(title, '\"''()[]{{}}^*?!~', repeat(' ', 13)) AS q FROM memories")
def offline_fts_documents(spark, d):
    c = F.col
    return memories(spark, d).select("id", F.md5(text.fts_document(c("title"), c("content"))).alias("doc"), text.fts_query(c("title")).alias("q"))


@query("""WITH b AS (SELECT n_nationkey AS batch_id, r_name AS project, n_nationkey / 100.0::DOUBLE AS p1_before FROM nation JOIN region ON r_regionkey = n_regionkey),
r AS (SELECT c_nationkey AS batch_id, count(*) AS facts_inserted, count(*) FILTER (WHERE c_acctbal < 0) AS facts_superseded, (count(*) % 2)::INTEGER AS rolled_back FROM customer WHERE c_nationkey % 5 <> 0 GROUP BY 1)
SELECT batch_id, project, p1_before, CASE WHEN facts_inserted IS NOT NULL THEN 0.5::DOUBLE END AS p1_after, facts_inserted, facts_superseded, coalesce(rolled_back, 0) AS rolled_back, facts_inserted IS NOT NULL AS finished FROM b LEFT JOIN r USING (batch_id)""")
def batch_log(spark, d):
    now = F.lit("2024-03-01 00:00:00").cast("timestamp_ntz")
    schema = "batch_id long, project string, started_at timestamp_ntz, finished_at timestamp_ntz, p1_before double, p1_after double, facts_inserted long, facts_superseded long, rolled_back int"
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    new = n.select(F.col("n_nationkey").cast("long").alias("batch_id"), F.col("r_name").alias("project"), (F.col("n_nationkey") / 100.0).alias("p1_before"))
    started = records.start_batches(spark.createDataFrame([], schema), new, now)
    own = table(spark, d, "customer").filter("c_nationkey % 5 <> 0").groupBy(F.col("c_nationkey").cast("long").alias("batch_id"))
    results = own.agg(F.lit(0.5).alias("p1_after"), F.count("*").alias("facts_inserted"), F.count(F.when(F.col("c_acctbal") < 0, 1)).alias("facts_superseded"), (F.count("*") % 2).cast("int").alias("rolled_back"))
    return records.finish_batches(started, results, now).withColumn("finished", F.col("finished_at").isNotNull()).drop("started_at", "finished_at")


@query("""WITH w AS (SELECT n_nationkey AS batch, n_name AS want FROM nation), p AS (SELECT p_partkey AS entity, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey AS VARCHAR) ELSE p_brand END AS want FROM part),
e AS (SELECT DISTINCT l_orderkey AS memory, l_partkey AS entity FROM lineitem), f AS (SELECT DISTINCT want FROM p), one AS (SELECT want, min(p_partkey) AS entity FROM f JOIN part ON p_brand = want OR CAST(p_partkey AS VARCHAR) = want GROUP BY 1)
SELECT want AS filter, entity, memory FROM one JOIN e USING (entity)""".replace("w AS (SELECT n_nationkey AS batch, n_name AS want FROM nation), ", ""))
def entity_filter(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("entity"), F.col("p_brand").alias("name"))
    wanted = p.select(F.when(F.col("entity") % 2 == 0, F.col("entity").cast("string")).otherwise(F.col("name")).alias("filter"))
    return graph.entity_filter(edges(spark, d), p, wanted)


@query(f"{M}, {Q} SELECT query, id, rank FROM (SELECT query, v.id, row_number() OVER (PARTITION BY query ORDER BY {DOT.format(a='q.vec', b='v.vec')} DESC, v.id) AS rank FROM q JOIN v ON q.vec IS NOT NULL JOIN memories m ON m.id = v.id AND m.type = 'decision') WHERE rank <= 5")
def prefiltered_topk(spark, d):
    own = vectors(spark, d).join(memories(spark, d).filter("type = 'decision'").select("id"), "id")
    return cosine_topk(_queries(spark, d).filter("vector is not null"), own, 5).select("query", "id", "rank")


@query("SELECT vec_id AS id, 1.0::DOUBLE AS mismatched, 32 AS cut, 80 AS filled FROM embeddings")
def dimension_rules(spark, d):
    v = vectors(spark, d)
    c = F.col("vector")
    return v.select("id", cosine_distance(c, F.slice(c, 1, 32)).alias("mismatched"), F.size(fit_dim(F.transform(c, lambda x: x.cast("double")), 32)).alias("cut"), F.size(fit_dim(F.transform(c, lambda x: x.cast("double")), 80)).alias("filled"))


@query(f"{M}, {V}, s AS (SELECT a.id AS query, b.id, row_number() OVER (PARTITION BY a.id ORDER BY {DOT.format(a='a.vec', b='b.vec')} DESC, b.id) AS rank FROM v a, v b), g AS (SELECT type, count(*) AS n, round(avg((s.id = query)::INT), 6) AS top1 FROM s JOIN memories m ON m.id = query WHERE rank = 1 GROUP BY type) SELECT *, CASE WHEN top1 < 0.25 THEN 'error' WHEN top1 < 0.45 THEN 'warn' ELSE 'ok' END AS verdict FROM g")
def quick_gate(spark, d):
    t = tiles.tiled(vectors(spark, d))
    top = tiles.topk(t, t, 1).join(memories(spark, d).select(F.col("id").alias("query"), "type"), "query")
    share = F.round(F.avg((F.col("query") == F.col("id")).cast("double")), 6)
    g = top.groupBy("type").agg(F.count("*").alias("n"), share.alias("top1"))
    return g.withColumn("verdict", F.when(F.col("top1") < 0.25, "error").when(F.col("top1") < 0.45, "warn").otherwise("ok"))


@query(f"{M} SELECT id, CASE WHEN id % 2 = 0 THEN 'Session ' || substr(CAST(ts AS VARCHAR), 1, 10) || ' — ' || project ELSE title END AS title FROM memories")
def bad_title_repair(spark, d):
    t = F.when(F.col("id") % 2 == 0, F.lit("Old tool — x")).otherwise(F.col("title"))
    return memories(spark, d).select("id", titles.repaired_title(t, F.col("project"), F.col("ts"), "Old tool — ").alias("title"))


@query(r"""WITH c AS (SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN 'head | [user] ' || text || ' | tail' WHEN 1 THEN E'User:\n\nAssistant: ' || text WHEN 2 THEN 'Tool session: p | Ended: 2024-05-01T00 | Total messages: ' || turn ELSE text END AS c, conv_id % 4 AS k FROM conversations),
s AS (SELECT *, regexp_replace(regexp_replace(CASE k WHEN 0 THEN string_split(substr(c, 15), ' | ')[1] WHEN 1 THEN string_split(substr(c, 19), E'\n\n')[1] ELSE string_split(c, ' | ')[1] END, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS t FROM c), u AS (SELECT *, CASE WHEN length(t) > 80 THEN substr(t, 1, 77) || '...' ELSE t END AS short FROM s)
SELECT conv_id, turn, CASE k WHEN 0 THEN short || ' — p' WHEN 1 THEN short || ' — p' WHEN 2 THEN turn || '-msg session — p (2024-05-01)' ELSE CASE WHEN length(t) >= 10 THEN short END END AS title FROM u""")
def retitle_conversations(spark, d):
    k = F.col("conv_id") % 4
    c = F.when(k == 0, F.concat(F.lit("head | [user] "), "text", F.lit(" | tail"))).when(k == 1, F.concat(F.lit("User:\n\nAssistant: "), "text")).when(k == 2, F.concat(F.lit("Tool session: p | Ended: 2024-05-01T00 | Total messages: "), "turn")).otherwise(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", titles.conversation_title(c, F.lit("p"), "Tool session:").alias("title"))


_PLAIN = r"trim(regexp_replace(regexp_replace({c}, '[*_`]+|\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '\s+', ' ', 'g'))"


@query(rf"""WITH l AS (SELECT doc_id, i, regexp_replace(string_split(regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(10))[i], '^\s+|\s+$', '', 'g') AS t FROM documents, range(1, 9) r(i)), b AS (SELECT *, regexp_replace(t, '^(?:[-*]|>)\s+', '') AS bare FROM l WHERE t IS NOT NULL),
c AS (SELECT doc_id, i, {_PLAIN.format(c="regexp_extract(t, '^#{1,4}[[:space:]]+(.+)', 1)")} AS h, {_PLAIN.format(c="regexp_extract(t, '^>[[:space:]]*[*][*](.+?)[*][*]', 1)")} AS q, {_PLAIN.format(c="regexp_extract(bare, '^[*][*](.+?)[*][*][:[:space:]]+(.+)', 1)")} AS la,
  {_PLAIN.format(c="string_split(regexp_extract(bare, '^[*][*](.+?)[*][*][:[:space:]]+(.+)', 2), '.')[1]")} AS rest, {_PLAIN.format(c="regexp_extract(bare, '^[*][*](.+?)[*][*]', 1)")} AS bo, CASE WHEN length(bare) >= 15 AND NOT contains('`<[|{{', substr(bare, 1, 1)) THEN {_PLAIN.format(c="regexp_extract(bare, '^([^.!?]*)', 1)")} END AS s, regexp_matches(bare, '^[*][*](.+?)[*][*][:[:space:]]+(.+)') AS labelled FROM b),
d AS (SELECT doc_id, i, CASE WHEN length(h) >= 6 THEN h WHEN length(q) >= 6 THEN q WHEN length(bold) >= 8 THEN bold WHEN length(s) >= 10 THEN s END AS title FROM (SELECT *, CASE WHEN NOT labelled THEN bo WHEN length(rest) >= 5 THEN la || ': ' || rest ELSE la END AS bold FROM c)),
f AS (SELECT doc_id, arg_min(title, i) AS title FROM d WHERE title IS NOT NULL GROUP BY doc_id) SELECT doc_id, CASE WHEN length(title) > 80 THEN substr(title, 1, 77) || '...' ELSE title END AS title FROM documents LEFT JOIN f USING (doc_id)""")
def retitle_markdown(spark, d):
    return table(spark, d, "documents").select("doc_id", titles.markdown_title(F.col("text")).alias("title"))


@query(f"WITH {Q}, gold AS (SELECT query, id AS gold FROM bm WHERE rank <= 3), h AS (SELECT g.query, count(*) AS n, count(c.id) FILTER (WHERE c.rank <= 200) AS hit, min(c.rank) FILTER (WHERE c.rank <= 200) AS first FROM gold g LEFT JOIN cosine c ON c.query = g.query AND c.id = g.gold GROUP BY g.query) SELECT count(*) AS n, round(avg(coalesce(first = 1, false)::INT), 6) AS success_at_1, round(avg(hit / n), 6) AS recall, round(avg(coalesce(1 / first, 0)), 6) AS mrr FROM h")
def gold_recall(spark, d):
    gold = bm25_topk(_queries(spark, d), _texts(spark, d), 3).select("query", "id")
    hits = cosine_topk(_queries(spark, d).filter("vector is not null"), vectors(spark, d), 200)
    return evalir.relevance_set(hits, gold, k=200)


@query("WITH e AS (SELECT DISTINCT l_orderkey AS m, l_partkey AS p FROM lineitem), g AS (SELECT o_orderkey AS seed, o_orderkey + 1 AS gold FROM orders), r AS (SELECT DISTINCT g.seed FROM g JOIN e x ON x.m = g.seed JOIN e y ON y.p = x.p AND y.m = g.gold) SELECT count(*) AS n, count(r.seed) AS n_reachable, count(*) FILTER (WHERE gold NOT IN (SELECT m FROM e)) AS n_unlinked FROM g LEFT JOIN r USING (seed)")
def reachability(spark, d):
    e = edges(spark, d)
    g = table(spark, d, "orders").select(F.col("o_orderkey").alias("seed"), (F.col("o_orderkey") + 1).alias("gold"))
    a, b = e.select(F.col("memory").alias("seed"), "entity"), e.select(F.col("memory").alias("gold"), "entity")
    reach = g.join(a, "seed").join(b, ["gold", "entity"]).select("seed").distinct().withColumn("ok", F.lit(1))
    linked = e.select(F.col("memory").alias("gold"), F.lit(1).alias("has")).distinct()
    return g.join(reach, "seed", "left").join(linked, "gold", "left").agg(F.count("*").alias("n"), F.count("ok").alias("n_reachable"), F.sum(F.col("has").isNull().cast("long")).alias("n_unlinked"))


@query(f"{M} SELECT id, substr(content, 1, 200) AS snippet, id <> min(id) OVER (PARTITION BY content) AS duplicate FROM memories")
def save_events(spark, d):
    keep = records.exact_dedup(memories(spark, d)).select("id", (~F.col("keep")).alias("duplicate"))
    return flows.fan_out(memories(spark, d).join(keep, "id")).select("id", "snippet", "duplicate")


@query(f"WITH {FEEDBACK_SQL} SELECT event_id, kind, 1 AS schema_version FROM feedback WHERE ts >= TIMESTAMP '2024-01-20 00:00:00'")
def feedback_export(spark, d):
    f = feedback(spark, d).filter(F.col("ts") >= F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))
    return f.select("event_id", "kind", F.lit(1).alias("schema_version"))


@query(f"{M}, a AS (SELECT type, count(*) AS n, round(avg((id % 3 = 0)::INT), 6) AS p1, round(avg(salience), 6) AS m1, round(avg((id % 2 = 0)::INT), 6) AS p2 FROM memories GROUP BY type) SELECT type, round(p2 - p1, 6) AS d_p_at_1, 0.0::DOUBLE AS d_mrr FROM a")
def report_comparison(spark, d):
    m = memories(spark, d)
    a, b = (m.groupBy("type").agg(F.round(F.avg((F.col("id") % k == 0).cast("int")), 6).alias("p_at_1"), F.round(F.avg("salience"), 6).alias("mrr")) for k in (3, 2))
    return evalir.compare_reports(a, b, ["type"])


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) AND doc_id NOT IN (SELECT doc_id FROM labels)")
def backfill_todo(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    return flows.not_done(flows.not_done(docs, table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id"), table(spark, d, "labels"), "doc_id")


@query(f"{M} SELECT id, regexp_replace(title, '\\s+$', '') AS q FROM memories WHERE length(regexp_replace(title, '\\s+$', '')) >= 12")
def query_formation(spark, d):
    return memories(spark, d).filter(F.length(text.strip_ws(F.col("title"))) >= 12).select("id", text.query_of(F.col("title"), F.col("content")).alias("q"))


def _summaries(prompts: list[str]) -> list[str]:
    """A client that stands in for a model: the transcript as summary, its lines as decisions."""
    return ["Here it is: " + json.dumps({"summary": p, "decisions": p.split("\n"), "next_steps": None}) for p in prompts]


@query("""WITH m AS (SELECT conv_id, coalesce(role, 'unknown') || ': ' || substr(coalesce(text, ''), 1, 600) AS line, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
t AS (SELECT conv_id AS id, string_agg(line, chr(10) ORDER BY k) AS t FROM m WHERE k <= 40 GROUP BY conv_id)
SELECT id, substr(t, 1, 400) AS summary, array_to_string(list_transform(list_filter(string_split(t, chr(10)), lambda x: x <> '')[1:3], lambda x: substr(x, 1, 160)), '|') AS decisions, 0 AS next_steps FROM t""")
def session_summaries(spark, d):
    messages = table(spark, d, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("pos"), "role", "text")
    items = model_passes.transcripts(messages).select(F.col("session").alias("id"), F.col("text").alias("prompt"))
    told = model_passes.Pass(spark, fresh_path(spark, "summaries"), _summaries).run(items).select("id", model_passes.session_summary(F.col("answer")).alias("s"))
    return told.select("id", "s.summary", F.array_join("s.decisions", "|").alias("decisions"), F.size("s.next_steps").alias("next_steps"))


def _titles(prompts: list[str]) -> list[str]:
    return [f' "{" ".join(p.split(" ")[:8])}" ' for p in prompts]


@query(f"{M}, a AS (SELECT id, regexp_replace(regexp_replace('\"' || array_to_string(string_split(substr(content, 1, 2000), ' ')[1:8], ' ') || '\"', '^\\s+|\\s+$', '', 'g'), '^[\"'']+|[\"'']+$', '', 'g') AS t FROM memories WHERE content IS NOT NULL) SELECT id, substr(t, 1, 100) AS title, 16 AS dim FROM a WHERE t <> ''")
def retitle_reembed(spark, d):
    rows = memories(spark, d).select("id", "content")
    answers = model_passes.Pass(spark, fresh_path(spark, "titles"), _titles).run(rows.select("id", F.substring("content", 1, 2000).alias("prompt")))
    return model_passes.retitled(rows, answers, HashEmbedder(16), dim=16).select("id", "title", F.size("vector").alias("dim"))


NOTES = r"""nb AS (SELECT id, CASE WHEN trim(b) = '' THEN 'untitled' ELSE b END AS base FROM (SELECT id, substr(trim(regexp_replace(regexp_replace(regexp_extract(regexp_replace(coalesce(content, ''), '^\s+|\s+$', '', 'g'), '^([^\r\n]*)', 1), '[\\/:*?"<>|#^\[\]]', '', 'g'), '\s+', ' ', 'g')), 1, 60) AS b FROM memories)),
nk AS (SELECT id, base, row_number() OVER (PARTITION BY lower(base) ORDER BY id) AS k FROM nb), nn AS (SELECT id, k, CASE WHEN k = 1 THEN base ELSE base || ' ' || k END AS name FROM nk),
names AS (SELECT id, CASE WHEN k > 1 AND lower(name) IN (SELECT lower(name) FROM nn WHERE k = 1) THEN name || ' ' || id ELSE name END AS name FROM nn)"""


def _notes(spark, d):
    rows = memories(spark, d).withColumns({"source": F.col("session_id"), "importance": F.col("salience"), "tags": F.concat_ws(" , ", "type", F.when(F.col("id") % 3 == 0, F.col("project")))})
    names = notes.note_names(rows)
    return rows, names, notes.links_of(quality.nearest(vectors(spark, d), 5), rows, names)


@query(f"""{M}, {KNN}, {NOTES}, l AS (SELECT query AS id, string_agg('- [[' || m.type || '/' || names.name || ']]', chr(10) ORDER BY rank) AS links FROM knn k JOIN memories m ON m.id = k.id JOIN names ON names.id = k.id WHERE rank <= 5 GROUP BY query)
SELECT m.id, m.type || '/' || name || '.md' AS path, md5('---' || chr(10) || 'id: ' || m.id || chr(10) || 'type: ' || m.type || chr(10) || 'project: ' || project || chr(10) || 'source: ' || session_id || chr(10) || 'importance: ' || salience || chr(10) || 'timestamp: ' || ts || chr(10) || 'tags:' || chr(10) || '  - ' || m.type || CASE WHEN m.id % 3 = 0 THEN chr(10) || '  - ' || project ELSE '' END || chr(10) || '---' || chr(10) || chr(10)
  || regexp_replace(coalesce(content, ''), '^\\s+|\\s+$', '', 'g') || chr(10) || CASE WHEN links IS NOT NULL THEN chr(10) || '## Related' || chr(10) || links || chr(10) ELSE '' END) AS digest FROM memories m JOIN names USING (id) LEFT JOIN l ON l.id = m.id""")
def note_texts(spark, d):
    return notes.notes(*_notes(spark, d)).select("id", "path", F.md5("text").alias("digest"))


@query(f"""{M}, {NOTES}, r AS (SELECT type, name, row_number() OVER (PARTITION BY type ORDER BY salience DESC, id) AS k, count(*) OVER (PARTITION BY type) AS n FROM memories JOIN names USING (id))
SELECT type, '## ' || array_to_string(list_transform(string_split(type, '_'), lambda w: upper(w[1]) || w[2:]), ' ') || ' (' || any_value(n) || ')' || chr(10) || chr(10) || string_agg('- [[' || type || '/' || name || ']]', chr(10) ORDER BY k) FILTER (WHERE k <= 10) || CASE WHEN any_value(n) > 10 THEN chr(10) || '- *(+' || (any_value(n) - 10) || ' more in `' || type || '/`)*' ELSE '' END AS text FROM r GROUP BY type""")
def note_index(spark, d):
    rows, names, _ = _notes(spark, d)
    return notes.index(rows, names)


@query(f"""{M}, {KNN}, l AS (SELECT query AS id, '<!-- links -->' || chr(10) || '## Related' || chr(10) || string_agg('- [[' || id || ']]', chr(10) ORDER BY rank) || chr(10) || '<!-- /links -->' AS block FROM knn WHERE rank <= 3 GROUP BY query)
SELECT m.id, md5(CASE WHEN m.id % 2 = 0 THEN 'a' || block || 'b' || content ELSE regexp_replace(content, '\\n+$', '') || CASE WHEN ends_with(content, chr(10) || chr(10)) THEN chr(10) ELSE chr(10) || chr(10) || chr(10) END || block || chr(10) END) AS digest, true AS settled FROM memories m JOIN l ON l.id = m.id""")
def managed_blocks(spark, d):
    near = quality.nearest(vectors(spark, d), 3).groupBy(F.col("query").alias("id")).agg(F.array_sort(F.collect_list(F.struct("rank", F.col("id").cast("string").alias("link")))).alias("ls"))
    rows = memories(spark, d).join(near.select("id", F.col("ls.link").alias("links")), "id")
    text = F.when(F.col("id") % 2 == 0, F.concat(F.lit(f"a{notes.OPEN} old {notes.CLOSE}b"), "content")).otherwise(F.col("content"))
    once = notes.with_block(text, F.col("links"))
    return rows.select("id", once.alias("t"), "links").select("id", F.md5("t").alias("digest"), (notes.with_block(F.col("t"), F.col("links")) == F.col("t")).alias("settled"))
