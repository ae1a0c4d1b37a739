"""Retrieval, corpus quality, evaluation and state transitions, over whole tables."""

# ruff: noqa: E501
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..functions.stem import porter_sql
from ..operators import evalir, facts, gold, quality, search, tiles
from ..operators.bm25 import bm25_topk
from ..operators.components import connected_components
from ..operators.index import VectorIndex
from ..operators.vector import cosine_topk, mean_centered
from ..sources.shared import fresh_path
from ..sources.tables import MEMORIES_SQL, edges, memories, table, vectors
from ..streaming import flows
from ..streaming.saves import BATCH_ITEMS, RecordStore
from .registry import query

#: Thresholds that select pairs of the supplied vectors.
NEAR, SUPPORT, DUPLICATE = 0.40, 0.30, 0.45
NOW = "2024-03-01 00:00:00"

DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"
V = "v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS vec FROM embeddings WHERE embedding IS NOT NULL)"
#: Words of the index, in lower case (ASCII only), and of a query: its tokens cut the same way.
WORDS = r"list_filter(string_split_regex(translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda t: t <> '')"
TOKENS = r"list_filter(string_split(regexp_replace(coalesce({c}, ''), '[^\p{{L}}\p{{N}}''-]+', ' ', 'g'), ' '), lambda t: octet_length(encode(t)) >= 2)"
PAIRS = f"{V}, sims AS (SELECT a.id AS query, b.id, {DOT.format(a='a.vec', b='b.vec')} AS sim FROM v a JOIN v b ON a.id <> b.id)"
KNN = f"{PAIRS}, knn AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, id) AS rank FROM sims)"
SUPPORT_SQL = f"{KNN}, sup AS (SELECT query AS id, round(avg(round(sim, 9)), 6) AS support FROM knn WHERE rank <= 10 GROUP BY query)"


def index_sql(docs: str, queries: str) -> str:
    """CTEs of the postings of stems (post), of query stems (qt) and their numbers (qn, dfs), and of statistics (st)."""
    return f"""tok AS (SELECT id, {WORDS.format(c="coalesce(content, '')")} AS ws FROM {docs}), st AS (SELECT count(*) AS n_docs, avg(len(ws)) AS avg_len FROM tok),
wd AS (SELECT id, len(ws) AS n, unnest(ws) AS term FROM tok), qwd AS (SELECT DISTINCT query, unnest({WORDS.format(c=f"array_to_string({TOKENS.format(c='text')}, ' ')")}) AS term FROM {queries}),
every AS (SELECT term FROM wd UNION SELECT term FROM qwd), {porter_sql("every", "stems")},
post AS (SELECT stem AS term, id, any_value(n) AS n, count(*) AS tf FROM wd JOIN stems USING (term) GROUP BY stem, id),
qt AS (SELECT DISTINCT query, stem AS term FROM qwd JOIN stems USING (term)), qn AS (SELECT query, count(*) AS k FROM qt GROUP BY query),
dfs AS (SELECT term, count(*) AS df FROM post WHERE term IN (SELECT term FROM qt) GROUP BY term)"""


#: Queries: benchmark passages with the vector of the same number.
Q = f"""{V}, q AS (SELECT item_id AS query, text, vec FROM benchmark LEFT JOIN v ON id = item_id),
cosine AS (SELECT * FROM (SELECT query, v.id, {DOT.format(a='q.vec', b='v.vec')} AS sim, row_number() OVER (PARTITION BY query ORDER BY {DOT.format(a='q.vec', b='v.vec')} DESC, v.id) AS rank FROM q JOIN v ON q.vec IS NOT NULL)),
{index_sql("(SELECT doc_id AS id, text AS content FROM documents)", "q")},
bm AS (SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM (
  SELECT query, id, round(sum(ln(1 + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / avg_len))), 9) AS score, count(*) AS c
  FROM qt JOIN dfs USING (term) JOIN post USING (term), st GROUP BY query, id) JOIN qn USING (query) WHERE c = k)"""
#: Candidates and scores of the hybrid search for n = 10.
HYBRID = f"""{MEMORIES_SQL}, {Q}, b AS (SELECT query, id, rank, CASE WHEN count(*) OVER (PARTITION BY query) <= 1 THEN 1.0 ELSE 1 - (rank - 1)::DOUBLE / (count(*) OVER (PARTITION BY query) - 1) END AS bm25 FROM bm WHERE rank <= 50),
cand AS (SELECT coalesce(c.query, b.query) AS query, coalesce(c.id, b.id) AS id, greatest(0, least(1, coalesce(c.sim, 0))) AS cos, c.rank AS rc, coalesce(b.bm25, 0) AS bm25, b.rank AS rb FROM (SELECT * FROM cosine WHERE rank <= 300) c FULL JOIN b ON b.query = c.query AND b.id = c.id),
scored AS (SELECT query, m.id, type, CASE WHEN rc IS NULL THEN 1 ELSE 1 - cos END AS distance, coalesce(rc, 1073741824) AS o1, coalesce(rb, 1073741824) AS o2,
  round(greatest(0.85, least(1.15, 1.0::DOUBLE + 0.3::DOUBLE * (salience - 0.5::DOUBLE))) * (0.85::DOUBLE + 0.15::DOUBLE * pow(0.5, greatest(0.0, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 86400000000.0::DOUBLE) / 730)) * (0.7::DOUBLE * cos + 0.3::DOUBLE * bm25), 9) AS score
  FROM cand JOIN memories m USING (id) WHERE superseded_by IS NULL)"""
CUT = "SELECT query, id, round(distance, 6) AS distance, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, o1, o2, id) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query, type ORDER BY score DESC, o1, o2, id) AS k FROM {t}) WHERE k <= 4) WHERE rank <= 10"


def _queries(spark, d):
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("query"), "text")
    return b.join(vectors(spark, d).withColumnRenamed("id", "query"), "query", "left")


def _texts(spark, d):
    """Texts alone, without the joins of the record view."""
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))


def _now():
    return F.lit(NOW).cast("timestamp")


def _cos(spark, d, k):
    return cosine_topk(_queries(spark, d).filter("vector is not null"), vectors(spark, d), k)


def _bm(spark, d, n):
    return bm25_topk(_queries(spark, d), _texts(spark, d), n)


def _self(spark, d):
    return vectors(spark, d).select(F.col("id").alias("query"), "vector")


@query(f"WITH {Q} SELECT query, id, round(sim, 6) AS sim, rank FROM cosine WHERE rank <= 10")
def vector_topk(spark, d):
    return _cos(spark, d, 10).select("query", "id", F.round("sim", 6).alias("sim"), "rank")


@query(f"WITH {Q} SELECT query, id, round(score, 6) AS score, rank FROM bm WHERE rank <= 50")
def bm25_search(spark, d):
    return _bm(spark, d, 50).select("query", "id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {Q} SELECT query, id, round(CASE WHEN count(*) OVER (PARTITION BY query) <= 1 THEN 1.0 ELSE 1 - (rank - 1)::DOUBLE / (count(*) OVER (PARTITION BY query) - 1) END, 6) AS bm25 FROM bm WHERE rank <= 50")
def bm25_rank_norm(spark, d):
    from pyspark.sql.window import Window

    n = F.count("*").over(Window.partitionBy("query"))
    return _bm(spark, d, 50).withColumn("n", n).select("query", "id", F.round(search.rank_norm(F.col("rank"), F.col("n")), 6).alias("bm25"))


@query(f"WITH {MEMORIES_SQL} SELECT id, round(0.85::DOUBLE + 0.15::DOUBLE * pow(0.5, greatest(0.0, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 86400000000.0::DOUBLE) / 730), 6) AS recency, round(greatest(0.85, least(1.15, 1.0::DOUBLE + 0.3::DOUBLE * (salience - 0.5::DOUBLE))), 6) AS trust FROM memories")
def recency_salience_weights(spark, d):
    return memories(spark, d).select("id", F.round(text.recency_weight(F.col("ts"), _now()), 6).alias("recency"), F.round(text.salience_weight(F.col("salience")), 6).alias("trust"))


@query(f"WITH {HYBRID} {CUT.format(t='scored')}")
def hybrid_search(spark, d):
    return search.hybrid_search(_queries(spark, d), memories(spark, d), vectors(spark, d), 10, _now(), texts=_texts(spark, d))


@query(f"""WITH {HYBRID}, edges AS (SELECT DISTINCT l_orderkey AS memory, l_partkey AS entity FROM lineitem), seeds AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, o1, o2, id) AS r FROM scored) WHERE r <= 5),
near AS (SELECT query, y.memory AS id, round(max(score) * 0.85::DOUBLE, 9) AS score FROM seeds JOIN edges x ON x.memory = seeds.id JOIN edges y ON y.entity = x.entity GROUP BY 1, 2),
new AS (SELECT * FROM (SELECT n.query, n.id, m.type, n.score, row_number() OVER (PARTITION BY n.query ORDER BY n.score DESC, n.id) AS r FROM near n JOIN memories m ON m.id = n.id LEFT JOIN scored s ON s.query = n.query AND s.id = n.id WHERE s.id IS NULL AND m.superseded_by IS NULL) WHERE r <= 10),
whole AS (SELECT query, id, type, distance, score, o1, o2 FROM scored UNION ALL SELECT query, id, type, 1.0, score, 1073741825, 1073741825 FROM new)
{CUT.format(t='whole')}""")
def graph_expand(spark, d):
    return search.hybrid_search(_queries(spark, d), memories(spark, d), vectors(spark, d), 10, _now(), edges=edges(spark, d), texts=_texts(spark, d))


@query(f"WITH {Q}, c AS (SELECT * FROM cosine WHERE rank <= 200), b AS (SELECT * FROM bm WHERE rank <= 200) SELECT coalesce(c.query, b.query) AS query, coalesce(c.id, b.id) AS id, round(1 / (60 + coalesce(c.rank, n_docs + 1))::DOUBLE + 1 / (60 + coalesce(b.rank, n_docs + 1))::DOUBLE, 9) AS rrf FROM c FULL JOIN b ON b.query = c.query AND b.id = c.id, st")
def rrf_fusion(spark, d):
    n = table(spark, d, "documents").count()
    return search.rrf_fusion(_cos(spark, d, 200), _bm(spark, d, 200), F.lit(n))


@query(f"WITH {Q}, c AS (SELECT * FROM cosine WHERE rank <= 200), b AS (SELECT * FROM bm WHERE rank <= 200) SELECT coalesce(c.query, b.query) AS query, coalesce(c.id, b.id) AS id, round(round(0.7::DOUBLE * coalesce((c.sim + 1) / 2, 0) + (1 - 0.7::DOUBLE) * CASE WHEN b.rank IS NULL THEN 0 ELSE 1 - (b.rank - 1)::DOUBLE / greatest(1, n_docs - 1) END, 9), 6) AS fused FROM c FULL JOIN b ON b.query = c.query AND b.id = c.id, st")
def alpha_fusion(spark, d):
    n = table(spark, d, "documents").count()
    return search.alpha_fusion(_cos(spark, d, 200), _bm(spark, d, 200), F.lit(n), F.lit(0.7)).withColumn("fused", F.round("fused", 6))


@query(f"""WITH {MEMORIES_SQL}, {Q}, b AS (SELECT query, (query % 5)::INTEGER AS p FROM q), h AS (SELECT c.query, c.id, m.type, c.rank, p FROM cosine c JOIN memories m USING (id) JOIN b USING (query) WHERE c.rank <= 100),
t AS (SELECT *, CASE WHEN p = 0 AND type = 'solution' THEN 1 WHEN p = 1 AND type = 'decision' THEN 1 WHEN p = 2 AND type = 'project_context' THEN 1 WHEN p = 3 AND type = 'fact' THEN 1 ELSE 0 END AS arm FROM h),
u AS (SELECT query, id, type, arm, k FROM (SELECT *, row_number() OVER (PARTITION BY query, arm ORDER BY rank) AS k FROM t WHERE arm > 0) WHERE k <= 5 UNION ALL SELECT query, id, type, 1048576, rank FROM h WHERE rank <= 10),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query, id ORDER BY arm, k) AS w FROM u) WHERE w = 1)
SELECT query, id, type, pos FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY arm, k) AS pos FROM f) WHERE pos <= 10""")
def template_search(spark, d):
    from .record_queries import _PHRASES

    q = _queries(spark, d).select("query", F.element_at(F.array(*map(F.lit, _PHRASES)), (F.col("query") % 5 + 1).cast("int")).alias("text"))
    hits = _cos(spark, d, 100).join(memories(spark, d).select("id", "type"), "id").select("query", "id", "type", "rank")
    return search.template_search(hits, q, 10)


@query(f"""WITH {MEMORIES_SQL}, {Q}, r AS (SELECT c.query, c.id, 1 - sim AS distance, c.rank AS pos, q.text, m.content, CASE WHEN c.id % 3 = 0 THEN 'vault/' ELSE 'other/' END AS path FROM cosine c JOIN q USING (query) JOIN memories m ON m.id = c.id WHERE c.rank <= 20),
a AS (SELECT query, id, pos, round(distance - CASE WHEN starts_with(path, 'vault/') THEN 0.12 ELSE 0 END + CASE WHEN len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) >= 12 AND len(list_filter(string_split_regex(content, '\\s+'), lambda w: w <> '')) BETWEEN 1 AND 39 THEN 0.08 ELSE 0 END, 6) AS adjusted FROM r)
SELECT query, id, adjusted, row_number() OVER (PARTITION BY query ORDER BY adjusted, pos) AS new_rank FROM a""")
def heuristic_rerank(spark, d):
    r = _cos(spark, d, 20).join(_queries(spark, d).select("query", "text"), "query").join(memories(spark, d).select("id", "content"), "id")
    rows = r.select("query", "id", (1 - F.col("sim")).alias("distance"), F.col("rank").alias("pos"), "text", "content", F.when(F.col("id") % 3 == 0, "vault/").otherwise("other/").alias("path"))
    return search.rerank(rows).select("query", "id", "adjusted", "new_rank")


@query(f"WITH {Q} SELECT query, coalesce(abs(lead(1 - sim) OVER (PARTITION BY query ORDER BY rank) - (1 - sim)) < 0.05, false) AS uncertain FROM cosine WHERE rank <= 2 QUALIFY rank = 1".replace("coalesce(abs(lead(1 - sim) OVER (PARTITION BY query ORDER BY rank) - (1 - sim)) < 0.05, false)", "coalesce(abs(lead(CASE WHEN 1 - sim = 0 THEN 1 ELSE 1 - sim END) OVER (PARTITION BY query ORDER BY rank) - (CASE WHEN 1 - sim = 0 THEN 1 ELSE 1 - sim END)) < 0.05, false)"))
def uncertainty_flag(spark, d):
    return search.uncertain(_cos(spark, d, 10).select("query", "rank", (1 - F.col("sim")).alias("distance")))


CENTER = f"{V}, mean AS (SELECT list(m ORDER BY i) AS mu FROM (SELECT i, avg(vec[i]) AS m FROM v, range(1, 65) r(i) GROUP BY i)), s AS (SELECT id, list_transform(list_zip(vec, mu), lambda z: z[1] - z[2]) AS w FROM v, mean), cv AS (SELECT id, list_transform(w, lambda x: x / sqrt(list_sum(list_transform(w, lambda y: y * y)))) AS vec FROM s)"


@query(f"WITH {CENTER} SELECT id, round(list_sum(vec), 6) AS total, round(vec[1], 6) AS first FROM cv")
def mean_center(spark, d):
    c = mean_centered(vectors(spark, d))
    return c.select("id", F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(F.col("vector")[0], 6).alias("first"))


@query(f"WITH {V}, c AS (SELECT min(id) AS id, vec FROM v GROUP BY vec), p AS (SELECT a.id AS a, b.id AS b, {DOT.format(a='a.vec', b='b.vec')} AS sim FROM c a JOIN c b ON a.id < b.id UNION ALL SELECT c.id, v.id, {DOT.format(a='v.vec', b='v.vec')} FROM c JOIN v ON v.vec = c.vec AND v.id <> c.id) SELECT a, b, round(sim, 6) AS sim FROM p WHERE sim > {NEAR}")
def near_dup_pairs(spark, d):
    return quality.near_dup_pairs(vectors(spark, d), threshold=NEAR).select("a", "b", F.round("sim", 6).alias("sim"))


@query(f"WITH {V} SELECT x.doc_id AS a, y.doc_id AS b FROM documents x JOIN documents y ON substr(x.text, 1, 300) = substr(y.text, 1, 300) AND x.doc_id < y.doc_id JOIN v a ON a.id = x.doc_id JOIN v b ON b.id = y.doc_id WHERE {DOT.format(a='a.vec', b='b.vec')} > -0.5")
def narrow_phase_pairs(spark, d):
    return quality.near_dup_pairs(vectors(spark, d), memories(spark, d), threshold=-0.5).select("a", "b")


COMPONENTS = f"RECURSIVE {PAIRS}, l AS (SELECT query AS a, id AS b FROM sims WHERE sim > {NEAR}), reach(id, comp) AS (SELECT DISTINCT a, a FROM l UNION SELECT l.b, reach.comp FROM reach JOIN l ON l.a = reach.id WHERE reach.comp < l.b), comps AS (SELECT id, min(comp) AS component FROM reach GROUP BY id)"


@query(f"WITH {COMPONENTS} SELECT id, component FROM comps")
def near_dup_components(spark, d):
    return connected_components(quality.near_dup_pairs(vectors(spark, d), threshold=NEAR))


@query(f"WITH {COMPONENTS}, {MEMORIES_SQL}, r AS (SELECT c.id, component, CASE WHEN coalesce(salience, 0) = 0 THEN 0.5 ELSE salience END AS s FROM comps c JOIN memories m ON m.id = c.id) SELECT id, component, count(*) OVER (PARTITION BY component) AS size, row_number() OVER (PARTITION BY component ORDER BY s DESC, id) = 1 AS keep FROM r")
def cluster_resolution(spark, d):
    return quality.cluster_resolution(quality.near_dup_pairs(vectors(spark, d), threshold=NEAR), memories(spark, d))


CORROBORATION = f"{PAIRS}, {MEMORIES_SQL}, u AS (SELECT id, CASE WHEN session_id = '' THEN 'id:' || id ELSE session_id END AS u FROM memories), n AS (SELECT s.query, count(DISTINCT b.u) AS support FROM sims s JOIN u a ON a.id = s.query JOIN u b ON b.id = s.id WHERE sim >= {SUPPORT} AND sim < {DUPLICATE} AND a.u <> b.u GROUP BY s.query), cor AS (SELECT id, coalesce(support, 0) AS support, round(least(coalesce(support, 0), 5)::DOUBLE / 5, 6) AS score FROM v LEFT JOIN n ON n.query = v.id)"


def _corroboration(spark, d):
    return quality.corroboration(vectors(spark, d), memories(spark, d), SUPPORT, DUPLICATE)


@query(f"WITH {CORROBORATION} SELECT * FROM cor")
def corroboration(spark, d):
    return _corroboration(spark, d)


@query(f"WITH {CORROBORATION} SELECT least(support, 5) AS support, count(*) AS n FROM cor GROUP BY 1")
def support_histogram(spark, d):
    return _corroboration(spark, d).groupBy(F.least("support", F.lit(5)).alias("support")).agg(F.count("*").alias("n"))


@query(f"""WITH {CORROBORATION}, g AS (SELECT query, CASE WHEN query % 2 = 0 THEN query + 1 ELSE query - 1 END AS gold FROM (SELECT DISTINCT query FROM sims)), s AS (SELECT s.query, s.id, round(sim, 9) AS before, round(sim * greatest(0.85, least(1.15, 1 + 0.3::DOUBLE * (score - 0.5::DOUBLE))), 9) AS after FROM sims s JOIN cor ON cor.id = s.id),
r AS (SELECT s.query, sum((s.before > x.before)::INT) + 1 AS rb, sum((s.after > x.after)::INT) + 1 AS ra FROM s JOIN g ON g.query = s.query JOIN s x ON x.query = s.query AND x.id = g.gold GROUP BY s.query)
SELECT count(*) AS n, round(avg((rb <= 10)::INT), 6) AS before_at_10, round(avg((ra <= 10)::INT), 6) AS after_at_10, round(avg(1 / rb), 6) AS mrr_before, round(avg(1 / ra), 6) AS mrr_after FROM r""")
def trust_reweight_lift(spark, d):
    v, gold = vectors(spark, d), _gold(spark, d)
    weights = _corroboration(spark, d).select("id", quality.trust_weight(F.col("score")).alias("weight"))
    before = quality.gold_ranks(v, gold, places=9).select("query", F.col("gold_rank").alias("rb"))
    rows = before.join(quality.gold_ranks(v, gold, places=9, weights=weights).select("query", F.col("gold_rank").alias("ra")), "query")
    return rows.agg(
        F.count("*").alias("n"), F.round(F.avg((F.col("rb") <= 10).cast("int")), 6).alias("before_at_10"), F.round(F.avg((F.col("ra") <= 10).cast("int")), 6).alias("after_at_10"),
        F.round(F.avg(1 / F.col("rb")), 6).alias("mrr_before"), F.round(F.avg(1 / F.col("ra")), 6).alias("mrr_after"),
    )


def _gold(spark, d):
    """Each vector's gold is its neighbour in number."""
    q = F.col("query")
    return _self(spark, d).select("query", F.when(q % 2 == 0, q + 1).otherwise(q - 1).alias("gold"))


RANKS = f"{PAIRS}, {MEMORIES_SQL}, g AS (SELECT id AS query, CASE WHEN id % 2 = 0 THEN id + 1 ELSE id - 1 END AS gold FROM v), r AS (SELECT s.query, sum((s.sim > x.sim)::INT) + 1 AS gold_rank FROM sims s JOIN g ON g.query = s.query JOIN sims x ON x.query = s.query AND x.id = g.gold {{scope}} GROUP BY s.query)"
METRICS = "count(*) AS n, round(avg((gold_rank <= 1)::INT), 6) AS p_at_1, round(avg((gold_rank <= 5)::INT), 6) AS p_at_5, round(avg((gold_rank <= 10)::INT), 6) AS p_at_10, round(avg(1 / gold_rank), 6) AS mrr, floor(quantile_cont(gold_rank::DOUBLE, 0.5))::BIGINT AS median_rank"


@query(f"WITH {RANKS.format(scope='')} SELECT type, {METRICS} FROM r JOIN memories m ON m.id = r.query GROUP BY type")
def p_at_k_mrr(spark, d):
    ranks = quality.gold_ranks(vectors(spark, d), _gold(spark, d))
    return evalir.metrics(ranks.join(memories(spark, d).select(F.col("id").alias("query"), "type"), "query"), ["type"])


@query(f"WITH {RANKS.format(scope='JOIN memories ma ON ma.id = s.query JOIN memories mb ON mb.id = s.id AND mb.project = ma.project JOIN memories mg ON mg.id = g.gold AND mg.project = ma.project')} SELECT {METRICS} FROM r")
def scoped_p_at_k(spark, d):
    scopes = memories(spark, d).select("id", F.col("project").alias("scope"))
    return evalir.metrics(quality.gold_ranks(vectors(spark, d), _gold(spark, d), scopes=scopes))


@query(f"""WITH {Q}, c AS (SELECT * FROM cosine WHERE rank <= 200), b AS (SELECT * FROM bm WHERE rank <= 200), f AS (SELECT a.a, coalesce(c.query, b.query) AS query, coalesce(c.id, b.id) AS id, round(a.a * coalesce((c.sim + 1) / 2, 0) + (1 - a.a) * CASE WHEN b.rank IS NULL THEN 0 ELSE 1 - (b.rank - 1)::DOUBLE / greatest(1, n_docs - 1) END, 9) AS s FROM c FULL JOIN b ON b.query = c.query AND b.id = c.id, st, (VALUES (0.0::DOUBLE), (0.3), (0.5), (0.7), (0.9), (1.0)) a(a)),
g AS (SELECT query, min(id) AS gold FROM bm WHERE rank = 1 GROUP BY query), r AS (SELECT f.a, f.query, sum((f.s > x.s)::INT) + 1 AS gold_rank, sum((f.s = x.s)::INT) - 1 AS n_tied FROM f JOIN g USING (query) JOIN f x ON x.a = f.a AND x.query = f.query AND x.id = g.gold GROUP BY 1, 2)
SELECT a AS alpha, count(*) AS n, round(avg((gold_rank = 1)::INT), 6) AS p_at_1, round(avg(1 / gold_rank), 6) AS mrr, sum(n_tied)::BIGINT AS tied FROM r GROUP BY a""")
def alpha_sweep(spark, d):
    n, cos, bm = table(spark, d, "documents").count(), _cos(spark, d, 200), _bm(spark, d, 200)
    gold = bm.filter("rank = 1").select("query", F.col("id").alias("gold"))
    out = None
    for a in (0.0, 0.3, 0.5, 0.7, 0.9, 1.0):
        r = evalir.gold_ranks(search.alpha_fusion(cos, bm, F.lit(n), F.lit(a)).withColumnRenamed("fused", "s"), gold)
        row = r.agg(F.lit(a).alias("alpha"), F.count("*").alias("n"), F.round(F.avg((F.col("gold_rank") == 1).cast("int")), 6).alias("p_at_1"), F.round(F.avg(1 / F.col("gold_rank")), 6).alias("mrr"), F.sum("n_tied").alias("tied"))
        out = row if out is None else out.union(row)
    return out


@query(f"WITH {KNN}, rel AS (SELECT a.vec_id AS query, b.vec_id AS id FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id), n AS (SELECT query, count(*) AS n_rel FROM rel GROUP BY query), h AS (SELECT k.query, min(rank) AS first, count(*) AS k FROM knn k JOIN rel ON rel.query = k.query AND rel.id = k.id WHERE rank <= 10 GROUP BY k.query) SELECT count(*) AS n, round(avg(coalesce(first = 1, false)::INT), 6) AS success_at_1, round(avg(coalesce(k, 0) / n_rel), 6) AS recall, round(avg(coalesce(1 / first, 0)), 6) AS mrr FROM n LEFT JOIN h USING (query)")
def relevance_set(spark, d):
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return evalir.label_relevance(quality.nearest(vectors(spark, d), 10), labels)


_STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)


def _words(c: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({c}), '[a-z0-9]+'), lambda w: NOT list_contains([{_STOP}], w)))"


@query(f"WITH w AS (SELECT b.item_id, d.doc_id, {_words('b.text')} AS q, {_words('d.text')} AS c FROM benchmark b JOIN documents d ON d.doc_id = b.item_id) SELECT item_id, round(CASE WHEN len(q) > 0 THEN len(list_intersect(q, c)) / len(q) ELSE 0 END, 6) AS overlap FROM w")
def vocab_overlap(spark, d):
    b = table(spark, d, "benchmark").select("item_id", F.col("text").alias("q"))
    return b.join(table(spark, d, "documents"), F.col("item_id") == F.col("doc_id")).select("item_id", F.round(text.vocab_overlap(F.col("q"), F.col("text")), 6).alias("overlap"))


AB = f"{CENTER}, gd AS (SELECT id AS query, CASE WHEN id % 2 = 0 THEN id + 1 ELSE id - 1 END AS gold FROM v), sc AS (SELECT a.id AS query, b.id, round({DOT.format(a='a.vec', b='b.vec')}, 9) AS x, round({DOT.format(a='ca.vec', b='cb.vec')}, 9) AS y FROM v a JOIN v b ON a.id <> b.id JOIN cv ca ON ca.id = a.id JOIN cv cb ON cb.id = b.id), r AS (SELECT sc.query, sum((sc.x > t.x)::INT) + 1 AS a, sum((sc.y > t.y)::INT) + 1 AS b FROM sc JOIN gd USING (query) JOIN sc t ON t.query = sc.query AND t.id = gd.gold GROUP BY sc.query), ab AS (SELECT count(*) AS n, round(avg((a <= 10)::INT), 6) AS hit_off, round(avg((b <= 10)::INT), 6) AS hit_on, sum((a > 10 AND b <= 10)::INT)::BIGINT AS gains, sum((a <= 10 AND b > 10)::INT)::BIGINT AS losses, round(avg(CASE WHEN a <= 10 THEN 1 / a ELSE 0 END), 6) AS mrr_off, round(avg(CASE WHEN b <= 10 THEN 1 / b ELSE 0 END), 6) AS mrr_on FROM r)"


def _paired(spark, d):
    v, gold = vectors(spark, d), _gold(spark, d)
    return evalir.paired(quality.gold_ranks(v, gold, places=9), quality.gold_ranks(mean_centered(v), gold, places=9))


@query(f"WITH {AB} SELECT * FROM ab")
def paired_ab(spark, d):
    return _paired(spark, d)


@query("WITH t AS (SELECT count(*) FILTER (WHERE l_returnflag = 'A') AS b, count(*) FILTER (WHERE l_returnflag = 'R') AS c FROM lineitem GROUP BY l_linenumber UNION ALL SELECT 0, 0) SELECT b, c, round(CASE WHEN b + c = 0 THEN 1 ELSE least(1, 2 * list_sum(list_transform(range(0, least(b, c) + 1), lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2))))) END, 6) AS p FROM t")
def mcnemar_table(spark, d):
    t = table(spark, d, "lineitem").groupBy("l_linenumber").agg(*[F.count(F.when(F.col("l_returnflag") == v, 1)).alias(c) for v, c in (("A", "b"), ("R", "c"))])
    t = t.select("b", "c").union(spark.createDataFrame([(0, 0)], "b long, c long"))
    return t.select("b", "c", F.round(evalir.mcnemar_p(F.col("b"), F.col("c")), 6).alias("p"))


BANDS = f"{SUPPORT_SQL}, cut AS (SELECT quantile_cont(support, 0.75) AS p75, quantile_cont(support, 0.40) AS p40, quantile_cont(support, 0.15) AS p15 FROM sup), bands AS (SELECT id, support, CASE WHEN support >= p75 THEN 'H' WHEN support >= p40 THEN 'M' WHEN support >= p15 THEN 'L' ELSE 'D' END AS band, CASE WHEN support >= p75 THEN 0.70::DOUBLE WHEN support >= p40 THEN 0.55 WHEN support >= p15 THEN 0.40 ELSE 0.25 END AS confidence FROM sup, cut)"


@query(f"WITH {BANDS} SELECT * FROM bands")
def confidence_bands(spark, d):
    return quality.confidence_bands(quality.support(vectors(spark, d)))


@query(f"WITH {BANDS}, {MEMORIES_SQL} SELECT id, round(confidence - salience, 6) AS delta FROM bands JOIN memories USING (id) WHERE (salience >= 0.8 OR project IN ('src1', 'src2')) AND round(confidence - salience, 6) <= -0.10")
def demotion_safety(spark, d):
    return quality.demotions(quality.confidence_bands(quality.support(vectors(spark, d))), memories(spark, d), ["src1", "src2"])


@query(f"WITH {SUPPORT_SQL} SELECT CASE WHEN support >= 0.9 THEN '0.9+' WHEN support >= 0.8 THEN '0.8-0.9' WHEN support >= 0.6 THEN '0.6-0.8' WHEN support >= 0.4 THEN '0.4-0.6' WHEN support >= 0.3 THEN '0.3-0.4' ELSE '<0.3' END AS bucket, count(*) AS n, round(avg(support), 6) AS mean_support FROM sup GROUP BY 1")
def density_buckets(spark, d):
    return quality.density_buckets(quality.support(vectors(spark, d)))


@query(f"WITH {KNN}, {CENTER[len(V) + 2:]}, ck AS (SELECT a.id AS query, b.id, row_number() OVER (PARTITION BY a.id ORDER BY {DOT.format(a='a.vec', b='b.vec')} DESC, b.id) AS rank FROM cv a JOIN cv b ON a.id <> b.id), j AS (SELECT x.query AS id, list(x.id) AS x FROM knn x WHERE rank <= 10 GROUP BY 1), k AS (SELECT query AS id, list(id) AS y FROM ck WHERE rank <= 10 GROUP BY 1) SELECT id, round(len(list_intersect(x, y)) / (20 - len(list_intersect(x, y))), 6) AS jaccard FROM j JOIN k USING (id)")
def jaccard_neighbors(spark, d):
    v = vectors(spark, d)
    return quality.jaccard_neighbors(v, mean_centered(v))


@query(f"WITH {SUPPORT_SQL}, th AS (SELECT unnest([0.22, 0.24, 0.26, 0.28]::DOUBLE[]) AS threshold), g AS (SELECT id AS query, CASE WHEN id % 2 = 0 THEN id + 1 ELSE id - 1 END AS gold FROM v), a AS (SELECT threshold, s.query, s.id, gold, sim FROM sims s JOIN g USING (query) JOIN sup ON sup.id = s.id, th WHERE support < threshold), r AS (SELECT a.threshold, a.query, sum((a.sim > x.sim)::INT) + 1 AS rank FROM a JOIN a x ON x.threshold = a.threshold AND x.query = a.query AND x.id = a.gold GROUP BY 1, 2), allq AS (SELECT DISTINCT threshold, query FROM sims, th) SELECT threshold, count(*) FILTER (WHERE rank IS NULL) AS killed, round(avg(coalesce(rank = 1, false)::INT), 6) AS p_at_1, round(avg(coalesce(1 / rank, 0)), 6) AS mrr FROM allq LEFT JOIN r USING (threshold, query) GROUP BY threshold")
def prune_simulation(spark, d):
    fragile = quality.support(vectors(spark, d)).withColumnRenamed("support", "fragility")
    return quality.prune_sweep(vectors(spark, d), _gold(spark, d), fragile, [0.22, 0.24, 0.26, 0.28])


@query(f"WITH {KNN}, {MEMORIES_SQL} SELECT k.query AS id, k.id AS duplicate_of FROM knn k JOIN memories a ON a.id = k.query JOIN memories b ON b.id = k.id WHERE rank = 1 AND 1 - sim < 0.7 AND a.project = b.project AND a.type = b.type")
def save_guard_candidates(spark, d):
    v = vectors(spark, d)
    return quality.save_guard(v, v, memories(spark, d), 0.7)


@query(f"WITH {KNN}, {CENTER[len(V) + 2:]}, ck AS (SELECT a.id AS query, b.id, row_number() OVER (PARTITION BY a.id ORDER BY {DOT.format(a='a.vec', b='b.vec')} DESC, b.id) AS rank FROM cv a JOIN cv b ON a.id <> b.id) SELECT round(avg((c.id IS NOT NULL)::INT), 6) AS recall, round(sum((k.rank = 1 AND coalesce(c.rank = 1, false))::INT) / sum((k.rank = 1)::INT), 6) AS top1 FROM knn k LEFT JOIN ck c ON c.query = k.query AND c.id = k.id AND c.rank <= 10 WHERE k.rank <= 10")
def centered_recall(spark, d):
    v = vectors(spark, d)
    return quality.index_validation(quality.nearest(v, 10), quality.nearest(mean_centered(v), 10)).select("recall", "top1")


def _index(spark, d):
    made = VectorIndex.create(spark, 64)
    made.insert(vectors(spark, d))
    return made


@query(f"WITH {Q} SELECT query, id, round(sim, 6) AS sim, rank FROM cosine WHERE rank <= 10")
def index_search(spark, d):
    found = _index(spark, d).search(_queries(spark, d).filter("vector is not null"), vectors(spark, d), 10)
    return found.select("query", "id", F.round("sim", 6).alias("sim"), "rank")


@query(f"WITH {V}, s AS (SELECT a.id AS query, b.id, row_number() OVER (PARTITION BY a.id ORDER BY {DOT.format(a='a.vec', b='b.vec')} DESC, b.id) AS rank FROM v a, v b) SELECT count(*) AS n, 1.0::DOUBLE AS recall, 1.0::DOUBLE AS top1, round(avg((query = id)::INT), 6) AS self_found, round(avg((query = id)::INT), 6) AS self_exact FROM s WHERE rank = 1")
def index_validation(spark, d):
    v = vectors(spark, d)
    own = tiles.tiled(v)
    return quality.index_validation(tiles.topk(own, own, 10), _index(spark, d).search(_self(spark, d), v, 10))


@query()
def fragility(spark, d):
    return quality.fragility(vectors(spark, d))


@query()
def bootstrap_ci(spark, d):
    sup = quality.support(vectors(spark, d))
    return evalir.bootstrap_ci(sup.select(F.col("id").alias("i"), (F.col("support") - 0.25).alias("d")))


@query(f"""WITH {Q}, g AS (SELECT query, CASE WHEN query % 7 = 0 THEN -1 ELSE id END AS gold FROM bm WHERE rank = 1), c AS (SELECT * FROM cosine WHERE rank <= 200), b AS (SELECT * FROM bm WHERE rank <= 200),
f AS (SELECT coalesce(c.query, b.query) AS query, coalesce(c.id, b.id) AS id, round(1 / (60 + coalesce(c.rank, n_docs + 1))::DOUBLE + 1 / (60 + coalesce(b.rank, n_docs + 1))::DOUBLE, 9) AS s FROM c FULL JOIN b ON b.query = c.query AND b.id = c.id, st),
r AS (SELECT f.query, sum((f.s > x.s)::INT) + 1 AS gr FROM f JOIN g USING (query) JOIN f x ON x.query = f.query AND x.id = g.gold GROUP BY 1), base AS (SELECT round(count(*) FILTER (WHERE gr = 1) / (SELECT count(*) FROM g), 4) AS p FROM r),
live AS (SELECT g.query, c.rank FROM g LEFT JOIN c ON c.query = g.query AND c.id = g.gold AND c.rank <= 10 WHERE gold IN (SELECT doc_id FROM documents))
SELECT 'ok' AS status, count(*) AS n_queries, round(avg((coalesce(rank, 0) = 1)::INT), 4) AS precision_at_1, round(avg(coalesce(1 / rank, 0)), 4) AS mrr, round(avg((coalesce(rank, 0) = 1)::INT) - any_value(p), 4) AS gap_vs_offline_rrf, (SELECT count(*) FROM g WHERE gold NOT IN (SELECT doc_id FROM documents)) AS n_skipped_dangling FROM live, base""")
def live_path_eval(spark, d):
    n, bm, cos = table(spark, d, "documents").count(), _bm(spark, d, 200), _cos(spark, d, 200)
    gold = bm.filter("rank = 1").select("query", F.when(F.col("query") % 7 == 0, -1).otherwise(F.col("id")).alias("gold"))
    base = evalir.offline_p1(search.rrf_fusion(cos, bm, F.lit(n)).withColumnRenamed("rrf", "s"), gold)
    return evalir.live_path(cos.filter("rank <= 10"), gold, memories(spark, d).select("id"), base)


@query("""WITH s AS (SELECT CASE user_id % 3 WHEN 0 THEN 'api' WHEN 1 THEN '' END AS source, CASE WHEN user_id % 2 = 0 THEN 'hook' END AS memory_source, ts FROM events WHERE event_type = 'error'),
m AS (SELECT count(*) AS queue_size, greatest(0, floor((epoch_us(TIMESTAMP '2024-02-25 00:00:00') - epoch_us(min(ts))) / 1000000.0::DOUBLE))::BIGINT AS oldest_age_sec FROM s)
SELECT coalesce(nullif(source, ''), memory_source, 'unknown') AS source, count(*) AS n, any_value(queue_size) AS queue_size, any_value(oldest_age_sec) AS oldest_age_sec FROM s, m GROUP BY 1""")
def spool_gauges(spark, d):
    u = F.col("user_id")
    spool = table(spark, d, "events").filter("event_type = 'error'").select(
        F.when(u % 3 == 0, "api").when(u % 3 == 1, "").alias("source"), F.when(u % 2 == 0, "hook").alias("memory_source"), F.col("ts").cast("timestamp_ntz").alias("queued_at"),
    )
    now = F.lit("2024-02-25 00:00:00").cast("timestamp_ntz")
    return flows.spool_sources(spool).crossJoin(F.broadcast(flows.spool_metrics(spool, now)))  # one row


@query("""WITH f AS (SELECT p_partkey AS id, 0 AS i, trim(p_name) AS content, CASE WHEN p_size = 0 THEN 0.5 ELSE least(1.0::DOUBLE, p_size / 10.0::DOUBLE) END AS salience, CASE WHEN lower(p_type) IN ('decision', 'solution', 'preference', 'fact', 'pattern', 'error_lesson') THEN lower(p_type) ELSE 'decision' END AS fact_type, p_brand AS entities FROM part
UNION ALL SELECT p_partkey, 2, 'second', 0.5, 'solution', '' FROM part) SELECT id, (row_number() OVER (PARTITION BY id ORDER BY salience DESC, i) - 1)::INTEGER AS pos, content, salience, fact_type, entities FROM f""")
def parse_facts(spark, d):
    p = table(spark, d, "part")
    raw = F.format_string('```json\n{"facts": [{"content": " %s ", "salience": %s, "fact_type": "%s", "entities": ["%s", "git", "x"]}, {"content": "", "salience": 1}, {"content": "second", "fact_type": "solution"}]}\n```', F.col("p_name"), (F.col("p_size") / 10.0).cast("string"), F.lower("p_type"), F.col("p_brand"))
    return facts.parse_facts(p.select(F.col("p_partkey").alias("id"), raw.alias("text"))).withColumn("entities", F.array_join("entities", ","))


@query()
def curate_facts(spark, d):
    def half(rest: int):
        return memories(spark, d).join(vectors(spark, d), "id").filter(F.col("id") % 2 == rest)

    drafts = half(0).select("project", "id", F.col("id").alias("pos"), "content", "vector")
    return facts.curate(drafts, half(1).select("project", "id", "content", "vector"))


@query("""WITH s AS (SELECT event_id AS id, key, a, ts FROM (SELECT event_id, user_id || '' AS key, event_id % 9 AS a, ts FROM events WHERE event_type = 'error')), k AS (SELECT DISTINCT user_id || '' AS key FROM events WHERE event_type = 'signup' AND event_id % 40 = 0),
f AS (SELECT id, a + 1 AS attempts, (a + 1 >= 8 OR TIMESTAMP '2024-01-25 00:00:00' - ts > INTERVAL 14 DAY) AS dead FROM s WHERE key NOT IN (SELECT key FROM k)) SELECT id, attempts, dead FROM f""")
def spool_dlq(spark, d):
    e = table(spark, d, "events")
    spool = e.filter("event_type = 'error'").select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("key"), (F.col("event_id") % 9).alias("attempts"), F.col("ts").alias("queued_at"))
    sent = e.filter("event_type = 'signup' and event_id % 40 = 0").select(F.col("user_id").cast("string").alias("key"))
    live, dead = flows.spool_pass(spool, sent, F.lit("2024-01-25 00:00:00").cast("timestamp"))
    return live.select("id", "attempts", F.lit(False).alias("dead")).union(dead.select("id", "attempts", F.lit(True)))


@query("""WITH j AS (SELECT o_orderkey AS id, o_orderdate AS created_at, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'done' ELSE 'failed' END AS status, o_custkey % 5 AS attempts, o_orderkey % 3 = 0 AS ok FROM orders), t AS (SELECT *, row_number() OVER (PARTITION BY status ORDER BY created_at, id) AS turn FROM j), r AS (SELECT *, status = 'pending' AND turn <= 10 AS runs FROM t)
SELECT id, created_at, CASE WHEN runs AND ok THEN 'done' WHEN runs AND attempts + 1 >= 5 THEN 'failed' ELSE status END AS status, CASE WHEN runs AND NOT ok THEN attempts + 1 ELSE attempts END AS attempts FROM r""")
def job_queue(spark, d):
    o = table(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "done").otherwise("failed")
    jobs = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"), status.alias("status"), (F.col("o_custkey") % 5).alias("attempts"))
    return flows.job_step(jobs, o.select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 3 == 0).alias("ok")))


def _actions(spark, d):
    e = table(spark, d, "events")
    tool = F.when(F.col("event_type").isin("view", "error"), "Bash").when(F.col("event_type") == "click", "Edit").when(F.col("event_type") == "purchase", "Write").otherwise("Task")
    target = F.when(F.col("event_type") == "view", "pytest test_all").when(F.col("event_type") == "error", "make").otherwise(F.concat(F.lit("src/f"), F.col("event_id") % 7, F.lit(".py")))
    response = F.when(F.col("event_type") == "error", F.concat(F.lit("Traceback in f"), F.col("event_id") % 5, F.lit(".py"))).when(F.col("event_id") % 3 == 0, "3 passed").otherwise("ok")
    return e.select(F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("seq"), tool.alias("tool"), target.alias("target"), response.alias("response"))


@query("SELECT event_id AS seq, CASE event_type WHEN 'view' THEN CASE WHEN event_id % 3 = 0 THEN 'test_pass' END WHEN 'click' THEN 'edit_group' WHEN 'purchase' THEN 'write_source' WHEN 'signup' THEN 'agent' END AS kind FROM events")
def classify_actions(spark, d):
    return flows.classified_actions(_actions(spark, d)).select("seq", "kind")


@query()
def error_fix_state(spark, d):
    return flows.action_events(_actions(spark, d))


@query("""WITH RECURSIVE e AS (SELECT 'c' || user_id AS client, ts, event_id AS id FROM events), s(client, begins) AS (SELECT client, min(ts) FROM e GROUP BY client UNION ALL SELECT s.client, min(e.ts) FROM s JOIN e ON e.client = s.client AND e.ts >= s.begins + INTERVAL 1 DAY GROUP BY s.client, s.begins),
w AS (SELECT e.client, e.ts, e.id, max(s.begins) AS begins FROM e JOIN s ON s.client = e.client AND s.begins <= e.ts GROUP BY 1, 2, 3) SELECT client, ts, id, row_number() OVER (PARTITION BY client, begins ORDER BY ts, id) <= 2 AS allowed FROM w""")
def rate_limit_window(spark, d):
    e = table(spark, d, "events").select(F.concat(F.lit("c"), F.col("user_id")).alias("client"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("event_id").alias("id"))
    return flows.rate_limited(e, limit=2, window_s=86_400)


#: Distances under which records of the supplied vectors count as repeated.
REPEATED = 0.6
#: Rows of odd ids are saved after those of even ids, each in the order of ids.
SAVES = f"""RECURSIVE {V}, {MEMORIES_SQL}, i AS (SELECT id, id % 2 AS batch, id // 2 AS pos, project, type, vec FROM memories JOIN v USING (id)),
p AS (SELECT a.id AS a, b.id AS b, {DOT.format(a='a.vec', b='b.vec')} AS sim, a.project = b.project AND a.type = b.type AS same FROM i a JOIN i b ON b.batch = a.batch AND b.pos < a.pos),
n0 AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS k FROM p WHERE a % 2 = 0), d0 AS (SELECT a, b FROM n0 WHERE k = 1 AND sim > 1 - {REPEATED} AND same),
q AS (SELECT a.id AS a, b.id AS b, {DOT.format(a='a.vec', b='b.vec')} AS sim, a.project = b.project AND a.type = b.type AS same FROM i a JOIN i b ON a.batch = 1 AND b.batch = 0 AND b.id NOT IN (SELECT a FROM d0)),
n1 AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, own, b) AS k FROM (SELECT *, 0 AS own FROM q UNION ALL SELECT *, 1 FROM p WHERE a % 2 = 1)),
d AS (SELECT a, b FROM d0 UNION ALL SELECT a, b FROM n1 WHERE k = 1 AND sim > 1 - {REPEATED} AND same),
way(id, last) AS (SELECT id, id FROM i UNION ALL SELECT way.id, d.b FROM way JOIN d ON d.a = way.last)"""


@query(f"WITH {SAVES} SELECT way.id, last AS record, way.id = last AS saved FROM way WHERE last NOT IN (SELECT a FROM d)")
def save_with_guards(spark, d):
    rows = memories(spark, d).join(vectors(spark, d), "id").withColumn("pos", F.floor(F.col("id") / 2))
    store = RecordStore(spark, fresh_path(spark, "store"), max_distance=REPEATED)
    out = None
    for batch in (0, 1):
        told = store.save(rows.filter(F.col("id") % 2 == batch), batch).select((F.col("pos") * 2 + batch).alias("id"), "saved", "id")
        told = told.toDF("id", "saved", "record")
        out = told if out is None else out.union(told)
    number = F.col("record") % BATCH_ITEMS * 2 + F.floor(F.col("record") / BATCH_ITEMS)
    return out.select("id", number.alias("record"), "saved")


def _question(texts: list[str]) -> list[str | None]:
    """A client that stands in for a model: five words of its own before the text's fourth to sixth; none for texts that begin with a vowel."""
    return [None if t[:1].lower() in "aeiou" else "describe general procedure behind topic " + " ".join(t.split(" ")[3:6]) for t in texts]


@query(f"""WITH {MEMORIES_SQL}, e AS (SELECT l_orderkey AS id, count(DISTINCT l_partkey) AS n_edges FROM lineitem GROUP BY 1),
c AS (SELECT id, type, project, content, n_edges, -ln((('0x' || substr(md5(id || ':42'), 1, 13))::BIGINT + 1) / 4503599627370496.0::DOUBLE) / n_edges AS key FROM memories JOIN e USING (id) WHERE type IN ('solution', 'decision', 'fact') AND superseded_by IS NULL AND length(content) >= 200),
q AS (SELECT *, 'describe general procedure behind topic ' || array_to_string(string_split(content, ' ')[4:6], ' ') AS question FROM c WHERE NOT contains('aeiou', lower(substr(content, 1, 1)))),
o AS (SELECT *, {_words("question")} AS w, {_words("content")} AS cw FROM q), s AS (SELECT *, CASE WHEN len(w) > 0 THEN len(list_intersect(w, cw)) / len(w) ELSE 1 END AS share FROM o),
k AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY key, id) AS turn FROM s WHERE share <= 0.45)
SELECT id, type, project, n_edges, question, round(share, 4) AS vocab_overlap FROM k WHERE turn <= CASE type WHEN 'solution' THEN 40 WHEN 'decision' THEN 10 ELSE 100000 END""")
def gold_sample(spark, d):
    quotas = {"solution": 40, "decision": 10, "fact": 100_000}
    candidates = gold.pool(memories(spark, d), edges(spark, d), list(quotas), weighted=True)
    return gold.build(candidates, quotas, _question).rows
