"""Queries opN_<name> over the whole tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import fresh_path
from . import ann, decontam, jaccard, langid, merkle, packing, ppm, quality, spelling, superkmer, tokens, toxicity, urlfilter

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def byte_bpe() -> str:
    """Path of the public byte-level BPE vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = ann.build(_table(spark, sf_dir, "embeddings"))
    return ann.search(index, index.rows.filter("vec_id % 100 = 0").select("vec_id", "vector"), k=10)


def op3_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = tokens.write(_table(spark, sf_dir, "documents"), fresh_path(spark, "tokens"), byte_bpe(), end_id=2)
    return tokens.read_back(spark, written)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(_table(spark, sf_dir, "documents"), jaccard.Rule(words=3, percent=90))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontam.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), byte_bpe())


URL_RULES = [
    urlfilter.UrlRule("allow", "com", "/"),
    urlfilter.UrlRule("block", "example.com", "/en/"),
    urlfilter.UrlRule("allow", "www.example.com", "/en/"),
    urlfilter.UrlRule("block", "net", "/es/"),
    urlfilter.UrlRule("block", "net", "/fr/"),
]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(_table(spark, sf_dir, "pages"), URL_RULES)


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(_table(spark, sf_dir, "documents"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = superkmer.report(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.vocabulary(_table(spark, sf_dir, "documents")))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = merkle.manifest(_table(spark, sf_dir, "documents"), tampered={"text": merkle.lowered_where(3)})
    return rows.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {
    "op1_toxicity": op1_toxicity,
    "op2_ann": op2_ann,
    "op3_token_ids": op3_token_ids,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_quality": op5_quality,
    "op6_decontamination": op6_decontamination,
    "op7_packing": op7_packing,
    "op8_url_filter": op8_url_filter,
    "op9_langid": op9_langid,
    "op10_lm_score": op10_lm_score,
    "op11_substring_dedup": op11_substring_dedup,
    "op12_spelling": op12_spelling,
    "op13_merkle": op13_merkle,
    "pipeline": pipeline,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Shared-shingle counts of all pairs, then the smallest id reachable by links.
OP4_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), g AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 3 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i+2], ' ') END AS s
  FROM w, range(1, greatest(len(ws) - 1, 2)) r(i) WHERE len(ws) > 0
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM g x JOIN g y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 90 * (na.n + nb.n - k)),
reach(id, comp) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT l.a, reach.comp FROM reach JOIN l ON l.b = reach.id WHERE reach.comp < l.a
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, r.component_id
FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN n USING (doc_id)
JOIN (SELECT id, min(comp) AS component_id FROM reach GROUP BY id) r ON r.id = d.doc_id
"""

OP6_SQL = f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark
), win AS (
  SELECT DISTINCT item, least(len(ws), 10) AS k, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS s
  FROM b, range(1, greatest(len(ws) - 9, 1) + 1) r(i) WHERE len(ws) > 0
), ks AS (SELECT DISTINCT k FROM win),
dw AS (
  SELECT doc_id, i, k, array_to_string(ws[i:i + k - 1], ' ') AS s
  FROM d, ks, range(1, len(ws) - k + 2) r(i) WHERE len(ws) >= k
), m AS (SELECT dw.doc_id, dw.i, dw.k, win.item FROM dw JOIN win ON dw.k = win.k AND dw.s = win.s),
h AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM (SELECT DISTINCT doc_id, i, k FROM m), range(0, k) q(j) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS items FROM m GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""

OP8_SQL = """
WITH r(rule, verdict, host, path) AS (VALUES
  ('com/', 'allow', 'com', '/'), ('example.com/en/', 'block', 'example.com', '/en/'), ('www.example.com/en/', 'allow', 'www.example.com', '/en/'),
  ('net/es/', 'block', 'net', '/es/'), ('net/fr/', 'block', 'net', '/fr/')
), p AS (
  SELECT page_id, row_number() OVER () AS n,
    translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), m AS (
  SELECT p.n, r.rule, r.verdict, row_number() OVER (PARTITION BY p.n ORDER BY length(r.rule) DESC, length(r.host) DESC) AS k
  FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
)
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM p LEFT JOIN m ON m.n = p.n AND m.k = 1
"""

#: Exact distances to all other vectors, components added one after another.
OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), d AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum(list_transform(list_zip(q.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""

#: The least id of every window, and the words that windows of a smaller id cover.
OP11_SQL = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT r, doc_id, i, array_to_string(ws[i:i + 12], ' ') AS s FROM w, range(1, len(ws) - 11) t(i) WHERE len(ws) >= 13 AND doc_id IS NOT NULL),
least AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s HAVING min(doc_id) < max(doc_id)),
off AS (SELECT DISTINCT r, i + j AS p FROM win JOIN least USING (s), range(0, 13) q(j) WHERE m < doc_id),
gone AS (SELECT r, list(p) AS ps FROM off GROUP BY r),
kept AS (SELECT w.r, list_filter(ws, lambda x, i: NOT list_contains(ps, i)) AS ks FROM w JOIN gone USING (r))
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - len(coalesce(ks, ws)))::BIGINT AS n_removed, sha256(array_to_string(coalesce(ks, ws), ' ')) AS kept_sha256
FROM w LEFT JOIN kept USING (r)
"""

#: CRC-32 of a list of byte values.
_CRC = "xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, {bytes}), lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda x, i: xor(x >> 1, 3988292384::UBIGINT * (x & 1)))))"
_A, _Z = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"
#: Byte values of a string, two hexadecimal digits each.
_BYTES = "list_transform(range(1, length({h}), 2), lambda i: ((instr('0123456789ABCDEF', {h}[i:i]) - 1) * 16 + instr('0123456789ABCDEF', {h}[i + 1:i + 1]) - 1)::UBIGINT)"

#: Pairs that differ by a replaced character share the rest at that place; others hold one another less a character.
OP12_SQL = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')), {_A}, {_Z}) AS run FROM documents WHERE text IS NOT NULL
), d AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY 1, 2),
h AS (SELECT *, hex(encode(doc_id || ':' || run)) AS hx FROM d),
k AS (SELECT run, n, {_CRC.format(bytes=_BYTES.format(h="hx"))} AS crc FROM h),
c AS (SELECT n, CASE WHEN crc % 97 = 0 THEN substr(run, 1, (crc % length(run))::BIGINT) || substr(run, (crc % length(run))::BIGINT + 2) ELSE run END AS word FROM k),
v AS (SELECT word, sum(n)::BIGINT AS n FROM c WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cut AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM v, range(1, length(word) + 1) r(i)),
near AS (
  SELECT x.word, y.word AS near FROM cut x JOIN cut y ON x.i = y.i AND x.rest = y.rest AND x.word <> y.word
  UNION SELECT word, rest FROM cut WHERE rest IN (SELECT word FROM v)
  UNION SELECT rest, word FROM cut WHERE rest IN (SELECT word FROM v)
), s AS (SELECT near.word, near, v.n, count(*) OVER (PARTITION BY near.word) AS n_near, row_number() OVER (PARTITION BY near.word ORDER BY v.n DESC, encode(near)) AS k FROM near JOIN v ON v.word = near),
f AS (SELECT v.word, v.n, coalesce(s.n_near, 0) AS n_near, CASE WHEN s.n >= 2 * v.n THEN s.near END AS form, CASE WHEN s.n >= 2 * v.n THEN s.n END AS form_n FROM v LEFT JOIN s ON s.word = v.word AND s.k = 1),
way(word, last) AS (SELECT word, word FROM f UNION ALL SELECT way.word, f.form FROM way JOIN f ON f.word = way.last WHERE f.form IS NOT NULL)
SELECT f.word, f.n, f.n_near::BIGINT AS n_near, f.form, f.form_n::BIGINT AS form_n, way.last AS root FROM f JOIN way ON way.word = f.word JOIN f e ON e.word = way.last AND e.form IS NULL
"""


def _leaf(text: str) -> str:
    fields = ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode({f})) || ':' || {f}, '-')" for f in fields) + ")"


#: Levels of all trees at once (tree: language, or the one over the subroots), then every leaf's way up.
OP13_SQL = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, '') AS g, {_leaf("text")} AS leaf,
    CASE WHEN {_CRC.format(bytes="list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)")} % 3 = 0 THEN {_leaf(f"translate(text, {_A}, {_Z})")} ELSE {_leaf("text")} END AS changed
  FROM documents
), p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
low(g, level, pos, h, n) AS (
  SELECT g, 0, pos, leaf, count(*) OVER (PARTITION BY g) FROM p
  UNION ALL SELECT g, max(level) + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (max(n) + 7) // 8 FROM low WHERE n > 1 GROUP BY g, pos // 8
), sub AS (SELECT g, h, level, row_number() OVER (ORDER BY encode(g)) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
up(level, pos, h, n) AS (
  SELECT 0, pos, h, n FROM sub UNION ALL SELECT max(level) + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (max(n) + 7) // 8 FROM up WHERE n > 1 GROUP BY pos // 8
), node AS (
  SELECT g, level, pos, h, n FROM low UNION ALL SELECT 'up', level, pos, h, n FROM up
), side AS (
  SELECT a.g, a.level, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM node a JOIN node b ON b.g = a.g AND b.level = a.level AND b.pos // 8 = a.pos // 8 WHERE a.n > 1 GROUP BY 1, 2, 3
), way(r, g, level, pos, f, proof) AS (
  SELECT r, g, 0, pos, changed, '' FROM p
  UNION ALL SELECT way.r, way.g, way.level + 1, way.pos // 8, sha256(side.l || f || side.r), proof || side.l || side.r FROM way JOIN side ON side.g = way.g AND side.level = way.level AND side.pos = way.pos
), upway(r, level, pos, f, proof) AS (
  SELECT way.r, 0, sub.pos, f, proof FROM way JOIN sub ON sub.g = way.g AND sub.level = way.level
  UNION ALL SELECT u.r, u.level + 1, u.pos // 8, sha256(side.l || f || side.r), proof || side.l || side.r FROM upway u JOIN side ON side.g = 'up' AND side.level = u.level AND side.pos = u.pos
), top AS (SELECT h AS root, level FROM up WHERE n = 1)
SELECT doc_id, leaf, sub.h AS subroot, root, sha256(proof) AS proof_sha256, f AS folded_root, f = root AS verified
FROM p JOIN sub USING (g) JOIN top ON true JOIN upway ON upway.r = p.r AND upway.level = top.level
"""

ORACLE: dict[str, str] = {"op2_ann": OP2_SQL, "op4_jaccard_join": OP4_SQL, "op6_decontamination": OP6_SQL, "op8_url_filter": OP8_SQL, "op11_substring_dedup": OP11_SQL, "op12_spelling": OP12_SQL, "op13_merkle": OP13_SQL}
