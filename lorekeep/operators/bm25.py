"""BM25 over a postings table of stems (Robertson-Zaragoza, k1 = 1.2, b = 0.75, idf = ln(1 + (N - df + 0.5) / (df + 0.5)))."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from ..functions.stem import porter
from ..functions.text import ascii_lower, index_words, sanitize_query
from ..sources.shared import stored

K1, B = 1.2, 0.75
#: Words of query terms up to which they are broadcast, some 50 MB; more are joined by a shuffle.
MAX_TERMS = 1_000_000


@F.pandas_udf(StringType())
def _stems(words: pd.Series) -> pd.Series:
    return words.map(porter)


def stemmed(terms: DataFrame) -> DataFrame:
    """(term, stem) of distinct terms (term): each is stemmed once, not wherever it stands."""
    return terms.select("term", _stems("term").alias("stem"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query, stem, n_terms): the distinct stems of each query (query, text). A token with - or ' asks for all its parts."""
    words = queries.select("query", F.explode(index_words(F.array_join(sanitize_query(F.col("text")), " "))).alias("word")).select("query", ascii_lower(F.col("word")).alias("term")).distinct()
    stems = words.join(stemmed(words.select("term").distinct()), "term").select("query", "stem").distinct()
    return stems.withColumn("n_terms", F.count("*").over(Window.partitionBy("query")))


def vocabulary(docs: DataFrame) -> DataFrame:
    """(term, docs, words): the terms of docs (id, content), stored; docs and words count, and sum up the lengths of, the documents that begin with a term (null: without words), so one pass gives terms and statistics."""
    words = docs.select(index_words(F.col("content")).alias("ws")).select(F.size("ws").alias("len"), F.posexplode_outer("ws").alias("at", "word"))
    first = F.coalesce("at", F.lit(0)) == 0
    counts = words.groupBy(ascii_lower(F.col("word")).alias("term")).agg(F.count(F.when(first, 1)).alias("docs"), F.coalesce(F.sum(F.when(first, F.col("len"))), F.lit(0)).alias("words"))
    return stored(counts, "bm25-vocabulary")


def postings(docs: DataFrame, terms: DataFrame, stems: DataFrame) -> DataFrame:
    """(stem, id, len, tf) of docs (id, content) for the given stems (stem), distinct ones; terms (term): the vocabulary.

    The vocabulary is cut down to the words of these stems; other words of the
    documents end before the shuffle.
    """
    wanted = stored(stemmed(terms.filter("term is not null")).join(stems, "stem", "left_semi"), "bm25-words")
    few = wanted.limit(MAX_TERMS + 1).count() <= MAX_TERMS
    words = docs.select("id", index_words(F.col("content")).alias("ws")).select("id", F.size("ws").alias("len"), F.explode("ws").alias("word"))
    found = words.select("id", "len", ascii_lower(F.col("word")).alias("term")).join(F.broadcast(wanted) if few else wanted, "term")
    return found.groupBy("stem", "id", "len").agg(F.count("*").alias("tf"))


def bm25_topk(queries: DataFrame, docs: DataFrame, n: int, k1: float = K1, b: float = B) -> DataFrame:
    """(query, id, score, rank) of the n best documents that hold all distinct stems of a query, ties to the smaller id.

    Two passes over the documents: terms and statistics, and the postings of query
    stems.  What can hold all stems of a query holds its rarest one, so only these
    documents are scored.
    """
    terms, known = stored(query_terms(queries), "bm25-terms"), vocabulary(docs)
    stats = known.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("n_docs"), (F.sum("words") / F.sum("docs")).alias("avg_len"))
    wanted = stored(postings(docs, known.select("term"), terms.select("stem").distinct()), "bm25-postings")
    df = wanted.groupBy("stem").agg(F.count("*").alias("df"))
    known_df = stored(terms.join(df, "stem"), "bm25-df")
    rarest = known_df.groupBy("query").agg(F.min(F.struct("df", "stem")).alias("r")).select("query", "r.stem")
    cand = rarest.join(wanted.select("stem", "id"), "stem").select("query", "id")
    hits = cand.join(known_df, "query").join(wanted, ["stem", "id"]).crossJoin(F.broadcast(stats))  # one row of statistics
    idf = F.ln(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    scored = hits.groupBy("query", "id").agg(F.round(F.sum(part), 9).alias("score"), F.count("*").alias("k"), F.max("n_terms").alias("n_terms")).filter("k = n_terms")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n).select("query", "id", "score", "rank")
