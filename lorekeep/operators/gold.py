"""Gold questions: a sample by type with quotas, questions from an injected client, an overlap filter, and refills.

Candidates are ordered within their type by hashed keys -ln(u) / weight, u from
the MD5 of `id:seed`, so the first n are a sample without replacement in which a
record's chance follows its weight, and the same one whatever the partitions.
A round asks the client for `oversample` times what is missing of each type, in
that order; accepted are the first that pass, and rounds go on until every quota
is filled or no candidate is left.  The client sees what a round takes and
nothing else; the driver sees a few counts a type.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import content_words, vocab_overlap
from ..sources.shared import stored

# fixed values: overlap above which a question is rejected, least length of a text, type that is never asked about
MAX_OVERLAP, MIN_CHARS, EXCLUDED_TYPE = 0.45, 200, "conversation"
#: Questions of texts, None where there is none.
Client = Callable[[list[str]], list[str | None]]


def sample_key(id_: Column, weight: Column, seed: int = 42) -> Column:
    """Ascending keys draw without replacement: u has 52 bits of the MD5."""
    u = (F.conv(F.substring(F.md5(F.concat(id_.cast("string"), F.lit(f":{seed}"))), 1, 13), 16, 10).cast("long") + 1) / float(1 << 52)
    return -F.ln(u) / weight


def pool(memories: DataFrame, edges: DataFrame, types: list[str], min_chars: int = MIN_CHARS, seed: int = 42, weighted: bool = False) -> DataFrame:
    """(id, type, project, content, n_edges, key): active records of the types that are long enough and have edges; weighted: by the number of their edges."""
    if EXCLUDED_TYPE in types:
        raise ValueError(f"{EXCLUDED_TYPE} records are no gold")
    n = edges.groupBy(F.col("memory").alias("id")).agg(F.count("*").alias("n_edges"))
    active = memories.filter(F.col("type").isin(types) & F.col("superseded_by").isNull() & (F.length("content") >= min_chars))
    rows = active.join(n, "id").select("id", "type", "project", "content", "n_edges")
    return rows.withColumn("key", sample_key(F.col("id"), F.col("n_edges") if weighted else F.lit(1.0), seed))


def asked(rows: DataFrame, client: Client) -> DataFrame:
    """rows with question, from their contents in batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(question=pd.Series(client(pdf["content"].tolist()), index=pdf.index, dtype=object))

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, f"{names}, question string")


def overlap(question: Column, content: Column) -> Column:
    """Share of the question's content words that the content has; 1 for a question without any."""
    return F.when(F.size(content_words(question)) > 0, vocab_overlap(question, content)).otherwise(1.0)


@dataclass
class Gold:
    rows: DataFrame
    accepted: dict[str, int] = field(default_factory=dict)
    rejected_overlap: int = 0
    rejected_client: int = 0

    def shortfalls(self, quotas: dict[str, int]) -> dict[str, int]:
        return {t: n - self.accepted.get(t, 0) for t, n in quotas.items() if self.accepted.get(t, 0) < n}


def build(candidates: DataFrame, quotas: dict[str, int], client: Client, max_overlap: float = MAX_OVERLAP, oversample: float = 1.5) -> Gold:
    """Gold rows (id, type, project, n_edges, question, vocab_overlap) of candidates as pool() gives them."""
    spark = candidates.sparkSession
    ranked = candidates.withColumn("place", F.row_number().over(Window.partitionBy("type").orderBy("key", "id")))
    taken, got = dict.fromkeys(quotas, 0), Gold(None, dict.fromkeys(quotas, 0))
    exhausted: set[str] = set()
    while missing := {t: n - got.accepted[t] for t, n in quotas.items() if n > got.accepted[t] and t not in exhausted}:
        ask = {t: math.ceil(n * oversample) for t, n in missing.items()}
        within = [(F.col("type") == t) & (F.col("place") > taken[t]) & (F.col("place") <= taken[t] + n) for t, n in ask.items()]
        wanted = within[0]
        for w in within[1:]:
            wanted = wanted | w
        most = max(taken[t] + n for t, n in ask.items())
        part = ranked.filter(F.col("place") <= most).filter(wanted)  # the first filter ends the sort of a type early
        part = stored(asked(part, client), "gold-asked")
        share = F.round(overlap(F.col("question"), F.col("content")), 4)
        part = part.withColumn("vocab_overlap", share)
        ok = F.col("question").isNotNull() & (overlap(F.col("question"), F.col("content")) <= max_overlap)
        room = F.create_map(*[F.lit(x) for t, n in missing.items() for x in (t, n)])
        turn = F.row_number().over(Window.partitionBy("type").orderBy("place"))
        fresh = part.filter(ok).withColumn("turn", turn).filter(F.col("turn") <= room[F.col("type")])
        # questions behind the last one that is accepted are not looked at
        last = fresh.groupBy("type").agg(F.count("*").alias("n"), F.max("place").alias("last"))
        full = last.select("type", F.when(F.col("n") == room[F.col("type")], F.col("last")).alias("until"), "n")
        seen = part.join(full, "type", "left").filter(F.col("until").isNull() | (F.col("place") <= F.col("until")))
        counts = seen.groupBy("type").agg(F.max("n").alias("n"), F.count(F.when(F.col("question").isNull(), 1)).alias("none"), F.count(F.when(F.col("question").isNotNull() & ~ok, 1)).alias("over"), F.max(F.col("place")).alias("at"))
        sizes = {r["type"]: r["c"] for r in part.groupBy("type").agg(F.count("*").alias("c")).collect()}  # a row a type
        for r in counts.collect():
            got.accepted[r["type"]] += r["n"] or 0
            got.rejected_client += r["none"]
            got.rejected_overlap += r["over"]
        for t, n in ask.items():
            taken[t] += n
            if sizes.get(t, 0) < n:
                exhausted.add(t)
        new = fresh.select("id", "type", "project", "n_edges", "question", "vocab_overlap")
        got.rows = new if got.rows is None else got.rows.union(new)
    if got.rows is None:
        got.rows = spark.createDataFrame([], "id long, type string, project string, n_edges long, question string, vocab_overlap double")
    return got
