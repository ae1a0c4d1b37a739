"""Facts from model output: parsing, gates, deduplication and curation with an injected decision."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_entities, json_object, strip_fence, strip_ws

FACT_TYPES = ["decision", "solution", "preference", "fact", "pattern", "error_lesson"]
IGNORE_ABOVE, ADD_BELOW, SAME_BATCH = 0.92, 0.78, 0.90  # fixed values
FACT_SCHEMA = "facts array<struct<content: string, salience: double, event_time: string, entities: array<string>, fact_type: string>>"


def parse_facts(raw: DataFrame, max_facts: int = 10) -> DataFrame:
    """(id, pos, content, salience, fact_type, entities) of raw (id, text): fenced JSON is tolerated.

    Salience is clamped to [0, 1] (missing or 0: 0.5), unknown types become
    decision, empty contents go, and the max_facts most salient stay. Text
    without a facts list gives no rows.
    """
    facts = F.from_json(strip_fence(F.col("text")), FACT_SCHEMA)["facts"]
    rows = raw.select("id", F.posexplode(facts).alias("i", "f")).select("id", "i", strip_ws(F.coalesce("f.content", F.lit(""))).alias("content"), "f.salience", "f.fact_type", "f.entities").filter("content <> ''")
    s = F.when(F.coalesce("salience", F.lit(0.0)) == 0, 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), "salience")))
    kind = F.when(F.col("fact_type").isin(FACT_TYPES), F.col("fact_type")).otherwise("decision")
    rows = rows.select("id", F.struct((-s).alias("order"), "i", "content", s.alias("salience"), kind.alias("fact_type"), clean_entities(F.coalesce("entities", F.array().cast("array<string>"))).alias("entities")).alias("f"))
    top = rows.groupBy("id").agg(F.slice(F.array_sort(F.collect_list("f")), 1, max_facts).alias("fs"))
    return top.select("id", F.posexplode("fs").alias("pos", "f")).select("id", "pos", "f.content", "f.salience", "f.fact_type", "f.entities")


def parse_entities(c: Column) -> Column:
    """Cleaned entity names of an {"entities": [...]} answer; empty for anything else."""
    names = F.from_json(json_object(strip_fence(c)), "entities array<string>")["entities"]
    return clean_entities(F.coalesce(names, F.array().cast("array<string>")))


def dedup_batch(vectors: np.ndarray, salience: list[float], threshold: float = SAME_BATCH) -> list[bool]:
    """Which facts of one batch stay: of two that are similar the more salient, of equals the first."""
    keep = [True] * len(salience)
    sims = vectors @ vectors.T if len(salience) else vectors
    for i in range(len(salience)):
        for j in range(i + 1, len(salience)):
            if keep[i] and keep[j] and sims[i, j] > threshold:
                keep[j if salience[i] >= salience[j] else i] = False
    return keep


def always_add(old: str, new: str, sim: float) -> str:
    return "ADD"


def curate(drafts: DataFrame, existing: DataFrame, decide: Callable[[str, str, float], str] = always_add, top: int = 5) -> DataFrame:
    """(project, id, decision, other, sim) for drafts (project, id, pos, content, vector) against existing facts (project, id, content, vector).

    Drafts of a project are taken in order and see what earlier ones added: more
    than 0.92 similar to the nearest is IGNORE, less than 0.78 ADD, between them
    decide(old, new, sim) chooses ADD, UPDATE, MERGE or IGNORE. UPDATE and MERGE
    take the old fact out of later comparisons. A project is one group, as the
    result depends on the order.
    """

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        facts = [(r.id, r.content, np.asarray(r.vector, float)) for r in right.sort_values("id").itertuples()]
        out = []
        for d in left.sort_values(["pos", "id"]).itertuples():
            v, other, sim, decision = np.asarray(d.vector, float), None, 0.0, "ADD"
            if facts:
                sims = np.array([f[2] @ v for f in facts])
                best = int(np.argmax(sims))
                other, sim = facts[best][0], float(sims[best])
                if sim > IGNORE_ABOVE:
                    decision = "IGNORE"
                elif sim >= ADD_BELOW:
                    decision = decide(facts[best][1], d.content, sim)
                if decision in ("UPDATE", "MERGE"):
                    facts.pop(best)
            if decision != "IGNORE":
                facts.append((d.id, d.content, v))
            out.append((key[0], d.id, decision, other, round(sim, 6)))
        return pd.DataFrame(out, columns=["project", "id", "decision", "other", "sim"]).astype({"other": "Int64"})

    return drafts.groupBy("project").cogroup(existing.groupBy("project")).applyInPandas(run, "project string, id long, decision string, other long, sim double")
