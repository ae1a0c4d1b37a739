"""The bipartite graph of records and entities."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import normalize_entity, snippet
from ..sources.shared import stored


def link_entities(entities: DataFrame, edges: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities (norm, name) and edges (memory, norm) after pairs (memory, name, pos): the first spelling of a name wins, edges are unique."""
    new = pairs.select("memory", normalize_entity(F.col("name")).alias("norm"), "name", "pos").filter("norm <> ''")
    first = new.groupBy("norm").agg(F.min_by("name", "pos").alias("name")).join(entities, "norm", "left_anti")
    links = new.select("memory", "norm").distinct().join(edges, ["memory", "norm"], "left_anti")
    return entities.unionByName(first.select("norm", "name")), edges.unionByName(links)


def entities_of(edges: DataFrame, entities: DataFrame) -> DataFrame:
    return edges.join(entities, "entity").select("memory", "entity", "name")


def entity_counts(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity, name, n): distinct records of each entity; edges of deleted records count."""
    return edges.groupBy("entity").agg(F.countDistinct("memory").alias("n")).join(entities, "entity").select("entity", "name", "n")


def linked(memories: DataFrame, edges: DataFrame, entities: DataFrame) -> DataFrame:
    """(id, snippet, entities) of records with edges: names in order, joined by |. Orphan edges don't show."""
    names = edges.join(entities, "entity").groupBy("memory").agg(F.array_join(F.array_sort(F.collect_list("name")), "|").alias("entities"))
    return memories.join(names, F.col("id") == F.col("memory")).select("id", snippet(F.col("content"), 160).alias("snippet"), "entities")


def neighbors(seeds: DataFrame, edges: DataFrame, active: DataFrame | None = None, cap: int | None = None) -> DataFrame:
    """(seed, neighbor) pairs that share an entity, neither a seed; active restricts neighbours before the cap."""
    out = seeds.join(edges, F.col("seed") == F.col("memory")).select("seed", "entity").join(edges, "entity").select("seed", F.col("memory").alias("neighbor")).distinct()
    out = out.join(seeds.select(F.col("seed").alias("neighbor")), "neighbor", "left_anti")
    if active is not None:
        out = out.join(active.select(F.col("id").alias("neighbor")), "neighbor", "left_semi")
    if cap is not None:
        out = out.withColumn("k", F.row_number().over(Window.partitionBy("seed").orderBy("neighbor"))).filter(F.col("k") <= cap).drop("k")
    return out.select("seed", "neighbor")


#: Records of an entity beyond which it is a hub, whose records are not paired, and entities of a record beyond which it is wide, and paired by itself.
HUB, WIDE = 1_000, 64


def _partners(groups: DataFrame, memory_type: str) -> DataFrame:
    """(memory, n): for each row of groups (entity, memory, others) the other members of its entity that share none of others.

    The members of an entity meet in a task; two that share something there are told by sorting what each of them has.
    """

    def count(rows: pa.Table) -> pa.RecordBatch:
        entity = rows.column("entity").combine_chunks().dictionary_encode().indices.to_numpy()
        others = rows.column("others").combine_chunks()
        first = np.concatenate([[0], np.flatnonzero(np.diff(entity)) + 1])
        size = np.diff(np.concatenate([first, [len(entity)]]))
        group = np.repeat(np.arange(len(first)), size)
        n = size[group] - 1
        of = np.repeat(np.arange(len(entity)), others.value_lengths().to_numpy())
        what = others.flatten().dictionary_encode().indices.to_numpy()
        by = np.lexsort((of, what, group[of]))
        of, what = of[by], what[by]
        new = np.flatnonzero((np.diff(what) != 0) | (np.diff(group[of]) != 0)) + 1
        starts, ends = np.concatenate([[0], new]), np.concatenate([new, [len(of)]])
        now, met = -1, None
        for a, b in zip(*((e[ends - starts > 1]).tolist() for e in (starts, ends)), strict=True):
            g = group[of[a]]
            if g != now:
                if met is not None:
                    n[first[now] : first[now] + size[now]] -= met.sum(1)
                now, met = g, np.zeros((size[g], size[g]), bool)
            own = of[a:b] - first[g]
            met[np.ix_(own, own)] = True
            met[own, own] = False
        if met is not None:
            n[first[now] : first[now] + size[now]] -= met.sum(1)
        return pa.RecordBatch.from_arrays([rows.column("memory").combine_chunks(), pa.array(n.astype(np.int64))], ["memory", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            last = pc.equal(held.column("entity"), held.column("entity")[-1])
            cut = pc.index(last, True).as_py()  # the last entity may go on
            if cut:
                yield count(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None:
            yield count(held)

    return groups.repartition("entity").sortWithinPartitions("entity").mapInArrow(run, f"memory {memory_type}, n long")


def neighbor_degree(edges: DataFrame, hub: int = HUB, wide: int = WIDE) -> DataFrame:
    """(memory, n_edges, degree): entities of a record, and other records that share one.

    The records of an entity of `hub` records at most meet in a task.  Each comes
    with its smaller entities and its hubs, so that two records count where they
    meet first and no hub joins them: what is shuffled is a list for each edge,
    not a row for each pair.  What a record meets by hubs depends on the set of
    its hubs alone, so it is counted once for each such set: the records whose own
    set shares a hub with it.  Only records of more than `wide` entities, whose
    lists would be long, are paired with the records that they meet.
    """
    kind = edges.schema["memory"].dataType.simpleString()
    records = stored(edges.filter("entity is not null").groupBy("memory").agg(F.array_sort(F.collect_set("entity")).alias("entities")), "records")
    out = records.select("memory", F.size("entities").cast("long").alias("n_edges"), F.lit(0).cast("long").alias("n"))
    some = records.filter("memory is not null")
    big = stored(some.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("_n")).filter(F.col("_n") > hub).select("entity"), "big")
    rows = some.withColumn("hubs", F.slice("entities", 1, 0))
    if not big.isEmpty():
        hubs = stored(some.select("memory", F.explode("entities").alias("entity")).join(big, "entity").groupBy("memory").agg(F.array_sort(F.collect_set("entity")).alias("hubs")), "hubs")
        sets = hubs.groupBy("hubs").agg(F.count("*").alias("n"))
        each = sets.select("hubs", "n", F.explode("hubs").alias("hub"))
        met = each.select("hubs", "hub").join(each.select(F.col("hubs").alias("others"), "n", "hub"), "hub").select("hubs", "others", "n").distinct()
        reach = met.groupBy("hubs").agg((F.sum("n") - 1).alias("n"))
        out = out.union(hubs.join(reach, "hubs").select("memory", F.lit(0), "n"))
        rows = some.join(hubs, "memory", "left").select("memory", "entities", F.coalesce("hubs", F.slice("entities", 1, 0)).alias("hubs"))
    rows = rows.select("memory", F.array_except("entities", "hubs").alias("small"), "hubs", (F.size("entities") > wide).alias("wide"))
    if not big.isEmpty():
        rows = stored(rows, "records")
    at = rows.filter("not wide").select("memory", "small", "hubs", F.posexplode("small").alias("i", "entity"))
    groups = at.select("entity", "memory", F.concat(F.expr("slice(small, 1, i)"), "hubs").alias("others"))
    out = out.union(_partners(groups, kind).select("memory", F.lit(0), "n"))
    if not rows.filter("wide").isEmpty():
        x = rows.filter("wide").select("memory", "hubs", F.explode("small").alias("entity"))
        y = rows.select(F.col("memory").alias("other"), F.col("hubs").alias("theirs"), F.col("wide").alias("both"), F.explode("small").alias("entity"))
        pairs = x.join(y, "entity").filter((F.col("memory") != F.col("other")) & ~F.arrays_overlap("hubs", "theirs")).select("memory", "other", "both").distinct()
        ends = F.when(F.col("both"), F.array("memory")).otherwise(F.array("memory", "other"))
        out = out.union(pairs.select(F.explode(ends).alias("memory"), F.lit(0), F.lit(1)))
    return out.groupBy("memory").agg(F.sum("n_edges").alias("n_edges"), F.sum("n").alias("degree"))


def edgeless(memories: DataFrame, edges: DataFrame, types: list[str] | None = None) -> DataFrame:
    rows = memories if types is None else memories.filter(F.col("type").isin(types))
    return rows.join(edges.select(F.col("memory").alias("id")).distinct(), "id", "left_anti").select("id")


def ego_graph(seed: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst) edges of the one-hop subgraph of a record: its entities and all their records."""
    own = edges.join(seed, F.col("memory") == F.col("seed"), "left_semi").select("entity").distinct()
    return edges.join(own, "entity", "left_semi").select(F.col("memory").alias("src"), F.col("entity").alias("dst"))


def entity_filter(edges: DataFrame, entities: DataFrame, filters: DataFrame) -> DataFrame:
    """(filter, entity, memory): what stays lit for each of filters (filter), a name or an id of entities (entity, name).

    Of several entities that a filter names the smallest counts; one that names
    none, or an entity without records, has no rows, and 'all' is left to the
    caller, as it filters nothing.
    """
    keys = entities.select("entity", F.explode(F.array_distinct(F.array("name", F.col("entity").cast("string")))).alias("filter"))
    one = keys.join(filters.select("filter").distinct(), "filter", "left_semi").groupBy("filter").agg(F.min("entity").alias("entity"))
    return one.join(edges.select("entity", "memory").distinct(), "entity").select("filter", "entity", "memory")


def bipartite_nodes(edges: DataFrame) -> DataFrame:
    """(node, kind, degree) of both sides."""
    m = edges.groupBy(F.col("memory").alias("id")).agg(F.count("*").alias("degree")).select(F.concat(F.lit("m:"), F.col("id")).alias("node"), F.lit("memory").alias("kind"), "degree")
    e = edges.groupBy(F.col("entity").alias("id")).agg(F.count("*").alias("degree")).select(F.concat(F.lit("e:"), F.col("id")).alias("node"), F.lit("entity").alias("kind"), "degree")
    return m.union(e)
