"""Merkle manifest of a table: a node store on disk, and proofs read from it by coordinate.

Leaves are sorted in runs (a range partition each) and numbered within their
group; the runs stream into the Parquet folder level=0 of the store.  Each
level is made from the previous one, which is read in its order: FAN consecutive
nodes of a group become one.  Groups end when a node is left, their subroot; the
subroots, in order of their groups, are the leaves of a second store with one
group, which ends at the root.

A node has a coordinate (group, level, place) and holds the hashes below it, so
a proof needs no search: merge joins on the coordinate carry the way to the root
down from level to level, and the bottom one gives every leaf's proof.  Nothing
but the number of levels depends on the size of the table, no task holds more
than a run of FAN nodes at once, and the driver sees counts only.

Columns that the manifest doesn't cover, of whatever name, take no part.  Null
values have a mark of their own, so a null text and an empty one differ, a null
group comes before all others, and rows with a null id come first in theirs.
Rows of equal id in a group are ordered by their leaves; equal rows each have a
place.  An empty table gives no rows.  A text of any length is one value of a
row and held once or twice.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import fresh_path, stored
from .textbuf import first_column_named

FAN = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Way of a node to the root: what stands left and right of it in its run, level by level.
WAY = "array<struct<left:string,right:string>>"


def leaf_hash(fields: list[Column]) -> Column:
    """SHA-256 of the fields, each its UTF-8 byte count, a colon and the value, or - if null."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def group_key(c: Column) -> Column:
    """A non-null key in the order null first, then bytewise."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


def numbered(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """rows with place, from 0 among those of their group, and n, the group's size; from a stored table of sorted runs.

    Runs are range partitions, whose rows are counted by group; the counts of
    earlier runs give where a run begins.  Rows that are equal in all of order
    are dealt to several runs, as their places can be exchanged.
    """
    at, run, tie = (first_column_named(rows.columns, c) for c in ("at", "run", "tie"))
    spread = rows.withColumn(tie, F.monotonically_increasing_id())
    runs = spread.repartitionByRange(by, *order, tie).sortWithinPartitions(by, *order, tie).drop(tie)
    runs = stored(runs.withColumns({at: F.monotonically_increasing_id(), run: F.spark_partition_id()}), "merkle-runs")
    sizes = runs.groupBy(by, run).agg(F.min(at).alias("first"), F.count("*").alias("rows"))
    group = Window.partitionBy(by)  # a row a run
    before = F.sum("rows").over(group.orderBy(run).rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(by, run, (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("rows").over(group).alias("n"))
    return runs.join(starts, [by, run]).withColumn("place", F.col(at) + F.col("shift")).drop(at, run, "shift")


@dataclass
class Store:
    """Levels of one or more trees: rows (key, place, n, hash, below) in path/level=L; n: nodes of the group at that level."""

    path: str
    levels: int
    spark: object

    def level(self, k: int) -> DataFrame:
        return self.spark.read.schema("key string, place long, n long, hash string, below array<string>").parquet(f"{self.path}/level={k}")

    def tops(self) -> DataFrame:
        """(key, hash, level) of every group's last node."""
        out = None
        for k in range(self.levels):
            top = self.level(k).filter("n = 1").select("key", "hash", F.lit(k).alias("level"))
            out = top if out is None else out.union(top)
        return out


def build(leaves: DataFrame, what: str) -> Store:
    """The store of leaves (key, place, n, hash) as numbered() places them."""
    spark = leaves.sparkSession
    path = fresh_path(spark, what)
    first = leaves.select("key", "place", "n", "hash", F.lit(None).cast("array<string>").alias("below"))
    first.sortWithinPartitions("key", "place").write.parquet(f"{path}/level=0")
    store = Store(path, 1, spark)
    while True:
        more = store.level(store.levels - 1).filter("n > 1")
        if more.isEmpty():
            return store
        runs = more.groupBy("key", F.floor(F.col("place") / FAN).alias("place")).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("place", "hash"))).alias("run"))
        below = F.col("run.hash")
        up = runs.select("key", "place", F.ceil(F.col("n") / FAN).alias("n"), F.sha2(F.array_join(below, ""), 256).alias("hash"), below.alias("below"))
        up.sortWithinPartitions("key", "place").write.parquet(f"{path}/level={store.levels}")
        store.levels += 1


def with_ways(leaves: DataFrame, store: Store, tops: DataFrame) -> DataFrame:
    """leaves (key, place, ...) with their ways; tops: (key, way, ...), the way of each group's last node and what else its leaves get.

    Ways move with the parents of leaves, not with the leaves, of which there are FAN times as many.
    """
    more = [c for c in tops.columns if c not in ("key", "way")]
    ends = stored(tops.join(store.tops().select("key", "level"), "key"), "merkle-tops")

    def step(i: Column) -> Column:
        beside = F.struct(F.array_join(F.slice("below", 1, i), "").alias("left"), F.array_join(F.slice("below", i + 2, FAN), "").alias("right"))
        return F.when(F.col("below").isNull(), F.col("way")).otherwise(F.concat(F.array(beside), F.col("way")).cast(WAY))

    here = ends.filter(F.col("level") == 0).select("key", F.lit(0).cast("long").alias("parent"), F.lit(None).cast("array<string>").alias("below"), "way", *more)  # leaves without a parent
    down = None
    for k in range(store.levels - 1, 0, -1):
        begin = ends.filter(F.col("level") == k).select("key", F.lit(0).cast("long").alias("place"), "way", *more)
        level = begin if down is None else stored(down.union(begin), "merkle-ways")
        met = level.join(store.level(k).select("key", "place", "below").hint("merge"), ["key", "place"])
        if k == 1:
            here = here.union(met.select("key", F.col("place").alias("parent"), "below", "way", *more))
        each = met.select("key", "place", "way", "below", *more, F.posexplode("below").alias("i", "own"))
        down = each.select("key", (F.col("place") * FAN + F.col("i")).alias("place"), step(F.col("i")).alias("way"), *more)
    below = leaves.withColumn("parent", F.floor(F.col("place") / FAN)).join(here.hint("merge"), ["key", "parent"])
    return below.withColumn("way", step((F.col("place") % FAN).cast("int"))).drop("below", "parent")


def fold(leaf: Column, way: Column) -> Column:
    """The root that leaf leads to."""
    return F.aggregate(way, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def proof_hash(way: Column) -> Column:
    return F.sha2(F.array_join(F.transform(way, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def manifest(docs: DataFrame, id_col: str = "doc_id", group: str = "lang", fields: tuple[str, ...] = FIELDS, tampered: dict[str, Column] | None = None) -> DataFrame:
    """(id, leaf, subroot, root, way, proof_sha256, folded_root, verified) of every row of docs.

    tampered: changed values by field; folded_root is that of the changed row and
    the way of the original one.  Where it is not the root, verified is false.
    """
    tampered = tampered or {}
    values = [F.col(f) for f in fields]
    changed = [tampered.get(f, F.col(f)) for f in fields]
    rows = docs.select(F.col(id_col).alias("id"), group_key(F.col(group)).alias("key"), leaf_hash(values).alias("hash"), leaf_hash(changed).alias("changed"))
    leaves = stored(numbered(rows, "key", ["id", "hash"]), "merkle-leaves")
    store = build(leaves, "merkle-nodes")
    subroots = store.tops().select(F.lit("").alias("key"), F.col("key").alias("group"), "hash")
    placed = stored(numbered(subroots, "key", ["group"]), "merkle-subroots")
    upper = build(placed, "merkle-upper")
    root = upper.tops().select("key", F.array().cast(WAY).alias("way"), F.col("hash").alias("root"))
    over = with_ways(placed.select("key", "place", "group", F.col("hash").alias("subroot")), upper, root)
    out = with_ways(leaves.select("key", "place", "id", "hash", "changed"), store, over.select(F.col("group").alias("key"), "way", "subroot", "root"))
    out = out.withColumn("folded_root", fold(F.col("changed"), F.col("way")))
    return out.select("id", F.col("hash").alias("leaf"), "subroot", "root", "way", proof_hash(F.col("way")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def lowered_where(divisor: int, id_col: str = "doc_id", text: str = "text") -> Column:
    """The text, with A-Z in lower case where divisor divides the crc32 of the id as text; rows without an id keep theirs."""
    hit = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % divisor == 0, F.lit(False))
    return F.when(hit, F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col(text))
