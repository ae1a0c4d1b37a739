"""The composed save: a sink that prepares, guards and appends a batch once, tells what became of every item, and reflects at a cadence.

A store is a folder with records, outcomes and events, each a Parquet table with
a folder a batch.  Outcomes are written last, so they are the commit: readers see
records and events of batches with outcomes only, and a batch number that has
outcomes is answered from them.  A batch that broke off halfway is written anew.
Ids come from the batch's number and the item's position, so a repeated run gives
the same ones.

The guard finds the nearest record of each item, among those of earlier batches
and the items before it in its own batch; if it is nearer than the limit and of
the same project and type, the item is a duplicate, and its answer is the record
that this one leads to.  Of equally near ones a stored record comes first, then
the earliest item.  Items of equal vectors are compared once, and only pairs
within the limit make rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tiles
from ..operators.records import prepared
from ..sources.shared import drop_path, stored
from .flows import fan_out

#: Positions within a batch are below this.
BATCH_ITEMS = 1 << 32
OUTCOME = "pos long, id long, saved boolean, error string"
RECORD = "id long, content string, title string, type string, project string, session_id string, ts timestamp_ntz, salience double, vector array<double>"


def followed(links: DataFrame) -> DataFrame:
    """(item, root) of links (item, to): the end of the way, by steps that double."""
    now = stored(links.select("item", F.col("to").alias("root")), "links")
    while True:
        ahead = now.select(F.col("item").alias("root"), F.col("root").alias("next"))
        now = stored(now.join(ahead, "root", "left").select("item", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "links")
        if now.filter("moved").isEmpty():
            return now.select("item", "root")
        now = now.select("item", "root")


def duplicates(items: DataFrame, records: DataFrame, max_distance: float) -> DataFrame:
    """(pos, id, to): duplicates among items (pos, project, type, vector), of a stored record (id) or an earlier item (to)."""
    first = items.filter("vector is not null").groupBy("vector").agg(F.min("pos").alias("first"))
    classes = stored(first.select(F.col("first").alias("id"), "vector"), "classes")
    own, stock = tiles.tiled(classes), tiles.tiled(records.select("id", "vector"))
    near = tiles.topk(own, stock, 1).select(F.col("query").alias("first"), F.struct((-F.col("sim")).alias("m"), F.lit(0).alias("rank"), "id").alias("by"))
    before = tiles.similar(own, 1 - max_distance, over=True).select(F.col("b").alias("first"), F.struct((-F.col("sim")).alias("m"), F.lit(1).alias("rank"), F.col("a").alias("id")).alias("by"))
    nearest = near.union(before).groupBy("first").agg(F.min("by").alias("by"))
    rows = items.join(first, "vector").join(nearest, "first", "left").select("pos", "project", "type", "first", "vector", "by")
    itself = F.aggregate("vector", F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double"))
    copy = F.struct((-itself).alias("m"), F.lit(1).alias("rank"), F.col("first").alias("id"))
    best = F.when(F.col("pos") == F.col("first"), F.col("by")).otherwise(F.least(F.coalesce("by", copy), copy))
    chosen = rows.select("pos", "project", "type", best.alias("by")).filter(F.col("by.m") < -(1 - max_distance)).select("pos", "project", "type", "by.rank", F.col("by.id").alias("near"))
    of = records.select(F.lit(0).alias("rank"), F.col("id").alias("near"), F.col("project").alias("p"), F.col("type").alias("t"))
    of = of.union(items.select(F.lit(1), F.col("pos"), "project", "type"))
    same = F.col("project").eqNullSafe(F.col("p")) & F.col("type").eqNullSafe(F.col("t"))
    found = chosen.join(of, ["rank", "near"]).filter(same)
    return found.select("pos", F.when(F.col("rank") == 0, F.col("near")).alias("id"), F.when(F.col("rank") == 1, F.col("near")).alias("to"))


@dataclass
class RecordStore:
    """Records in `path`; max_distance: of duplicates; every: saved records between two calls of reflect (0: never)."""

    spark: SparkSession
    path: str
    max_distance: float = 0.03
    every: int = 0
    reflect: Callable[[RecordStore, int], None] | None = None

    def _exists(self, path: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def committed(self, batch: int) -> bool:
        return self._exists(f"{self.path}/outcomes/batch={batch}/_SUCCESS")

    def _table(self, name: str, schema: str) -> DataFrame:
        if not self._exists(f"{self.path}/{name}"):
            return self.spark.createDataFrame([], f"{schema}, batch long")
        return self.spark.read.schema(f"{schema}, batch long").parquet(f"{self.path}/{name}")

    def outcomes(self) -> DataFrame:
        return self._table("outcomes", OUTCOME)

    def _visible(self, name: str, schema: str) -> DataFrame:
        return self._table(name, schema).join(self.outcomes().select("batch").distinct(), "batch", "left_semi")

    def records(self) -> DataFrame:
        return self._visible("records", RECORD)

    def events(self) -> DataFrame:
        return self._visible("events", "id long, type string, project string, snippet string, duplicate boolean")

    def save(self, incoming: DataFrame, batch: int) -> DataFrame:
        """(pos, id, saved, error) of every item of incoming (pos, content, title, type, project, session_id, ts, salience, vector), pos being distinct.

        A duplicate's id is that of the record it repeats; an item with an error
        has none.  The second call of a batch changes nothing.
        """
        if not self.committed(batch):
            self._write(incoming, batch)
        return self.outcomes().filter(F.col("batch") == batch).select("pos", "id", "saved", "error")

    def _write(self, incoming: DataFrame, batch: int) -> None:
        vector = F.col("vector").cast("array<double>")
        items = stored(prepared(incoming).select(F.col("pos").cast("long").alias("pos"), "content", "title", "type", "project", "session_id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.coalesce("salience", F.lit(0.5)).cast("double").alias("salience"), vector.alias("vector"), "error"), "incoming")
        good = items.filter("error is null")
        old = self.records()
        twice = stored(duplicates(good.select("pos", "project", "type", "vector"), old.select("id", "project", "type", "vector"), self.max_distance), "duplicates")
        ends = followed(twice.filter("to is not null").select(F.col("pos").alias("item"), "to"))
        new_id = F.lit(batch * BATCH_ITEMS) + F.col("pos")
        root = F.coalesce("root", "pos")
        told = twice.select("pos", F.col("id").alias("known"), F.lit(True).alias("again"))
        rows = items.join(ends, F.col("item") == F.col("pos"), "left").withColumn("end", root).join(told.select(F.col("pos").alias("end"), "known"), "end", "left").join(told.select("pos", "again"), "pos", "left")
        rows = rows.withColumn("saved", F.col("error").isNull() & F.col("again").isNull())
        rows = rows.withColumn("id", F.when(F.col("error").isNull(), F.coalesce("known", F.lit(batch * BATCH_ITEMS) + F.col("end"))))
        rows = stored(rows, "saves")
        saved = rows.filter("saved").withColumn("id", new_id)
        saved.select(*[c.split()[0] for c in RECORD.split(", ")]).write.mode("overwrite").parquet(f"{self.path}/records/batch={batch}")
        heard = rows.filter("error is null").withColumn("duplicate", ~F.col("saved"))
        fan_out(heard).select("id", "type", "project", "snippet", "duplicate").write.mode("overwrite").parquet(f"{self.path}/events/batch={batch}")
        if self._exists(f"{self.path}/outcomes/batch={batch}"):
            drop_path(self.spark, f"{self.path}/outcomes/batch={batch}")
        rows.select("pos", "id", "saved", "error").write.parquet(f"{self.path}/outcomes/batch={batch}")

    def due(self, batch: int) -> int:
        """How many times `every` saved records were completed by this batch; from the outcomes, so a restart doesn't lose count."""
        if not self.every:
            return 0
        n = self.outcomes().filter("saved").agg(F.count(F.when(F.col("batch") < batch, 1)).alias("before"), F.count(F.when(F.col("batch") <= batch, 1)).alias("now")).first()
        return n["now"] // self.every - n["before"] // self.every

    def sink(self) -> Callable[[DataFrame, int], None]:
        """For foreachBatch: saves each micro-batch and reflects when it is due.  A batch that Spark repeats is not saved again; its reflection is, unless it is marked as done."""

        def run(rows: DataFrame, batch: int) -> None:
            self.save(rows, batch)
            mark = f"{self.path}/reflected/batch={batch}"
            if self.reflect and self.due(batch) and not self._exists(mark):
                self.reflect(self, batch)
                self.spark.range(1).write.mode("overwrite").parquet(mark)

        return run
