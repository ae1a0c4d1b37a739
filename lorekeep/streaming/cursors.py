"""Durable positions: a cursor behind which a reader goes on, and a count of rows that calls an action at every so many.

State is a Parquet table with a folder a step, of which Spark's commit file tells
whether it is whole; a step that broke off is written anew.  So the driver may end
at any time, and what was done is neither lost nor done again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .flows import digest_since


def _whole(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


@dataclass
class Cursor:
    """The place (ts, event_id) up to which events have been read; the newest step counts."""

    spark: SparkSession
    path: str

    def _step(self) -> int:
        step = 0
        while _whole(self.spark, f"{self.path}/step={step}"):
            step += 1
        return step

    def at(self) -> Row | None:
        step = self._step()
        return self.spark.read.parquet(f"{self.path}/step={step - 1}").first() if step else None

    def behind(self, events: DataFrame) -> DataFrame:
        """Rows of events (ts, event_id, ...) that have not been read, in order; all before the first commit."""
        last = self.at()
        if last is None:
            return events.orderBy("ts", "event_id")
        return digest_since(events, F.lit(last["ts"]), F.lit(last["event_id"]))

    def commit(self, rows: DataFrame) -> None:
        """Set the place to the last of rows; without rows it stays."""
        last = rows.agg(F.max(F.struct("ts", "event_id")).alias("last")).filter("last is not null").select("last.*").collect()  # one row
        if last:
            self.spark.createDataFrame(last, rows.select("ts", "event_id").schema).write.mode("overwrite").parquet(f"{self.path}/step={self._step()}")


def every_nth(n: int, action: Callable[[DataFrame, int], None], path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that calls action whenever another n rows have come, counted in path across restarts.

    A batch that Spark repeats is not counted again; its action runs again only
    if it had not ended.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        if not _whole(spark, f"{path}/rows/epoch={epoch}"):
            batch.agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/rows/epoch={epoch}")
        counts = spark.read.schema("n long, epoch long").parquet(f"{path}/rows")
        r = counts.agg(F.sum(F.when(F.col("epoch") < epoch, F.col("n"))).alias("before"), F.sum(F.when(F.col("epoch") <= epoch, F.col("n"))).alias("now")).first()
        if r["now"] // n > (r["before"] or 0) // n and not _whole(spark, f"{path}/done/epoch={epoch}"):
            action(batch, epoch)
            spark.range(1).write.mode("overwrite").parquet(f"{path}/done/epoch={epoch}")

    return run
