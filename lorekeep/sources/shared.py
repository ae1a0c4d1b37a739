"""The folder that driver and executors share, and tables kept there between steps."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; only where it is unset, as in tests, a local folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        import tempfile

        base = f"file://{tempfile.gettempdir()}/lorekeep-shared"
    return base.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/lorekeep-{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of a Hadoop file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop_stored(df: DataFrame) -> None:
    """Delete the files of a table that stored() returned."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        drop_path(df.sparkSession, folder)


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files of finished steps now: it does so when the driver's JVM collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
