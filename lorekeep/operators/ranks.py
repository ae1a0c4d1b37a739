"""Positions in an order, without a window over a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def positions(rows: DataFrame, by: list[str], bucket: Column, order: list[Column | str], name: str) -> DataFrame:
    """rows with name: the place, from 1, of each row among those of equal by.

    The order goes by bucket first and then by order, so bucket has to be a coarser
    form of it (a day of a time, a prefix of a hash).  A task sorts one bucket of
    one group; what comes before a bucket is the sum of the sizes of earlier ones.
    Nulls in by are a group, those in bucket come first.
    """
    keyed = rows.withColumn("_bucket", bucket)
    sizes = keyed.groupBy(*by, "_bucket").agg(F.count("*").alias("_size"))
    earlier = F.sum("_size").over(Window.partitionBy(*(by or [F.lit(0)])).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    before = sizes.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_bucket").alias("_of"), F.coalesce(earlier, F.lit(0)).alias("_before"))
    own = keyed.withColumn("_own", F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy(*order)))
    same = F.col("_bucket").eqNullSafe(F.col("_of"))
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    return own.join(before, same).withColumn(name, F.col("_before") + F.col("_own")).select(*rows.columns, name)
