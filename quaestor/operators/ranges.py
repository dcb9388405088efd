"""Work on ordered rows dealt by sampled ranges: places, and the last value before each row."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once, in the folder of ``spark.checkpoint.dir``; a local master without that setting gets a folder of its own."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found:
            if not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            found = tempfile.mkdtemp(prefix="quaestor-")
        context.setCheckpointDir(found)
    return df.checkpoint()


def dealt(df: DataFrame, order: list[Column], ranges: int | None = None) -> DataFrame:
    """``df`` dealt by sampled ranges of an order and kept, with ``_range``: every row of a range sorts before those of the next."""
    return kept(df.repartitionByRange(*([ranges] if ranges else []), *order).withColumn("_range", F.spark_partition_id()))


def placed(df: DataFrame, order: list[Column], name: str = "n", ranges: int | None = None) -> DataFrame:
    """``df`` with each row's place in an order, from 1; one number a range meets in one task."""
    parts = dealt(df, order, ranges)
    counts = parts.groupBy("_range").agg(F.count("*").alias("_k"))
    offsets = counts.select("_range", F.coalesce(F.sum("_k").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    within = F.row_number().over(W.partitionBy("_range").orderBy(*order))
    return parts.join(F.broadcast(offsets), "_range").withColumn(name, (within + F.col("_o")).cast("long")).drop("_range", "_o")


def last_before(df: DataFrame, order: list[Column], value: str, name: str, ranges: int | None = None) -> DataFrame:
    """``df`` with the last value that isn't null at or before each row of an order of ascending columns; one value a range meets in one task."""
    parts = dealt(df, order, ranges)
    ends = parts.where(F.col(value).isNotNull()).withColumn("_n", F.row_number().over(W.partitionBy("_range").orderBy(*[c.desc() for c in order]))).where("_n = 1").select("_range", F.col(value).alias("_last"))
    every = parts.select("_range").distinct().join(ends, "_range", "left")
    carried = every.select("_range", F.last("_last", True).over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)).alias("_carried"))
    own = F.last(value, True).over(W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return parts.join(F.broadcast(carried), "_range").withColumn(name, F.coalesce(own, F.col("_carried"))).drop("_range", "_carried")
