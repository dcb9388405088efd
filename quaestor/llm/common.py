"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: A word is a run of characters other than the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only a local master may go without that setting; it gets a folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="quaestor-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder; its lineage ends there, so that the shuffles that led to it are deleted at once."""
    spark = df.sparkSession
    shared_dir(spark)
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        # The setting holds for what is planned under it.
        return df.select("*").checkpoint()
    finally:
        spark.conf.set(_CLEANUP, before)


def words(text: Column) -> Column:
    """The words of a text in order; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once for each row."""
    return F.transform(F.array(value), body)[0]


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns that an operator is about to add under these names."""
    clash = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in clash])


def boxed(df: DataFrame, **named: Column) -> DataFrame:
    """The columns ``named`` beside ``row``, a struct of all that ``df`` has: none of its names can clash with another."""
    return df.select(*[c.alias(k) for k, c in named.items()], F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def unboxed(df: DataFrame, like: DataFrame, **instead: Column) -> DataFrame:
    """The columns of ``like`` out of ``row``, some of them given anew."""
    return df.select(*[instead.get(c, F.col("row")[c]).alias(c) for c in like.columns])


def running(df: DataFrame, order: list[Column], **sums: Column) -> DataFrame:
    """Adds, under each name, the sum of a column over all rows that sort earlier.

    Rows are dealt by range, so no task holds more than its range; only one total
    for each range meets in a single task. ``order`` has to be a total order.
    """
    parts = cut(df.repartitionByRange(*order).withColumns({f"_v_{k}": e for k, e in sums.items()} | {"_range": F.spark_partition_id()}))
    earlier = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    totals = parts.groupBy("_range").agg(*[F.sum(f"_v_{k}").alias(f"_t_{k}") for k in sums])
    offsets = totals.select("_range", *[F.coalesce(F.sum(f"_t_{k}").over(earlier), F.lit(0)).alias(f"_o_{k}") for k in sums])
    within = W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = parts.join(F.broadcast(offsets), "_range")
    out = out.withColumns({k: F.coalesce(F.sum(f"_v_{k}").over(within), F.lit(0)) + F.col(f"_o_{k}") for k in sums})
    return out.drop("_range", *[f"_{p}_{k}" for k in sums for p in "vo"])


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bounds the Arrow batches that Python workers get."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each text begins; a null is an empty text."""
    if column.null_count:
        column = pc.fill_null(column, "")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the nodes of links (a, b); root is the smallest node connected.

    Alternates large and small stars: every node links its larger neighbours, then
    its smaller ones, to the smallest of them, until nothing changes. Minima are
    combined before the shuffle and joined back, so no neighbourhood meets in a row.
    """
    links = cut(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if links.isEmpty():
        return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    before = None
    while True:
        both = links.union(links.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select("v", "m").union(least).toDF("u", "v").where("u != v").distinct()
        links = cut(small)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


class Lookup:
    """A table from longs to doubles that answers for whole arrays; -1 can't be a key, and where none is known the answer is NaN."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.mask = (1 << self.bits) - 1
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, np.nan)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[left[free]]
            done = self.keys[at] == keys[left]
            self.values[at[done]] = values[left[done]]
            left, at = left[~done], (at[~done] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        wrong = lambda some: (self.keys[at[some]] != keys[some]) & (self.keys[at[some]] != -1)
        missed = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] != -1))
        while len(missed):
            at[missed] = (at[missed] + 1) & self.mask
            missed = missed[wrong(missed)]
        return self.values[at]
