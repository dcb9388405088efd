"""Queues and incremental work; every change is a new snapshot that one writer makes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranges import placed


def captured(own: DataFrame, related: list[DataFrame], existing: DataFrame, key: str) -> DataFrame:
    """Keys that changed themselves or through related rows, each once, those of ``existing`` only."""
    return reduce(DataFrame.union, related, own.select(key)).distinct().join(existing, key, "left_semi")


def enqueued(queue: DataFrame, asked: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """The queue (key, status, attempts) with the keys asked for pending anew, as far as they exist."""
    fresh = asked.select(key).distinct().join(existing, key, "left_semi").select(key, F.lit("pending").alias("status"), F.lit(0).alias("attempts"))
    return queue.join(fresh, key, "left_anti").unionByName(fresh)


def unclaimed(due: DataFrame, served: DataFrame, key: str) -> DataFrame:
    return due.join(served, key, "left_anti")


def skip_rule(targets: Column, running: Column, done: Column, newest: Column) -> Column:
    """Why an analysis isn't made: no_targets, already_running or nothing_new; else run."""
    return F.when(targets == 0, "no_targets").when(running, "already_running").when(done >= newest, "nothing_new").otherwise("run")


def in_chunks(df: DataFrame, order: str, size: int) -> DataFrame:
    """``df`` with ``chunk``, its place in the order over ``size``. Rows are numbered in sampled ranges, whose counts alone meet in one task; nulls come last."""
    place = ordinal(df, order).withColumn("chunk", F.floor((F.col("n") - 1) / size).cast("long"))
    return place.drop("n")


def ordinal(df: DataFrame, order: str, ranges: int | None = None) -> DataFrame:
    """``df`` with ``n``, each row's place by a column of any type that sorts, from 1; nulls come last, in no order of their own."""
    return placed(df.withColumn("_null", F.col(order).isNull()), [F.col("_null"), F.col(order)], ranges=ranges).drop("_null")


def ordinal_range(df: DataFrame, order: str, first: int, last: int, done: DataFrame) -> DataFrame:
    """The rows numbered ``first`` to ``last``, without those that a journal has as done."""
    return ordinal(df, order).where(F.col("n").between(first, last)).join(done, order, "left_anti")


def behind(accounts: DataFrame, posts: DataFrame, key: str, depth: int) -> DataFrame:
    """Accounts whose oldest post is newer than the ``depth``-th newest of all, or that have one alone."""
    mark = posts.orderBy(F.desc(key)).limit(depth).agg(F.min(key).alias("_m"), F.count("*").alias("_c"))
    return accounts.join(F.broadcast(mark)).where((F.col("oldest") > F.when(F.col("_c") == depth, F.col("_m"))) | (F.col("n") < 2)).drop("_m", "_c")


def moved(rows: DataFrame, gone: DataFrame, moves: DataFrame, key: str) -> DataFrame:
    """``rows`` without the keys that are gone, and under the keys that ``moves`` (key, to) gives."""
    left = rows.join(gone, key, "left_anti").join(moves, key, "left")
    return left.withColumn(key, F.coalesce("to", key)).drop("to")


def rewritten(old: DataFrame, new: DataFrame, key: str, index: str, keys: DataFrame) -> DataFrame:
    """Lists after some were written anew: those of ``keys`` have the new rows alone, whatever their length was."""
    return old.join(keys.distinct(), key, "left_anti").unionByName(new)


def one_active(rows: DataFrame, key: str, newest: list[str], open_: Column) -> DataFrame:
    """``rows`` with ``active``: the newest of a key, if it is open. The newest is combined before the shuffle."""
    last = rows.groupBy(key).agg(F.max(F.struct(*newest)).alias("_last"))
    return rows.join(last, key).withColumn("active", (F.struct(*newest) == F.col("_last")) & open_).drop("_last")


def set_status(rows: DataFrame, which: Column, status: str, column: str = "status") -> DataFrame:
    return rows.withColumn(column, F.when(F.coalesce(which, F.lit(False)), status).otherwise(F.col(column)))


def until_done(missing, fill, most: int = 100) -> int:
    """Backfills until ``missing()`` counts none or a round makes no progress; returns what is left."""
    left = missing()
    for _ in range(most):
        if not left:
            break
        fill()
        now = missing()
        if now >= left:
            return now
        left = now
    return left
