"""Picks, paging, set differences, checks and versioned state on DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .ranges import last_before


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``. A struct maximum is combined before the shuffle where the order allows; a window serves any order."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def keep_last(df: DataFrame, key: str, position: str) -> DataFrame:
    """Each key's last row at its first row's position; aggregated before the shuffle."""
    rest = [c for c in df.columns if c not in (key, position)]
    picked = df.groupBy(key).agg(F.max_by(F.struct(*rest), position).alias("_r"), F.min(position).alias(position))
    return picked.select(key, position, "_r.*")


def neighbours(df: DataFrame, keys: list[str], order: list[Column], item: str) -> DataFrame:
    """Position, total, previous and next item within each key."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumns({"position": F.row_number().over(w), "total": F.count("*").over(W.partitionBy(*keys)), "previous": F.lag(item).over(w), "next": F.lead(item).over(w)})


def tercile(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``tier`` 1 to 3 by the order statistics at floor((n - 1) * q), from counts of distinct values."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_k"))
    by = W.partitionBy(*keys)
    seen = counts.select(*keys, F.col(value).alias("_v"), F.sum("_k").over(by.orderBy(value).rowsBetween(W.unboundedPreceding, 0)).alias("_seen"), F.sum("_k").over(by).alias("_n"))
    at = lambda q: F.min(F.when(F.col("_seen") > F.floor((F.col("_n") - 1) * F.lit(q)), F.col("_v")))
    bounds = seen.groupBy(*keys).agg(at(1 / 3).alias("_low"), at(2 / 3).alias("_high"))
    tier = F.when(F.col(value) <= F.col("_low"), 1).when(F.col(value) <= F.col("_high"), 2).otherwise(3)
    return df.join(bounds, keys).withColumn("tier", tier).drop("_low", "_high")


def as_of(points: DataFrame, starts: DataFrame, key: str, ranges: int | None = None) -> DataFrame:
    """``points`` with ``start``, the largest key of ``starts`` that isn't above their own, of any type that sorts; those before all starts go, as do null keys.

    Only distinct keys are sorted, in sampled ranges whose last starts are carried on;
    a key that very many points share is met by a plain join.
    """
    keys, firsts = points.select(F.col(key).alias("_k")).where("_k is not null").distinct(), starts.select(F.col(key).alias("_k")).where("_k is not null").distinct()
    both = keys.select("_k", F.lit(1).alias("_point"), F.lit(None).cast(firsts.schema[0].dataType).alias("_s")).unionByName(firsts.select("_k", F.lit(0).alias("_point"), F.col("_k").alias("_s")))
    found = last_before(both, [F.col("_k"), F.col("_point")], "_s", "start", ranges).where("_point = 1 and start is not null").select("_k", "start")
    return points.join(found, F.col(key) == F.col("_k")).drop("_k")


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """A page of rows; ``order`` has to be total. Spark keeps only the first rows of each partition."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def set_difference(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, change): added or removed."""
    return new.join(old, key, "left_anti").select(key, F.lit("added").alias("change")).unionByName(old.join(new, key, "left_anti").select(key, F.lit("removed").alias("change")))


def orphans(child: DataFrame, parents: list[tuple[str, str, DataFrame, str]]) -> DataFrame:
    """(rule, violations) for (rule, column, parent, its key): rows whose reference is missing or null, zeros included.

    Each column's references are counted before they meet their own parent, under
    their own type; so a small parent is broadcast though another one is large.
    """

    def broken(rule: str, column: str, parent: DataFrame, key: str) -> DataFrame:
        held = child.groupBy(F.col(column).alias("_k")).agg(F.count("*").alias("n"))
        missing = held.join(parent.select(F.col(key).alias("_p")), F.col("_k") == F.col("_p"), "left_anti")
        return missing.agg(F.lit(rule).alias("rule"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("violations"))

    return reduce(DataFrame.unionByName, [broken(*p) for p in parents])


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(k, n): each table's rows."""
    return reduce(DataFrame.unionByName, [df.agg(F.lit(k).alias("k"), F.count("*").alias("n")) for k, df in tables.items()])


def mismatches(actual: DataFrame, expected: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose value isn't the one expected, missing sides included."""
    a, e = actual.select(key, F.col(value).alias("actual")), expected.select(key, F.col(value).alias("expected"))
    return a.join(e, key, "full").where(~F.col("actual").eqNullSafe(F.col("expected")))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def merged(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """An upsert: the new rows, and the old ones of other keys."""
    return old.join(new, keys, "left_anti").unionByName(new)


def changed(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys of new rows and of rows in which one of ``columns`` changed."""
    same = reduce(lambda a, b: a & b, [F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")) for c in columns])
    known = old.withColumn("_known", F.lit(True))
    return new.alias("n").join(known.alias("o"), key, "left").where(F.col("_known").isNull() | ~same).select(key)


def sync_plan(drafts: DataFrame, existing: DataFrame, key: str, digest: str, model: str | None = None) -> DataFrame:
    """(key, action): insert, update, delete or keep, by comparing digests and, if named, models; a null digest is a value like any other."""
    compared = [digest, *([model] if model else [])]
    d = drafts.select(key, F.lit(True).alias("_drafted"), *[F.col(c).alias(f"_d_{c}") for c in compared])
    e = existing.select(key, F.lit(True).alias("_indexed"), *[F.col(c).alias(f"_e_{c}") for c in compared])
    same = reduce(lambda a, b: a & b, [F.col(f"_d_{c}").eqNullSafe(F.col(f"_e_{c}")) for c in compared])
    action = F.when(F.col("_indexed").isNull(), "insert").when(F.col("_drafted").isNull(), "delete").when(~same, "update").otherwise("keep")
    return d.join(e, key, "full").select(key, action.alias("action"))


def carried(assigned: DataFrame, targets: DataFrame, item: str, group: str, position: str) -> DataFrame:
    """Assignments of items still in ``targets``, the first group of each; items without one get null."""
    first = assigned.groupBy(item).agg(F.min_by(group, F.struct(position, group)).alias(group))
    return targets.select(item).join(first, item, "left")


def within_limit(events: DataFrame, keys: list[str], ts: str, event: str, window: str, limit: int) -> DataFrame:
    """Each event with ``count`` so far in its tumbling window and whether it is ``allowed``."""
    windowed = events.withColumn("window_start", F.window(ts, window)["start"])
    w = W.partitionBy(*keys, "window_start").orderBy(ts, event)
    return windowed.withColumn("count", F.row_number().over(w)).withColumn("allowed", F.col("count") <= limit)


def claimed(jobs: DataFrame, now: Column, limit: int, status: str = "status", due: str = "due_at", locked: str = "locked_at", stuck: str = "10 minutes") -> DataFrame:
    """The oldest jobs that are pending and due, or have been running for too long."""
    free = (F.col(status) == "pending") & (F.col(due) <= now) | (F.col(status) == "running") & (F.col(locked) < now - F.expr(f"interval {stuck}"))
    return jobs.where(free).orderBy(due, "job_id").limit(limit)


def retried(attempts: Column, most: int = 5) -> Column:
    """(status, wait_minutes) after a failure: 1, 2, 4 ... up to 60 minutes, failed at ``most`` attempts."""
    return F.struct(F.when(attempts >= most, "failed").otherwise("pending").alias("status"), F.least(F.lit(60), F.pow(F.lit(2), attempts - 1)).cast("int").alias("wait_minutes"))


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with each row's place in an order, from 1; for lists of a page's size, which one task sorts."""
    return df.withColumn(name, F.row_number().over(W.orderBy(*order)).cast("long"))


def top(df: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """The first rows of each key with their place ``n``; Spark keeps only so many of each in a partition before the shuffle."""
    return df.withColumn("n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("n") <= most)
