"""Points in time and the sessions around them: the one that holds a point, the one before and the one after.

Times are dates, timestamps (with or without zone) or numbers, compared as they are.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranges import kept, last_before

#: Bins of time, and distinct points that are few enough to be sent to all tasks.
BINS, FEW = 512, 100_000


def _number(df: DataFrame, column: str) -> Column:
    kind = dict(df.dtypes)[column]
    c = F.col(column)
    if kind == "date":
        return F.unix_date(c).cast("double")
    if kind.startswith("timestamp"):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    return c.cast("double")


def _exact(df: DataFrame, column: str) -> Column:
    """Times as Python compares them: days and microseconds as longs, numbers as they are."""
    kind = dict(df.dtypes)[column]
    if kind == "date":
        return F.unix_date(column).cast("long")
    return F.unix_micros(F.col(column).cast("timestamp")) if kind.startswith("timestamp") else F.col(column)


def _swept(rows: pa.Table) -> pa.Table:
    """The best span for each point of a bin: spans are stacked by start and key, and those that have ended leave the top."""
    point, times, ends, keys = (rows.column(c).to_pylist() for c in ("_point", "_t", "_end", "_k"))
    spans = sorted((i for i, p in enumerate(point) if not p), key=lambda i: (times[i], keys[i] is not None, keys[i] if keys[i] is not None else 0))
    at, found, stack, n = [], [], [], 0
    for i in sorted((i for i, p in enumerate(point) if p), key=times.__getitem__):
        while n < len(spans) and times[spans[n]] <= times[i]:
            stack.append(spans[n])
            n += 1
        while stack and ends[stack[-1]] is not None and ends[stack[-1]] < times[i]:
            stack.pop()
        if stack:
            at.append(i)
            found.append(stack[-1])
    at, found = pa.array(at, pa.int64()), pa.array(found, pa.int64())
    return pa.table({"_at": rows.column("_at").take(at), "_s": rows.column("_s").take(found), "_k": rows.column("_k").take(found)})


def holding(points: DataFrame, spans: DataFrame, at: str, start: str, end: str, key: str, bins: int = BINS, crowd: int = 2_000) -> DataFrame:
    """``points`` with ``start`` and ``key`` of the span that holds ``at``, ends included; of several the one that starts last, of those the largest key.

    A null end is open; a null start holds nothing, and a null point, or one that no
    span holds, gets nulls. Times are dealt into as many as ``bins`` bins, by quantiles, of
    about ``crowd`` times or more. A span goes to the bins of its start and of its end; of
    all that cover a whole bin the last one alone can be an answer there. So no pair of a time and
    a span is made, and what is shuffled grows with the rows.
    """
    times = points.select(F.col(at).alias("_at")).where("_at is not null").distinct()
    times = kept(times.withColumns({"_x": _number(times, "_at"), "_t": _exact(times, "_at")}))
    reach = times.agg(F.min("_x").alias("low"), F.max("_x").alias("high"), F.count("*").alias("n")).first()
    if reach["low"] is None:
        return points.join(spans.select(F.col(start).alias(start), F.col(key).alias(key)).limit(0), F.lit(False), "left")
    own = spans.select(F.col(start).alias("_s"), F.col(end).alias("_e"), F.col(key).alias("_k")).where("_s is not null and (_e is null or _s <= _e)")
    # Spans that are equal but for the key count once.
    own = own.groupBy("_s", "_e").agg(F.max("_k").alias("_k"))
    own = own.withColumns({"_from": _number(own, "_s"), "_to": F.coalesce(_number(own, "_e"), F.lit(float("inf"))), "_t": _exact(own, "_s"), "_end": _exact(own, "_e")})
    own = kept(own.where((F.col("_from") <= reach["high"]) & (F.col("_to") >= reach["low"])))

    every = times.select("_x").union(own.select("_from")).union(own.where("_e is not null").select("_to"))
    many = max(1, min(bins, every.count() // crowd))
    bounds = sorted({b for b in every.approxQuantile("_x", [i / many for i in range(1, many)], 1 / (4 * many)) if abs(b) < float("inf")}) if many > 1 else []
    splits = [-float("inf"), *(bounds or [0.0]), float("inf")]
    bin_of = lambda df, c, name: Bucketizer(splits=splits, inputCol=c, outputCol="_b", handleInvalid="keep").transform(df).withColumn(name, F.col("_b").cast("int")).drop("_b")
    laid = bin_of(bin_of(own, "_from", "_first"), "_to", "_final")

    # A range of bins is two blocks of the greatest power of two in it, so that few rows are laid out over bins.
    whole = laid.where("_final - _first >= 2").groupBy("_first", "_final").agg(F.max(F.struct("_t", "_s", "_k")).alias("_best"))
    size = F.expr("shiftleft(1, length(bin(_final - _first - 1)) - 1)")
    blocks = whole.withColumn("_size", size).select(F.explode(F.array(F.col("_first") + 1, F.col("_final") - F.col("_size"))).alias("_low"), "_size", "_best").groupBy("_low", "_size").agg(F.max("_best").alias("_best"))
    covers = blocks.withColumn("_bin", F.explode(F.expr("sequence(_low, _low + _size - 1)"))).groupBy("_bin").agg(F.max("_best").alias("_best")).select("_bin", "_best.*")

    empty = lambda c: F.lit(None).cast(c)
    at_type, span = times.schema["_at"].dataType, {f.name: f.dataType for f in own.schema}
    row = lambda df, name, end: df.select(F.col(name).alias("_bin"), F.lit(False).alias("_point"), "_t", end.alias("_end"), empty(at_type).alias("_at"), "_s", "_k")
    asked = bin_of(times, "_x", "_bin").select("_bin", F.lit(True).alias("_point"), F.col("_t").cast(span["_t"]).alias("_t"), empty(span["_end"]).alias("_end"), "_at", empty(span["_s"]).alias("_s"), empty(span["_k"]).alias("_k"))
    rows = asked.unionByName(row(laid, "_first", F.col("_end"))).unionByName(row(laid.where("_final > _first"), "_final", F.col("_end"))).unionByName(row(covers, "_bin", empty(span["_end"])))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    best = rows.groupBy("_bin").applyInArrow(_swept, f"_at {kinds['_at']}, _s {kinds['_s']}, _k {kinds['_k']}").select("_at", F.col("_s").alias(start), F.col("_k").alias(key))
    return points.join(F.broadcast(best) if reach["n"] <= FEW else best, F.col(at) == F.col("_at"), "left").drop("_at")


def neighbours_in_time(points: DataFrame, spans: DataFrame, at: str, start: str) -> DataFrame:
    """``points`` with ``previous`` and ``next``: the last start before ``at`` and the first one after it, both exclusive; null where there is none."""
    keys, firsts = points.select(F.col(at).alias("_at")).where("_at is not null").distinct(), spans.select(F.col(start).alias("_at")).where("_at is not null").distinct()
    both = keys.select("_at", F.lit(1).alias("_point"), F.lit(None).cast(firsts.schema[0].dataType).alias("_s")).unionByName(firsts.select("_at", F.lit(0).alias("_point"), F.col("_at").alias("_s")))
    # A start at the point's own time sorts behind it, so that it isn't before the point.
    before = last_before(both.withColumn("_o", -F.col("_point")), [F.col("_at"), F.col("_o")], "_s", "previous").where("_point = 1").select("_at", "previous")
    down = both.withColumns({"_x": -_number(both, "_at"), "_o": -F.col("_point")})
    after = last_before(down, [F.col("_x"), F.col("_o")], "_s", "next").where("_point = 1").select(F.col("_at").alias("_a"), "next")
    found = before.join(after, F.col("_at") == F.col("_a"), "left").drop("_a")
    return points.join(found, F.col(at) == F.col("_at"), "left").drop("_at")
