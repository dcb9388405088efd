"""Versioned and incremental state: every change is a new snapshot that one writer makes."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .relational import merged


def activated(registry: DataFrame, chosen: str, valid: Column) -> DataFrame:
    """The registry with ``chosen`` active and the one before it archived; unchanged unless ``valid`` holds for it."""
    goes = registry.where((F.col("id") == chosen) & valid).limit(1).count() > 0
    if not goes:
        return registry
    status = F.when(F.col("id") == chosen, "active").when(F.col("status") == "active", "archived").otherwise(F.col("status"))
    return registry.withColumn("status", status)


def published_relations(current: DataFrame, reviewed: DataFrame, keys: list[str]) -> DataFrame:
    """Relations after a review: the excluded ones are gone, the approved ones are written anew, others stay."""
    gone = reviewed.where("decision = 'exclude'").select(*keys)
    kept = current.join(gone, keys, "left_anti")
    return merged(kept, reviewed.where("decision in ('approve', 'revise')").select(*current.columns), keys)


def ensured(existing: DataFrame, wanted: DataFrame, keys: list[str], compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Get or create: what exists, and what ``compute`` makes of the keys that don't."""
    return existing.unionByName(compute(wanted.join(existing, keys, "left_anti")))


def high_water(state: DataFrame, seen: DataFrame, key: str, mark: str) -> DataFrame:
    """Each account's largest id as a number; a new name starts over."""
    s, n = state.alias("s"), seen.alias("n")
    joined = s.join(n, F.col(f"s.{key}") == F.col(f"n.{key}"), "full")
    same = F.col("s.name").eqNullSafe(F.col("n.name")) | F.col("n.name").isNull()
    best = F.when(same, F.greatest(F.col(f"s.{mark}"), F.col(f"n.{mark}"))).otherwise(F.col(f"n.{mark}"))
    return joined.select(F.coalesce(f"s.{key}", f"n.{key}").alias(key), F.coalesce("n.name", "s.name").alias("name"), best.alias(mark))


def bumped(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Preferences after an upsert: the version rises where one of ``columns`` changed."""
    o, n = old.alias("o"), new.alias("n")
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
    joined = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    there = F.col(f"n.{key}").isNotNull()
    version = F.when(~there | same & F.col(f"o.{key}").isNotNull(), F.col("o.version")).otherwise(F.coalesce(F.col("o.version"), F.lit(0)) + 1)
    return joined.select(F.coalesce(f"o.{key}", f"n.{key}").alias(key), *[F.when(there, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in columns], version.alias("version"))


def numbered_pairs(topics: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Topics by their number of opinions, from 0, and the pairs under the new numbers; topics without opinions go."""
    sizes = pairs.groupBy("topic").agg(F.count("*").alias("n"))
    ordered = topics.join(sizes, "topic").withColumn("sort_order", F.row_number().over(W.orderBy(F.col("n").desc(), "topic")) - 1)
    return ordered, pairs.join(ordered.select("topic", "sort_order"), "topic")


def title_audit(rows: DataFrame, longest: int, shortest: int) -> DataFrame:
    """``issues`` of each row's title and summary: missing, too long or short, or a title twice."""
    title, summary = (F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\s+", " ")) for c in ("title", "summary"))
    twice = F.count("*").over(W.partitionBy("_title")) > 1
    named = rows.withColumns({"_title": title, "_summary": summary})
    checks = [(F.col("_title") == "", "missing_title"), (F.col("_summary") == "", "missing_summary"), (F.length("_title") > longest, "title_too_long"), ((F.length("_summary") < shortest) & (F.col("_summary") != ""), "summary_too_short"), (twice & (F.col("_title") != ""), "duplicate_title")]
    return named.withColumn("issues", F.array_compact(F.array(*[F.when(c, F.lit(k)) for c, k in checks]))).drop("_title", "_summary")


def batched(items: DataFrame, order: str, size: int, call: Callable[[list[dict]], list[dict]], schema: str) -> DataFrame:
    """``call`` on batches of ``size`` rows, in order within each; calls that raise are tried three times."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(order).to_dict("records")
        for attempt in range(3):
            try:
                return pd.DataFrame(call(rows))
            except Exception:
                if attempt == 2:
                    raise
        raise AssertionError

    spread = items.withColumn("_batch", F.floor(F.col(order) / size))
    return spread.groupBy("_batch").applyInPandas(lambda pdf: run(pdf.drop(columns="_batch")), schema)
