"""Statistics, grouped lists and nested documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .ranges import placed


def session_statistics(rows: DataFrame, ratings: int = 5) -> DataFrame:
    """One row over sessions (respondent, status, began, ended, last, rating, messages, helpful, cost_cents).

    A session without an end lasts up to its last message; one with neither isn't
    timed. Sessions without messages count in the means. Exact medians.
    """
    seconds = F.timestamp_diff("SECOND", F.col("began").cast("timestamp"), F.coalesce("ended", "last").cast("timestamp"))
    timed = rows.withColumn("_s", seconds)
    median = lambda c: F.round(F.percentile(c, F.lit(0.5))).cast("long")
    of = lambda s: F.count_if(F.col("status") == s)
    each = [F.count_if(F.col("rating") == i).alias(f"rating_{i}") for i in range(1, ratings + 1)]
    rate = F.round(F.try_divide(100.0 * of("completed"), F.count("*")), 1)
    return timed.agg(
        F.count("*").alias("total_sessions"), F.countDistinct("respondent").alias("respondents"), of("completed").alias("completed"), of("in_progress").alias("in_progress"), of("archived").alias("archived"), rate.alias("completion_rate"),
        F.sum("messages").alias("total_messages"), F.round(F.avg("messages"), 2).alias("avg_messages"), median("messages").alias("median_messages"), F.max("messages").alias("most_messages"),
        F.sum("_s").alias("total_seconds"), F.count("_s").alias("timed_sessions"), median("_s").alias("median_seconds"),
        F.count("rating").alias("rated"), F.round(F.avg("rating"), 1).alias("avg_rating"), *each, F.sum("helpful").alias("helpful"), F.sum("cost_cents").alias("cost_cents"),
    )


def taxonomy_counts(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """(place, category, n) in a taxonomy's order, without the empty ones."""
    counts = df.where(F.col(column).isin(order)).groupBy(F.col(column).alias("category")).agg(F.count("*").alias("n"))
    return counts.select((F.array_position(F.array(*map(F.lit, order)), F.col("category")) - 1).cast("int").alias("place"), "category", "n")


def first_seen_groups(df: DataFrame, group: str, item: str) -> DataFrame:
    """(group, place, items): groups by their smallest item, items in order."""
    grouped = df.groupBy(group).agg(F.sort_array(F.collect_list(item)).alias("items"))
    return placed(grouped, [F.get("items", F.lit(0)), F.col(group)], "place").select(group, "place", "items")


def category_groups(df: DataFrame, category: str, item: str, order: list[str]) -> DataFrame:
    """(category, place, ids) in a fixed order, ids once each; other categories and empty ones go."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(category)).cast("int") - 1
    return df.where(F.col(category).isin(order)).groupBy(category).agg(F.sort_array(F.collect_set(item)).alias("ids")).select(F.col(category).alias("category"), place.alias("place"), "ids")


def hits_by_session(hits: DataFrame, session: str, order: str) -> DataFrame:
    """(session, place, turns): sessions by their newest hit, hits in order. Places come from sampled ranges of the sessions."""
    grouped = hits.groupBy(session).agg(F.max(order).alias("_last"), F.sort_array(F.collect_list(order)).alias("turns"))
    return placed(grouped, [F.desc("_last"), F.col(session)], "place").select(session, "place", "turns")


def distribution(df: DataFrame, value: str, values: list[int]) -> DataFrame:
    """(mean, n_1, ..., n): the mean to one decimal and each value's count, without nulls."""
    return df.agg(F.round(F.avg(value), 1).alias("mean"), *[F.count_if(F.col(value) == v).alias(f"n_{v}") for v in values], F.count(value).alias("n"))


def nested(df: DataFrame, key: str, order: list[str], fields: list[str], name: str) -> DataFrame:
    """(key, name): each key's rows as a JSON array of ``fields``, in ``order``."""
    item = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.struct(*fields).alias("x"))
    return df.groupBy(key).agg(F.to_json(F.transform(F.sort_array(F.collect_list(item)), lambda r: r["x"])).alias(name))


def assembled(df: DataFrame, key: str, *lists: DataFrame) -> DataFrame:
    """``df`` with each key's lists, each (key, JSON array); empty arrays where there is none."""
    for held in lists:
        k, name = held.columns
        df = df.join(held.withColumnRenamed(k, "_k"), F.col(key) == F.col("_k"), "left").drop("_k").withColumn(name, F.coalesce(name, F.lit("[]")))
    return df


def newest_items(df: DataFrame, group: str, item: str, most: int) -> DataFrame:
    """(group, items): each group's largest items."""
    ranked = df.select(group, item, F.row_number().over(W.partitionBy(group).orderBy(F.desc(item))).alias("_n")).where(F.col("_n") <= most)
    return ranked.groupBy(group).agg(F.sort_array(F.collect_list(item), asc=False).alias("items"))


def reads(orders: DataFrame, parts: DataFrame, status: str, key: int, term: str) -> dict[str, DataFrame]:
    """A tool surface's reads by name."""
    done = orders.where(F.col("o_orderstatus") == status)
    return {"list_orders": done, "list_respondents": done.select("o_custkey").distinct(), "get_order": orders.where(F.col("o_orderkey") == key), "search_parts": parts.where(F.lower("p_name").contains(term.lower()))}


def read_sizes(surface: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.agg(F.lit(k).alias("tool"), F.count("*").alias("n")) for k, df in surface.items()])
