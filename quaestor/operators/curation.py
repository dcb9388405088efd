"""Which reviewed candidates of a topic are published: the most direct ones, up to a number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def directness(terms: Column, fields: list[tuple[Column, int]]) -> Column:
    """Each term's weights over the fields that contain it, summed; 0 without terms."""
    weight = lambda t: sum((F.when(f.contains(t), w).otherwise(0) for f, w in fields), F.lit(0))
    return F.aggregate(F.coalesce(terms, F.array().cast("array<string>")), F.lit(0), lambda s, t: s + weight(t))


def curated(rows: DataFrame, topics: DataFrame, key: str, name: str, amount: str, fields: list[tuple[str, int]], sound: Column, generic: str, most: int = 12) -> DataFrame:
    """``rows`` (topic, decision, by_policy, ...) with ``decision`` and ``reason`` by the policy.

    ``topics`` has (topic, terms, excluded, archived): the terms that make a row direct, and a
    pattern of names that the topic leaves out. A row can be chosen if a person hasn't decided
    against it (the policy's own decisions, ``by_policy``, are taken anew), ``sound`` holds, its
    amount is above 0, its name is neither generic nor excluded, and it is direct, where its topic
    has terms. The ``most`` direct of a topic are approved, or stay revised; ties go to
    the larger amount, then the smaller key. A person's rejection stays as it is. Nulls fail
    a rule; a row of an unknown topic is rejected.
    """
    known = rows.join(topics.select("topic", "terms", "excluded", "archived", F.lit(True).alias("_known")), "topic", "left")
    no = lambda c: F.coalesce(c, F.lit(False))
    score = directness(F.col("terms"), [(F.coalesce(f, F.lit("")), w) for f, w in fields])
    peripheral = no(F.col(name).rlike(generic)) | no(F.regexp_like(F.col(name), F.col("excluded")))
    open_ = F.coalesce("decision", F.lit("")).isin("", "approve", "revise") | no(F.col("by_policy"))
    scored = known.withColumns({"_score": score, "_peripheral": peripheral})
    fits = no(F.col("_known")) & ~no(F.col("archived")) & open_ & no(sound) & no(F.col(amount) > 0) & ~F.col("_peripheral") & ((F.coalesce(F.size("terms"), F.lit(0)) <= 0) | (F.col("_score") > 0))
    # Only rows that can be chosen are ranked; each task keeps a topic's best before the shuffle.
    order = [F.desc("_score"), F.desc(amount), F.col(key)]
    best = scored.where(fits).withColumn("_n", F.row_number().over(W.partitionBy("topic").orderBy(*order))).where(F.col("_n") <= most).select("topic", key, F.lit(True).alias("_chosen")).distinct()
    marked = scored.join(best, ["topic", key], "left")
    kept = (F.col("decision") == "reject") & ~no(F.col("by_policy"))
    reason = F.when(no(F.col("archived")), "archived").when(F.col("_chosen"), "direct").when(no(kept), "by_hand").when(F.col("_peripheral"), "peripheral").otherwise("less_direct")
    decision = F.when((F.col("reason") == "direct") & (F.col("decision") == "revise"), "revise").when(F.col("reason") == "direct", "approve").otherwise("reject")
    return marked.withColumn("reason", reason).withColumn("decision", decision).select(*rows.columns, "reason")
