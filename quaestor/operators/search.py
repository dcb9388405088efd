"""Ranked search, deterministic sampling and rule matching."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quaestor.functions.text import fnv1a, similarity


def keyword_scores(docs: DataFrame, key: str, fields: dict[str, int], terms: list[str]) -> DataFrame:
    """(key, keyword_score): for each term, the weight of the best field that contains it, summed."""
    best = [F.greatest(F.lit(0), *[F.when(F.lower(F.col(f)).contains(t), w).otherwise(0) for f, w in fields.items()]) for t in terms if len(t) >= 2]
    score = best[0]
    for more in best[1:]:
        score = score + more
    return docs.select(key, score.cast("long").alias("keyword_score")).where("keyword_score > 0")


def semantic_scores(chunks: DataFrame, key: str, vector: str, query: list[float], least: float) -> DataFrame:
    """(key, semantic_score): the best cosine of a document's chunks, from ``least`` on."""
    from quaestor.functions.text import cosine

    scored = chunks.withColumn("_s", F.round(cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in query])), 9))
    return scored.groupBy(key).agg(F.max("_s").alias("semantic_score")).where(F.col("semantic_score") >= least)


def fused(keyword: DataFrame, semantic: DataFrame, key: str, limit: int, depth: int = 200, keyword_weight: float = 1.4, semantic_weight: float = 1.0, k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of two scored lists, each cut at ``depth`` before it is ranked."""
    top = lambda df, c: df.orderBy(F.col(c).desc(), key).limit(depth)
    ranked = lambda df, c, name: top(df, c).select(key, F.row_number().over(W.orderBy(F.col(c).desc(), key)).alias(name))
    both = ranked(keyword, "keyword_score", "keyword_rank").join(ranked(semantic, "semantic_score", "semantic_rank"), key, "full")
    part = lambda c, w: F.coalesce(F.lit(w) / (k + F.col(c)), F.lit(0.0))
    score = F.round(part("keyword_rank", keyword_weight) + part("semantic_rank", semantic_weight), 9)
    return both.withColumn("score", score).orderBy(F.col("score").desc(), key).limit(limit)


def lexical_fuzzy(rows: DataFrame, key: str, name: str, query: str, exact: int = 120, prefix: int = 100, inside: int = 80, fuzzy: int = 60, cutoff: float = 0.22) -> DataFrame:
    """(key, score, kind): equal, prefix, substring or trigram matches of a name."""
    q, n = F.lit(query.lower()), F.lower(F.col(name))
    near = F.round(similarity(n, q), 9)
    kind = F.when(n == q, "exact").when(n.startswith(query.lower()), "prefix").when(n.contains(query.lower()), "inside").when(near >= cutoff, "fuzzy")
    score = F.when(F.col("kind") == "exact", float(exact)).when(F.col("kind") == "prefix", float(prefix)).when(F.col("kind") == "inside", float(inside)).otherwise(F.round(near * fuzzy, 6))
    return rows.withColumn("kind", kind).where("kind is not null").select(key, name, "kind", score.alias("score"))


def seeded(df: DataFrame, key: str, seed: str) -> DataFrame:
    """``df`` with ``draw``, the hash by which a seed orders its rows."""
    return df.withColumn("draw", fnv1a(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))))


def rotated(df: DataFrame, key: str, group: str, seed: str, size: int) -> DataFrame:
    """``size`` rows in seeded order, one of each group first, then others to fill up."""
    drawn = seeded(df, key, seed).withColumn("turn", F.row_number().over(W.partitionBy(group).orderBy("draw", key)))
    return drawn.orderBy(F.when(F.col("turn") == 1, 0).otherwise(1), "draw", key).limit(size)


def first_rule(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """``df`` with ``rule``, the first that holds; rows without one go."""
    chain = F.when(rules[0][1], rules[0][0])
    for name, holds in rules[1:]:
        chain = chain.when(holds, name)
    return df.withColumn("rule", chain).where("rule is not null")


def tag_cover(edges: DataFrame, group: str, tag: str, item: str) -> DataFrame:
    """(group, tag, item): in each group, a largest set of pairs in which no tag and no item repeats.

    Augmenting paths, tags and items in order. A group is one profile's wishes, some
    tens of rows.
    """

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        wanted = {t: sorted(set(g[item])) for t, g in pdf.groupby(tag)}
        owner: dict = {}

        def place(t, seen) -> bool:
            for i in wanted[t]:
                if i not in seen:
                    seen.add(i)
                    if i not in owner or place(owner[i], seen):
                        owner[i] = t
                        return True
            return False

        for t in sorted(wanted):
            place(t, set())
        found = sorted((t, i) for i, t in owner.items())
        return pd.DataFrame({group: pdf[group].iloc[0], tag: [t for t, _ in found], item: [i for _, i in found]})

    return edges.select(group, tag, item).groupBy(group).applyInPandas(match, edges.select(group, tag, item).schema)
