"""Nested documents: several lists of a key from one pass, and trees of several levels."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lists_of(df: DataFrame, key: str, lists: Mapping[str, tuple[Column, list[Column], Column]]) -> DataFrame:
    """(key, one array for each list): rows that a list's condition holds for, in its order, then the item's own, as its item.

    All lists of a table are gathered in one aggregate, so that it is read and shuffled once.
    """
    made = [F.sort_array(F.collect_list(F.when(holds, F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], item.alias("x")))))["x"].alias(name) for name, (holds, order, item) in lists.items()]
    return df.groupBy(key).agg(*made)


def with_lists(df: DataFrame, key: str, *held: DataFrame) -> DataFrame:
    """``df`` with the arrays that each of ``held`` has for its key; empty ones where it has none."""
    for lists in held:
        names = [f for f in lists.schema if f.name != key]
        df = df.join(lists, key, "left")
        df = df.withColumns({f.name: F.coalesce(f.name, F.array().cast(f.dataType)) for f in names})
    return df


def references(*lists: Column) -> Column:
    """The distinct references of several arrays, in order of their JSON."""
    every = F.array_distinct(F.concat(*lists))
    return F.transform(F.sort_array(F.transform(every, lambda r: F.struct(F.to_json(r).alias("j"), r.alias("r")))), lambda x: x["r"])


def tree(leaves: DataFrame, levels: list[tuple[str, str, str]], amount: str, leaf: str) -> DataFrame:
    """One row for each code of the outermost level: (code, name, amount, children), nested down to the leaves.

    ``levels`` are (code column, name column, name of the array below), from the outermost in; names
    are the smallest of a code, amounts the sums of the leaves', as 64-bit integers. ``leaf``
    is a struct column that the innermost array holds in order. A row grows with the leaves
    under one outermost code; ``nodes`` has one row for each node instead.
    """
    codes = [c for c, _, _ in levels]
    names = [n for _, n, _ in levels]
    code, name, below = levels[-1]
    rows = leaves.groupBy(*codes).agg(*[F.min(n).alias(n) for n in names], F.sum(amount).cast("long").alias(amount), F.sort_array(F.collect_list(leaf)).alias(below))
    for depth in range(len(levels) - 1, 0, -1):
        code, name, below = levels[depth]
        item = F.struct(F.col(code).alias("code"), F.col(name).alias("name"), F.col(amount).alias("amount"), F.col(below))
        above = levels[depth - 1][2]
        rows = rows.groupBy(*codes[:depth]).agg(*[F.min(n).alias(n) for n in names[:depth]], F.sum(amount).cast("long").alias(amount), F.sort_array(F.collect_list(item)).alias(above))
    code, name, below = levels[0]
    return rows.select(F.col(code).alias("code"), F.col(name).alias("name"), F.col(amount).alias("amount"), below)


def nodes(leaves: DataFrame, levels: list[tuple[str, str]], amount: str) -> DataFrame:
    """(depth, path, name, amount, leaves): one row for each node of a tree, each level rolled up from the one below it.

    ``levels`` are (code column, name column) from the outermost in; ``path`` has the codes down
    to the node. The leaves are shuffled once, later levels have one row a node.
    """
    codes, names = [c for c, _ in levels], [n for _, n in levels]
    # A row under a null code keeps that code in its path.
    rows = leaves.groupBy(*codes).agg(*[F.min(n).alias(n) for n in names], F.sum(amount).cast("long").alias("amount"), F.count("*").alias("leaves"))
    out = None
    for depth in range(len(levels), 0, -1):
        if depth < len(levels):
            rows = rows.groupBy(*codes[:depth]).agg(*[F.min(n).alias(n) for n in names[:depth]], F.sum("amount").cast("long").alias("amount"), F.sum("leaves").cast("long").alias("leaves"))
        level = rows.select(F.lit(depth).alias("depth"), F.array(*[F.col(c).cast("string") for c in codes[:depth]]).alias("path"), F.col(names[depth - 1]).alias("name"), "amount", "leaves")
        out = level if out is None else out.unionByName(level)
    return out
