"""A dataset's rules as data: values, references and unique keys, checked at once or in the pass that writes the tables."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Value:
    """An aggregate of a table and what it should be."""

    code: str
    table: str
    found: Column
    expected: int


@dataclass(frozen=True)
class Reference:
    """A column whose values have to be keys of another table; a null refers to nothing and breaks it, unless ``optional``."""

    code: str
    table: str
    column: str
    parent: str
    key: str
    optional: bool = False


@dataclass(frozen=True)
class Unique:
    """Columns that no two rows of a table agree in; nulls agree."""

    code: str
    table: str
    columns: tuple[str, ...]


Rule = Value | Reference | Unique


def never(code: str, table: str, broken: Column) -> Value:
    """No row may break a rule; a condition that is null isn't broken."""
    return Value(code, table, F.count_if(broken), 0)


def rows_of(code: str, table: str, expected: int) -> Value:
    return Value(code, table, F.count(F.lit(1)), expected)


def totals(code: str, table: str, group: str, amount: Column, expected: dict[str, int]) -> list[Value]:
    """One rule for each group's total, and one that there are no other groups."""
    each = [Value(f"{code}:{g}", table, F.coalesce(F.sum(F.when(F.col(group) == g, amount)), F.lit(0)), n) for g, n in expected.items()]
    other = ~F.coalesce(F.col(group).isin(*expected), F.lit(False))
    return [*each, never(f"{code}:other", table, other)]


def _broken(tables: dict[str, DataFrame], rule: Reference | Unique) -> DataFrame:
    """(code, actual, expected, first) of a rule on keys; only its columns are read, and keys are counted before they meet others."""
    df = tables[rule.table]
    if isinstance(rule, Reference):
        held = df.groupBy(F.col(rule.column).alias("_k")).agg(F.count("*").alias("_n"))
        if rule.optional:
            held = held.where("_k is not null")
        wrong = held.join(tables[rule.parent].select(F.col(rule.key).alias("_p")), F.col("_k") == F.col("_p"), "left_anti")
        count, first = F.coalesce(F.sum("_n"), F.lit(0)), F.min(F.col("_k").cast("string"))
    else:
        wrong = df.groupBy(*rule.columns).agg(F.count("*").alias("_n")).where("_n > 1")
        count, first = F.count("*"), F.min(F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in rule.columns]))
    return wrong.agg(F.lit(rule.code).alias("code"), count.cast("long").alias("actual"), F.lit(0).cast("long").alias("expected"), first.alias("first"))


def _measured(df: DataFrame, rules: list[Value]) -> DataFrame:
    """A table's value rules, all from one pass."""
    made = df.agg(*[r.found.cast("long").alias(f"v{i}") for i, r in enumerate(rules)])
    rows = [F.struct(F.lit(r.code).alias("code"), F.col(f"v{i}").alias("actual"), F.lit(r.expected).cast("long").alias("expected"), F.lit(None).cast("string").alias("first")) for i, r in enumerate(rules)]
    return made.select(F.inline(F.array(*rows)))


def _judged(parts: Iterable[DataFrame]) -> DataFrame:
    every = reduce(DataFrame.unionByName, parts)
    return every.withColumn("result", F.when(F.col("actual").eqNullSafe(F.col("expected")), "PASS").otherwise("FAIL"))


def _by_table(rules: list[Rule]) -> dict[str, list[Value]]:
    out: dict[str, list[Value]] = {}
    for r in rules:
        if isinstance(r, Value):
            out.setdefault(r.table, []).append(r)
    return out


def checked(tables: dict[str, DataFrame], rules: list[Rule]) -> DataFrame:
    """(code, actual, expected, first, result), a row for each rule; ``first`` is the smallest key, as text, that breaks one on keys."""
    values = [_measured(tables[name], own) for name, own in _by_table(rules).items()]
    return _judged([*values, *(_broken(tables, r) for r in rules if not isinstance(r, Value))])


def written(tables: dict[str, DataFrame], rules: list[Rule], folder: str) -> DataFrame:
    """Writes the tables as Parquet under ``folder`` and gives what ``checked`` gives.

    Value rules are observed while the tables are written, so that no table is computed
    for them again; rules on keys read their columns from what has been written. The
    folder of a table that is there is an error.
    """
    spark = next(iter(tables.values())).sparkSession
    by, observed = _by_table(rules), []
    for name, df in tables.items():
        own = by.get(name, [])
        seen = Observation(f"{name}-rules")
        watched = df.observe(seen, *[r.found.cast("long").alias(f"v{i}") for i, r in enumerate(own)]) if own else df
        watched.write.parquet(f"{folder}/{name}")
        if own:
            got = seen.get
            observed += [(r.code, got[f"v{i}"], r.expected, None) for i, r in enumerate(own)]
    kept = {name: spark.read.parquet(f"{folder}/{name}") for name in tables}
    parts = [spark.createDataFrame(observed, "code string, actual long, expected long, first string")]
    return _judged([*parts, *(_broken(kept, r) for r in rules if not isinstance(r, Value))])
