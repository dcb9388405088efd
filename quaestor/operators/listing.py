"""Filters, orders and pages of lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def like(text: Column, term: str) -> Column:
    """Whether a text has the term somewhere, case aside; wildcards in the term are taken for themselves."""
    quoted = "".join("\\" + c if c in "%_\\" else c for c in term)
    return F.lower(text).like(f"%{quoted.lower()}%")


def optional(df: DataFrame, **wanted) -> DataFrame:
    """Rows that equal the values given; None filters nothing."""
    for column, value in wanted.items():
        if value is not None:
            df = df.where(F.col(column) == value)
    return df


def status(archived: Column, ended: Column) -> Column:
    return F.when(archived.isNotNull(), "archived").when(ended.isNotNull(), "completed").otherwise("in_progress")


def rank(value: Column, *order: str) -> Column:
    """A value's place in an order, from 0; null for others."""
    return F.nullif(F.array_position(F.array(*map(F.lit, order)), value), F.lit(0)).cast("int") - 1


def mapped(value: Column, **names: str) -> Column:
    """A value under its name in a mapping; null for others."""
    found = F.lit(None).cast("string")
    for k, v in names.items():
        found = F.when(value == k, v).otherwise(found)
    return found


def eligible(posts: DataFrame) -> DataFrame:
    """Posts with a numeric id above 0 and a date that can be read, that are no answer and no repost; ``form`` is quote or original."""
    sound = F.col("id").rlike(r"\A[0-9]+\z") & (F.col("id").try_cast("decimal(38,0)") > 0) & F.try_to_timestamp("at").isNotNull()
    return posts.where(sound & F.col("reply_to").isNull() & F.col("repost_of").isNull()).withColumn("form", F.when(F.col("quote_of").isNotNull(), "quote").otherwise("original"))


def by(column: str, ascending: bool) -> Column:
    """A sort key in either direction, nulls last in both."""
    return F.col(column).asc_nulls_last() if ascending else F.col(column).desc_nulls_last()


def switched(df: DataFrame, column: str, ascending: bool, newest: list[str]) -> DataFrame:
    """Rows by a column in either direction, nulls last; ties the newest first."""
    return df.orderBy(by(column, ascending), *[F.desc(c) for c in newest])


def paged(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """A page with ``has_more``: one row more than the page is read, and it goes."""
    read = df.orderBy(*order).offset((number - 1) * size).limit(size + 1)
    # The few rows of one page are in one task already.
    place = read.withColumn("_n", F.row_number().over(W.orderBy(*order)))
    return place.withColumn("has_more", F.count("*").over(W.partitionBy()) > size).where(F.col("_n") <= size).drop("_n")


def with_total(rows: DataFrame, page: DataFrame) -> DataFrame:
    """A page with ``total_count`` of all its rows, counted by partial sums."""
    return page.join(F.broadcast(rows.agg(F.count("*").alias("total_count"))))


def clamped(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """A page whose number is held between the first and the last, with ``page``, start_number, end_number and total."""
    total = df.count()
    at = min(max(number, 1), max(-(-total // size), 1))
    rows = df.orderBy(*order).offset((at - 1) * size).limit(size)
    long = lambda x: F.lit(x).cast("long")
    return rows.withColumns({"page": long(at), "start_number": long((at - 1) * size + 1), "end_number": long(min(at * size, total)), "total": long(total)})


def in_year(df: DataFrame, date: str, year: int | None) -> DataFrame:
    """The rows of a year, with ``year``; of the last one where the year asked for has none."""
    dated = df.withColumn("year", F.year(date).cast("long"))
    chosen = dated.agg(F.coalesce(F.max(F.when(F.col("year") == year, F.col("year"))) if year is not None else F.lit(None).cast("long"), F.max("year")).alias("_y"))
    return dated.join(F.broadcast(chosen), F.col("year") == F.col("_y")).drop("_y")


def in_month(df: DataFrame, date: str, month: str) -> DataFrame:
    """The rows of a month (yyyy-MM), from its first day up to the next one's."""
    first = F.to_date(F.lit(f"{month}-01"))
    return df.where((F.col(date) >= first) & (F.col(date) < F.add_months(first, 1)))


def after(df: DataFrame, keys: list[str], values: list, size: int) -> DataFrame:
    """The first rows after a key of several columns."""
    later = F.lit(False)
    for i in range(len(keys) - 1, -1, -1):
        later = (F.col(keys[i]) > values[i]) | ((F.col(keys[i]) == values[i]) & later)
    return df.where((F.col(keys[0]) >= values[0]) & later).orderBy(*keys).limit(size)


def with_each(df: DataFrame, questions: list[str]) -> DataFrame:
    """Each row with every question and its number, from 1."""
    every = F.posexplode(F.array(*map(F.lit, questions))).alias("n", "question")
    return df.select("*", every).withColumn("n", F.col("n") + 1)
