"""Checks of imports, datasets and reviews; each gives rows that say what is wrong."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def size(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*"))


def compared(expected: dict[str, tuple[DataFrame, int]]) -> DataFrame:
    """(name, actual, expected, result) for aggregates of one row and what they should be."""
    rows = [df.toDF("actual").select(F.lit(k).alias("name"), F.col("actual").cast("long").alias("actual"), F.lit(n).cast("long").alias("expected")) for k, (df, n) in expected.items()]
    same = F.col("actual").eqNullSafe(F.col("expected"))
    return reduce(DataFrame.unionByName, rows).withColumn("result", F.when(same, "PASS").otherwise("FAIL"))


def verdict(checks: DataFrame) -> DataFrame:
    """One row: result, n_errors, n_checks and the ``errors`` themselves."""
    wrong = F.col("result") == "FAIL"
    found = checks.agg(F.count_if(wrong).alias("n_errors"), F.count("*").alias("n_checks"), F.sort_array(F.collect_list(F.when(wrong, F.col("name")))).alias("errors"))
    return found.select(F.when(F.col("n_errors") == 0, "PASS").otherwise("FAIL").alias("result"), "n_errors", "n_checks", "errors")


def violations(rule: str, wrong: DataFrame) -> DataFrame:
    return wrong.agg(F.lit(rule).alias("rule"), F.count("*").alias("violations"))


def row_rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations) of rules on single rows, all counted in one pass."""
    counts = df.agg(*[F.count_if(broken).alias(k) for k, broken in rules.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("violations")) for k in rules])).alias("r")).select("r.*")


def set_differences(left: DataFrame, right: DataFrame, only_left: str, only_right: str) -> DataFrame:
    """Rows that one side lacks, with ``difference`` telling which."""
    return left.exceptAll(right).withColumn("difference", F.lit(only_left)).unionByName(right.exceptAll(left).withColumn("difference", F.lit(only_right)))


def review_issues(rows: DataFrame, before: str, after: str) -> DataFrame:
    """Rows that break a rule: a note is required to revise or exclude, only a revision may change, and it has to."""
    same = F.col(before).eqNullSafe(F.col(after))
    noted = F.coalesce(F.trim("note") != "", F.lit(False))
    issue = F.when(F.col("decision").isin("revise", "exclude") & ~noted, "note_required").when((F.col("decision") != "revise") & ~same, "changed_without_revise").when((F.col("decision") == "revise") & same, "revise_without_change")
    return rows.withColumn("issue", issue).where("issue is not null")


def policy(rows: DataFrame, longest: int, most: int, cap: int) -> DataFrame:
    """(topic, issue): the first thing against publishing a topic's rows (topic, category, decision)."""
    parts = rows.groupBy("topic", "category").agg(F.count("*").alias("k"), F.count_if(F.col("decision") == "pending").alias("p"))
    whole = parts.groupBy("topic").agg(F.sum("k").alias("n"), F.sum("p").alias("pending"), F.max("k").alias("most"))
    issue = F.when(F.length("topic") > longest, "name_too_long").when(F.col("pending") > 0, "pending_rows").when(~F.col("n").between(1, most), "rows_out_of_range").when(F.col("most") > cap, "category_cap")
    return whole.select("topic", issue.alias("issue"))


def revision(files: DataFrame, order: str, digest: Column) -> DataFrame:
    """(n_files, revision): a hash over the files' hashes in order; they are a few dozen."""
    held = files.agg(F.count("*").alias("n_files"), F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), digest.alias("d")))).alias("l"))
    return held.select("n_files", F.sha2(F.array_join(F.transform("l", lambda x: x["d"]), ""), 256).alias("revision"))


