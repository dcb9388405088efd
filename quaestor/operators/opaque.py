"""Map-reduce over opaque calls, such as a language model's: batches, a merge, a judgement and assignments, by subject.

Calls run in tasks, some at a time in each; a call that fails for a passing reason is
tried anew, and one that fails for good becomes a row. Results are kept once they are
there, as a call needn't answer the same way twice.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaestor.functions.parsing import assignments

from .ranges import kept, placed

# What a passing failure says.
PASSING = ("rate limit", "timeout", "overloaded", "temporarily unavailable")

DRAFT = "struct<title:string,description:string>"


def passing(error: Exception) -> bool:
    """Whether a call may go better later: by status where there is one, else by what it says."""
    status = getattr(error, "status_code", None)
    if isinstance(status, int):
        return status == 429 or status >= 500
    return any(p in str(error).lower() for p in PASSING)


def retried(call: Callable, *args, attempts: int = 3, delay: float = 0.5, sleep: Callable[[float], None] = time.sleep):
    """``call`` on ``args``; passing failures wait ``delay`` seconds, then twice as long each time."""
    for n in range(attempts):
        try:
            return call(*args)
        except Exception as e:
            if n + 1 == attempts or not passing(e):
                raise
            sleep(delay * 2**n)


def in_batches(items: DataFrame, group: str, order: str, size: int) -> DataFrame:
    """(group, batch, rows): the items of each group in order, ``size`` a batch, numbered from 0.

    Items are numbered in sampled ranges of (group, order), so that a group of any size
    is dealt over all tasks. Rows without a group or an order are left out.
    """
    at = placed(items.dropna(subset=[group, order]), [F.col(group), F.col(order)], "_at")
    first = at.groupBy(group).agg(F.min("_at").alias("_first"))
    numbered = at.join(first, group).withColumn("batch", F.floor((F.col("_at") - F.col("_first")) / size).cast("long"))
    return numbered.groupBy(group, "batch").agg(F.sort_array(F.collect_list(F.struct("_at", F.struct(*items.columns).alias("row"))))["row"].alias("rows"))


def called(batches: DataFrame, inputs: list[str], call: Callable, result: str, workers: int = 10, attempts: int = 3, delay: float = 0.5) -> DataFrame:
    """The columns of ``batches`` that aren't ``inputs``, with ``result`` and ``error``: one of the two is null.

    ``call`` takes the inputs' values, arrays of structs as lists of dicts.
    """
    names = [c for c in batches.columns if c not in inputs]

    def plain(value):
        if hasattr(value, "tolist"):
            value = value.tolist()
        if isinstance(value, list):
            return [plain(v) for v in value]
        return value.asDict(True) if hasattr(value, "asDict") else value

    def one(args: list) -> tuple:
        try:
            return retried(call, *args, attempts=attempts, delay=delay), None
        except Exception as e:
            return None, f"{type(e).__name__}: {e}"[:500]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(max(1, workers)) as pool:
            for pdf in parts:
                rows = zip(*(pdf[c] for c in inputs), strict=True)
                given = ([plain(v) for v in row] for row in rows)
                at = 0
                # A few rounds of the pool at a time: what waits is bounded.
                while some := list(islice(given, 4 * max(1, workers))):
                    made = list(pool.map(one, some))
                    out = pdf[names].iloc[at : at + len(some)].copy()
                    out["result"], out["error"] = pd.Series([m[0] for m in made], dtype=object, index=out.index), [m[1] for m in made]
                    at += len(some)
                    yield out

    kinds = {f.name: f.dataType.simpleString() for f in batches.schema}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in names), f"result {result}", "error string"])
    return kept(batches.mapInPandas(run, schema))


@dataclass
class Calls:
    """The opaque calls.

    ``extract(rows)`` and ``merge(drafts)`` give drafts (title, description), ``judge(drafts,
    existing)`` the numbers from 1 of those to take, ``assign(rows, topics)`` lines of a
    row's number from 1 and a topic's id.
    """

    extract: Callable[[list[dict]], list[dict]]
    merge: Callable[[list[dict]], list[dict]]
    judge: Callable[[list[dict], list[dict]], list[int]]
    assign: Callable[[list[dict], list[dict]], str]


def _merged(drafts: DataFrame, calls: Calls, fan: int, options: dict) -> tuple[DataFrame, list[DataFrame]]:
    """(subject, drafts), each subject's merged in one call, and the failures; more than ``fan`` are merged in parts first."""
    failures = []
    while True:
        batches = kept(in_batches(drafts, "subject", "n", fan).select("subject", "batch", F.transform("rows", lambda r: r["draft"]).alias("drafts")))
        many = batches.where("batch > 0").limit(1).count() > 0
        before = batches.agg(F.sum(F.size("drafts"))).first()[0] if many else 0
        made = called(batches, ["drafts"], calls.merge, f"array<{DRAFT}>", **options)
        failures.append(made.where("error is not null").select("subject", F.lit("merge").alias("phase"), "batch", "error"))
        # A subject with a failed part goes, as its topics aren't whole.
        whole = made.join(failures[-1].select("subject").distinct(), "subject", "left_anti")
        if not many:
            return whole.select("subject", F.col("result").alias("drafts")), failures
        drafts = whole.select("subject", "batch", F.posexplode("result").alias("i", "draft")).select("subject", F.struct("batch", "i").alias("n"), "draft")
        if drafts.count() >= before:
            raise ValueError(f"merging {fan} drafts at a time doesn't make them fewer")


def topic_analysis(opinions: DataFrame, existing: DataFrame, calls: Calls, extract_size: int = 40, assign_size: int = 20, fan: int = 400, workers: int = 10, attempts: int = 3, delay: float = 0.5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Topics (subject, topic, title, description, is_new), assignments (subject, opinion, topic) and failures (subject, phase, batch, error).

    ``opinions`` has (subject, opinion, title, content), ``existing`` (subject, topic, title,
    description). Drafts come from batches of opinions, are merged for each subject and
    judged against what exists, unless nothing does; numbers that are out of range or
    repeated count for nothing. New topics are named new-1, new-2, ... A subject whose
    extraction, merge or judgement fails is left out and in the failures; a batch of
    assignments that fails gives its opinions no topic. Every other subject's opinion is
    assigned once. Repeated rows are opinions of their own.
    """
    options = {"workers": workers, "attempts": attempts, "delay": delay}
    failed = lambda df, phase: df.where("error is not null").select("subject", F.lit(phase).alias("phase"), "batch", "error")
    without = lambda df, gone: df.join(gone.select("subject").distinct(), "subject", "left_anti")

    found = called(in_batches(opinions.select("subject", "opinion", "title", "content"), "subject", "opinion", extract_size), ["rows"], calls.extract, f"array<{DRAFT}>", **options)
    lost = failed(found, "extract")
    drafts = without(found, lost).select("subject", "batch", F.posexplode("result").alias("i", "draft")).select("subject", F.struct("batch", "i").alias("n"), "draft")
    merged, lost_merges = _merged(drafts, calls, fan, options)

    of = lambda df, *more: df.groupBy("subject").agg(F.sort_array(F.collect_list(F.struct("topic", "title", "description", *more))).alias("topics"))
    known = of(existing.where("topic is not null"))
    asked = merged.join(known, "subject", "left").select("subject", F.lit(0).cast("long").alias("batch"), "drafts", F.coalesce("topics", F.expr("cast(array() as array<struct<topic:string,title:string,description:string>>)")).alias("topics"))
    both = asked.withColumn("all", F.col("drafts"))
    needless = (F.size("topics") == 0) | (F.size("drafts") == 0)
    judged = called(both.where(~needless), ["drafts", "topics"], calls.judge, "array<int>", **options).select("subject", "batch", F.col("all").alias("drafts"), "result", "error")
    lost_judges = failed(judged, "judge")
    valid = lambda r, d: F.array_distinct(F.filter(r, lambda i: i.between(1, F.size(d))))
    taken = judged.where("error is null").select("subject", F.transform(valid(F.col("result"), F.col("drafts")), lambda i: F.get("drafts", i - 1)).alias("drafts"))
    fresh = taken.unionByName(both.where(needless).select("subject", "drafts")).select("subject", F.posexplode("drafts").alias("i", "d"))
    new = fresh.select("subject", F.concat(F.lit("new-"), F.col("i") + 1).alias("topic"), "d.title", "d.description", F.lit(True).alias("is_new"))

    gone = lost
    for more in (*lost_merges, lost_judges):
        gone = gone.unionByName(more)
    there = opinions.select("subject").distinct()
    old = existing.where("topic is not null").join(there, "subject", "left_semi").select("subject", "topic", "title", "description", F.lit(False).alias("is_new"))
    topics = without(old.unionByName(new), gone)

    batches = in_batches(without(opinions.select("subject", "opinion", "title", "content"), gone), "subject", "opinion", assign_size).join(of(topics), "subject", "left")
    batches = kept(batches.withColumn("opinions", F.transform("rows", lambda r: r["opinion"])))
    replies = called(batches.where("topics is not null"), ["rows", "topics"], calls.assign, "string", **options)
    key = F.struct("subject", "batch").alias("key")
    said = assignments(replies.where("error is null").select(key, "result"), "key", "result", assign_size, None).where("topic is not null")
    named = said.select("key.subject", "key.batch", "item", "topic").join(topics.select("subject", "topic"), ["subject", "topic"], "left_semi")
    each = batches.select("subject", "batch", F.posexplode("opinions").alias("i", "opinion")).select("subject", "batch", (F.col("i") + 1).cast("long").alias("item"), "opinion")
    assigned = each.join(named, ["subject", "batch", "item"], "left").select("subject", "opinion", "topic")
    return topics, assigned, gone.unionByName(failed(replies, "assign"))
