"""Structured texts taken apart, and values derived from sessions and names."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import StringType

from .text import clamp_score, fnv1a, nfkc

# Fixed values of the linear congruential generator.
MULTIPLIER, INCREMENT = 1664525, 1013904223


def markdown_sections(docs: DataFrame, key: str, text: str, default: str, skipped: Column | None = None) -> DataFrame:
    """(key, section, heading, content): the text under each heading, single-spaced; empty sections go.

    ``skipped`` tells the headings of level 1, in a column ``heading``, whose whole
    part is left out up to the next heading of level 1.
    """
    lines = docs.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("n", "line"))
    mark = F.regexp_extract("line", r"^(#{1,6})\s+", 1)
    lines = lines.withColumn("level", F.length(mark)).withColumn("heading", F.when(F.col("level") > 0, F.trim(F.regexp_replace("line", r"^#+\s+", ""))))
    by = W.partitionBy(key).orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    top = F.last(F.when(F.col("level") == 1, F.coalesce(skipped, F.lit(False)) if skipped is not None else F.lit(False)), True).over(by)
    lines = lines.withColumns({"section": F.count("heading").over(by), "gone": F.coalesce(top, F.lit(False)), "under": F.coalesce(F.last("heading", True).over(by), F.lit(default))})
    body = lines.where("level = 0 and not gone").groupBy(key, "section", "under").agg(F.sort_array(F.collect_list(F.struct("n", "line"))).alias("l"))
    content = F.trim(F.regexp_replace(F.array_join(F.transform("l", lambda x: x["line"]), " "), r"\s+", " "))
    return body.select(key, "section", F.col("under").alias("heading"), content.alias("content")).where("content != ''")


# A line of a reply (item, separators, topic), and what may decorate a topic.
ASSIGNED = r"^([0-9]+)[\s\x{3000}:→-]+(\S+)"
DECORATION = "[`\"'.,;]"


def assignments(replies: DataFrame, key: str, text: str, size: int, valid: tuple[str, ...] | None) -> DataFrame:
    """(key, item, topic) for items 1 to ``size``: the topic that an item's last line names, if it is valid (None: any); lines of another form say nothing."""
    lines = replies.select(key, F.posexplode(F.split(text, "\n")).alias("n", "line")).withColumn("line", F.regexp_replace("line", r"^[\s\x{3000}]+|[\s\x{3000}]+$", ""))
    said = lines.where(F.col("line").rlike(ASSIGNED)).select(key, "n", F.regexp_extract("line", ASSIGNED, 1).try_cast("long").alias("item"), F.regexp_replace(F.regexp_extract("line", ASSIGNED, 2), DECORATION, "").alias("token"))
    last = said.groupBy(key, "item").agg(F.max_by("token", "n").alias("token"))
    items = replies.select(key).distinct().select(key, F.explode(F.sequence(F.lit(1).cast("long"), F.lit(size).cast("long"))).alias("item"))
    return items.join(last, [key, "item"], "left").select(key, "item", (F.col("token") if valid is None else F.when(F.col("token").isin(*valid), F.col("token"))).alias("topic"))


def daily_pick(ids: Column, day: Column, size: int = 3) -> Column:
    """The first ``size`` of an array of ids in a day's order, by a shuffle from the last place down."""
    ordered = F.sort_array(ids)

    def swap(state: Column, i: Column) -> Column:
        seed = (state["seed"] * MULTIPLIER + INCREMENT).bitwiseAND(4294967295)
        j = (seed % (i + 1)).cast("int")
        a = state["ids"]
        moved = F.transform(a, lambda x, k: F.when(k == i, F.get(a, j)).when(k == j, F.get(a, i)).otherwise(x))
        return F.struct(seed.alias("seed"), moved.alias("ids"))

    steps = F.when(F.size(ids) > 1, F.sequence(F.size(ids) - 1, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return F.slice(F.aggregate(steps, F.struct(fnv1a(F.date_format(day, "yyyy-MM-dd")).alias("seed"), ordered.alias("ids")), swap)["ids"], 1, size)


def questioner(note: Column) -> Column:
    """The name of the member who asked, without blanks; null where none is named.

    It is what stands before the member's title in the sentence that has a question,
    after the place where it was asked.
    """
    sentences = F.filter(F.split(nfkc(note), "[。\n]"), lambda s: s.contains("議員") & s.contains("質問"))
    before = F.substring_index(F.get(sentences, F.lit(0)), "議員", 1)
    return F.nullif(F.regexp_replace(F.element_at(F.split(before, "[で、]"), -1), r"\s+", ""), F.lit(""))


def committee(note: Column, known: tuple[str, ...] = ()) -> Column:
    """The committee that a note names: a known one, one that is labelled as such, one in brackets, or the first other."""
    sure = [F.when(note.contains(k), F.lit(k)) for k in known]
    named = F.filter(F.split(F.regexp_replace(note, r"([:：])\s*", "$1"), r"[\s、。()（）]+"), lambda w: w.endswith("委員会"))
    labelled = F.filter(named, lambda w: w.rlike("[:：]"))
    bracketed = F.filter(F.transform(F.split(note, "[(（]"), lambda w: F.trim(F.substring_index(F.substring_index(w, ")", 1), "）", 1))), lambda w: w.endswith("委員会"))
    first = lambda a: F.get(a, F.lit(0))
    return F.coalesce(*sure, F.element_at(F.split(first(labelled), "[:：]"), -1), first(bracketed), first(named))


def role_title(title: Column, generic: tuple[str, ...]) -> Column:
    """A trimmed title; null for none and for generic ones."""
    trimmed = F.trim(title)
    return F.when((trimmed != "") & ~trimmed.isin(*generic), trimmed)


def remaining_minutes(estimate: Column, started: Column, now: Column) -> Column:
    """Minutes left, rounded up, 0 at least; null without an estimate."""
    left = F.ceil(estimate - (F.unix_micros(now) - F.unix_micros(started)) / 60e6)
    return F.when(estimate.isNotNull(), F.greatest(F.lit(0), left)).cast("long")


def progress(total: Column, stage: Column, asked: Column) -> Column:
    """Per cent of an interview: 100 complete, 90 in summary, else up to 80 by the questions done; the one being asked isn't."""
    done = F.greatest(F.lit(0), F.size(F.array_distinct(asked)) - 1)
    return F.when(total > 0, F.when(stage == "summary_complete", 100).when(stage == "summary", 90).otherwise(F.floor(F.try_divide(done, total) * 80 + 0.5))).cast("int")


def stale(status: Column, created: Column, started: Column, now: Column, pending: str = "5 minutes", running: str = "70 minutes") -> Column:
    """Whether a run has been pending or running for too long."""
    old = lambda at, limit: now > at + F.expr(f"interval {limit}")
    return F.coalesce(F.when(status == "pending", old(created, pending)).when(status == "running", old(F.coalesce(started, created), running)), F.lit(False))


def off_topic(text: Column, off: tuple[str, ...], civic: tuple[str, ...]) -> Column:
    """``blocked`` where a text has an off-topic term and no civic one, else ``allowed``."""
    has = lambda terms: F.exists(F.array(*map(F.lit, terms)), lambda t: F.lower(text).contains(t))
    return F.when(F.coalesce(has(off) & ~has(civic), F.lit(False)), "blocked").otherwise("allowed")


def japan_day(ts: Column) -> Column:
    """The date in Japan of a point in time."""
    return F.to_date(F.from_utc_timestamp(ts, "Asia/Tokyo"))


def text_metrics(text: Column) -> Column:
    """Digest, characters, UTF-16 units and UTF-8 bytes."""
    return F.struct(F.sha2(text, 256).alias("sha256"), F.length(text).alias("chars"), (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int").alias("utf16_units"), F.octet_length(text).alias("bytes"))


def token_cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """Cost by prices for a million tokens, six decimals; null without a price."""
    sane = lambda c: F.greatest(F.lit(0), F.coalesce(c, F.lit(0)))
    return F.round((sane(tokens_in) * price_in + sane(tokens_out) * price_out) / 1e6, 6)


def keyed_digest(secret: str):
    """HMAC-SHA256 under a secret, as a column function."""

    @F.pandas_udf(StringType())
    def digest(text: pd.Series) -> pd.Series:
        return text.map(lambda x: None if x is None else hmac.new(secret.encode(), x.encode(), hashlib.sha256).hexdigest())

    return digest


def segments(text: Column, term: str) -> Column:
    """A text as pieces that equal ``term``, case aside, and those between."""
    quoted = "".join(c if c.isalnum() else "\\" + c for c in term)
    parts = F.filter(F.regexp_extract_all(text, F.lit(f"(?is)({quoted}|.+?(?={quoted}|\\z))"), 1), lambda x: x != "")
    return F.transform(parts, lambda x: F.struct(x.alias("text"), (F.lower(x) == term.lower()).alias("match")))


def message(content: Column, stages: tuple[str, ...]) -> Column:
    """A message's JSON (text, stage, quick replies, report flag); content that is none is its own text."""
    parsed = F.from_json(content, "text string, next_stage string, quick_replies array<string>, report string")
    return F.struct(F.coalesce(parsed["text"], content).alias("text"), F.when(parsed["next_stage"].isin(*stages), parsed["next_stage"]).alias("stage"), F.coalesce(F.filter(parsed["quick_replies"], lambda x: x.isNotNull()), F.array().cast("array<string>")).alias("quick_replies"), parsed["report"].isNotNull().alias("has_report"))


def report(content: Column) -> Column:
    """The report in a message's JSON: summary and opinions, what they lack null; null unless it has a summary and a list of opinions."""
    parsed = F.from_json(F.get_json_object(content, "$.report"), "summary string, opinions array<struct<title string, content string, richness double>>")
    return F.when(parsed["summary"].isNotNull() & parsed["opinions"].isNotNull(), parsed)


def spoken_turns(messages: DataFrame, key: str, order: str, role: str, text: str, stages: tuple[str, ...] = ()) -> DataFrame:
    """A session's turns as they were said: those that only hand over a report go, assistants' JSON becomes its text."""
    said = message(F.col(text), stages)
    told = F.when(F.col(role) == "assistant", said["text"]).otherwise(F.col(text))
    reported = (F.col(role) == "assistant") & F.coalesce(said["has_report"], F.lit(False))
    return messages.where(~reported).select(key, order, role, told.alias(text))


def opinion_rows(reports: DataFrame, key: str, opinions: str) -> DataFrame:
    """(key, opinion_index, title, content, richness) of a list of opinions; missing parts are null, richness is clamped."""
    rows = reports.select(key, F.posexplode(opinions).alias("opinion_index", "o"))
    return rows.select(key, "opinion_index", "o.title", "o.content", clamp_score(F.col("o.richness")).alias("richness"))


def statements(docs: DataFrame, key: str, text: str, part: str) -> DataFrame:
    """(key, n, speaker, content): under the heading of level 1 named ``part``, one row for each heading of level 2."""
    lines = docs.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("n", "line"))
    by = W.partitionBy(key).orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    after = lambda mark: F.trim(F.substring(F.col("line"), len(mark) + 1, F.length("line")))
    one, two = F.col("line").startswith("# "), F.col("line").startswith("## ")
    marked = lines.withColumns({"h1": F.last(F.when(one, after("# ")), True).over(by), "h2": F.count_if(two).over(by), "speaker": F.when(two, after("## "))})
    inside = marked.where((F.col("h1") == part) & ~one & (F.col("h2") > 0))
    grouped = inside.groupBy(key, "h2").agg(F.first("speaker", True).alias("speaker"), F.sort_array(F.collect_list(F.when(F.col("speaker").isNull(), F.struct("n", "line")))).alias("l"), F.min("n").alias("at"))
    content = F.trim(F.regexp_replace(F.array_join(F.transform("l", lambda x: x["line"]), " "), r"\s+", " "))
    return grouped.select(key, F.row_number().over(W.partitionBy(key).orderBy("at")).alias("n"), "speaker", content.alias("content"))


def interview_cost(minutes: Column, prices: dict[str, float], model: Column) -> Column:
    """An interview's estimated cost by its model's price a minute; null for an unknown model."""
    price = F.lit(None).cast("double")
    for name, value in prices.items():
        price = F.when(model == name, value).otherwise(price)
    return F.round(F.greatest(minutes, F.lit(0)) * price, 6)
