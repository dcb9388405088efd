"""Quality rules: per-document counts, and verdicts on whole hosts.

A host's failures are counted over all its documents. Its failure rate is shrunk
towards the rate of all hosts by a beta prior that is fitted to the hosts
themselves (by moments), so that a host of few documents isn't condemned by them.
The verdict on each host is joined back to its documents. DataFrame functions only.

``ruled`` counts base failures alone; ``weighed``, which the query and the pipeline
use, adds rules of symbols, repeated lines and lengths of words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import boxed, cut, let, unboxed, without, words

NEAR = 8
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")

#: Symbols for each word above which a text fails.
SYMBOLS = 0.1
#: Share of repeated lines above which a text fails, and repeated lines below which it doesn't: one of three lines says nothing.
DUP_LINES, FEW_LINES = 0.3, 3
#: Bounds of the mean length of a text's words.
WORD_LENGTH = (3.0, 10.0)
#: How far a host's rate can tighten or widen these bounds.
LENIENCE = (0.5, 2.0)


def _repeated(tokens: Column) -> Column:
    """Words that lie in a window of NEAR words found twice or more in the text."""

    def covered(places: Column) -> Column:
        # Each window adds its words up to the start of the next.
        gaps = F.transform(places, lambda p, i: F.least(F.lit(NEAR), F.coalesce(F.get(places, i + 1) - p, F.lit(NEAR))))
        return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

    def places(ranked: Column) -> Column:
        def twin(r: Column, i: Column) -> Column:
            return F.get(ranked, i - 1)["h"].eqNullSafe(r["h"]) | F.get(ranked, i + 1)["h"].eqNullSafe(r["h"])

        return F.array_sort(F.transform(F.filter(ranked, twin), lambda r: r["i"]))

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - NEAR), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(NEAR)]))

    def count(win: Column) -> Column:
        ranked = F.array_sort(F.transform(win, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        found = let(let(ranked, places), covered)
        return F.when(F.size(F.array_distinct(win)) == F.size(win), 0).otherwise(found)

    hashed = F.transform(tokens, lambda w: F.xxhash64(w))
    return F.when(F.size(tokens) < NEAR, 0).otherwise(let(let(hashed, windows), count))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the METRICS of its whole texts; a null text counts as an empty one.

    Windows are compared by a 64-bit hash of their words. Columns of these names
    are replaced, as is n_lines (lines with a word); one named _m goes.
    """
    body = F.coalesce(F.col(text), F.lit(""))

    def counts(tokens: Column) -> Column:
        return F.struct(F.size(tokens).cast("long").alias("n_words"), F.length(F.array_join(tokens, "")).cast("long").alias("word_chars"), _repeated(tokens).cast("long").alias("n_repeat_words"))

    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    symbols = F.length(F.regexp_replace(body, r"[^#*$%&|<>]+", ""))
    out = without(docs, *METRICS, "n_lines", "_m").withColumn("_m", let(words(F.col(text)), counts))
    of_lines = lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))
    out = out.withColumns({k: F.col(f"_m.{k}") for k in ("n_words", "word_chars", "n_repeat_words")})
    out = out.withColumn("_m", let(lines, of_lines)).withColumns({k: F.col(f"_m.{k}") for k in ("n_lines", "n_dup_lines")})
    out = out.withColumn("n_symbols", symbols.cast("long"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return out.withColumn("base_failed", failed).drop("_m")


def host_verdicts(judged: DataFrame, host: str = "source", failed: str = "base_failed", most: float = 0.5) -> DataFrame:
    """For each host: documents, failures, shrunk rate, whether it is rejected, and the mean rate of all.

    The prior has the hosts' overall rate as its mean; its strength is what leaves,
    of the spread of the hosts' rates, the part that chance alone doesn't explain.
    Documents without a host form none.
    """
    hosts = cut(judged.where(F.col(host).isNotNull()).groupBy(host).agg(F.count("*").alias("n"), F.sum(F.col(failed).cast("long")).alias("failures")))
    rate = F.col("failures") / F.col("n")
    total = hosts.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("failures").alias("f"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("failures") * rate).alias("fr")).first()
    mean, strength = 0.0, 1.0
    if total["k"]:
        mean, n = total["f"] / total["n"], total["n"]
        within = mean * (1 - mean)
        spread = total["fr"] / n - mean * mean  # of the rates, each host by its documents
        excess = (spread - within * total["k"] / n) / max(1e-12, 1 - total["nn"] / n / n) if total["k"] > 1 else 0.0
        strength = min(1e6, max(1.0, within / excess - 1)) if excess > 0 else 1e6
    shrunk = (F.col("failures") + mean * strength) / (F.col("n") + strength)
    return hosts.withColumn("rate", shrunk).withColumn("rejected", F.col("rate") > most).withColumn("mean", F.lit(float(mean)))


def ruled(docs: DataFrame, text: str = "text", host: str = "source", most: float = 0.5, judged: DataFrame | None = None) -> DataFrame:
    """``docs`` with METRICS, ``host_rate`` and ``kept``.

    A document is kept if it passes its own rules and its host isn't rejected. A
    document without a host is judged by its own rules alone (host_rate null).
    Empty tables give empty results; repeated rows are rows of their own.
    ``judged`` may hold ``measured(docs)`` where that has been kept already.
    """
    rows = judged if judged is not None else measured(docs, text)
    verdicts = host_verdicts(rows, host, most=most).select(F.col(host).alias("_host"), F.col("rate").alias("host_rate"), F.col("rejected").alias("_rejected"))
    out = without(rows, "host_rate", "kept", "_host", "_rejected").join(verdicts, F.col(host) == F.col("_host"), "left")
    return out.withColumn("kept", ~F.col("base_failed") & ~F.coalesce("_rejected", F.lit(False))).drop("_host", "_rejected")


def exceeds(lenience: Column | float = 1.0) -> Column:
    """Whether a measured text fails the rules of symbols, repeated lines or lengths of words, their bounds ``lenience`` times as wide."""
    wide = lenience if isinstance(lenience, Column) else F.lit(lenience)
    least, most = WORD_LENGTH
    symbols = F.col("n_symbols") > SYMBOLS * wide * F.col("n_words")
    lines = (F.col("n_dup_lines") >= FEW_LINES) & (F.col("n_dup_lines") > F.least(DUP_LINES * wide, F.lit(1.0)) * F.col("n_lines"))
    lengths = (F.col("word_chars") * wide < least * F.col("n_words")) | (F.col("word_chars") > most * wide * F.col("n_words"))
    return symbols | lines | lengths


def weighed(docs: DataFrame, text: str = "text", host: str = "source", most: float = 0.5, judged: DataFrame | None = None) -> DataFrame:
    """``docs`` with METRICS, n_lines, ``host_rate`` (of failures of any rule) and ``kept``.

    A document is kept if its host isn't rejected, it passes its base rules, and it
    stays within the other bounds as its host's rate widens or tightens them: by the
    mean rate of all hosts over the host's own, within LENIENCE. Without a host they
    hold as they are. Empty tables give empty results; repeated rows are rows of
    their own. ``judged`` may hold ``measured(docs)`` where that has been kept already.
    """
    rows = judged if judged is not None else measured(docs, text)
    verdicts = host_verdicts(rows.withColumn("_failed", F.col("base_failed") | exceeds()), host, "_failed", most)
    lenience = F.greatest(F.lit(LENIENCE[0]), F.least(F.lit(LENIENCE[1]), F.col("mean") / F.col("rate")))
    verdicts = verdicts.select(F.col(host).alias("_host"), F.col("rate").alias("host_rate"), F.col("rejected").alias("_rejected"), F.when(F.col("rate") > 0, lenience).otherwise(1.0).alias("_wide"))
    out = without(rows, "host_rate", "kept", "_host", "_rejected", "_wide").join(verdicts, F.col(host) == F.col("_host"), "left")
    kept = ~F.col("base_failed") & ~F.coalesce("_rejected", F.lit(False)) & ~exceeds(F.coalesce("_wide", F.lit(1.0)))
    return out.withColumn("kept", kept).drop("_host", "_rejected", "_wide")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    judged = cut(measured(docs).select("doc_id", "source", "n_lines", *METRICS))
    return weighed(docs, judged=judged).select("doc_id", *METRICS, F.round("host_rate", 6).alias("host_rate"), "kept")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass all rules, their columns unchanged, whatever their names.

    Texts are measured once. Null and empty texts fail; a null source is no host;
    repeated rows are judged alike; an empty table gives an empty result.
    """
    judged = cut(measured(boxed(docs, text=F.col("text"), source=F.col("source"))).drop("text"))
    return unboxed(weighed(judged, judged=judged).where("kept"), docs)


#: The same, window by window.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT rid, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
rep AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
cov AS (SELECT rid, count(DISTINCT i + k) AS n FROM rep, range(8) r(k) GROUP BY rid),
ln AS (SELECT rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
m AS (SELECT doc_id, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
      len(l) - len(list_distinct(l)) AS n_dup_lines, len(l) AS n_lines, coalesce(cov.n, 0) AS n_repeat_words FROM d JOIN ln USING (rid) LEFT JOIN cov USING (rid)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
j AS (SELECT *, base_failed OR n_symbols > 0.1::DOUBLE * n_words OR (n_dup_lines >= 3 AND n_dup_lines > 0.3::DOUBLE * n_lines) OR word_chars < 3::DOUBLE * n_words OR word_chars > 10::DOUBLE * n_words AS failed FROM b),
h AS (SELECT source, count(*)::DOUBLE AS n, sum(failed::INT)::DOUBLE AS f FROM j WHERE source IS NOT NULL GROUP BY 1),
p AS (SELECT count(*) AS k, sum(n) AS n, sum(f) AS f, sum(n * n) AS nn, sum(f * f / n) AS fr FROM h),
q AS (SELECT f / n AS mean, CASE WHEN k > 1 THEN (fr / n - (f / n) * (f / n) - (f / n) * (1 - f / n) * k / n) / greatest(1e-12, 1 - nn / n / n) ELSE 0 END AS excess FROM p),
s AS (SELECT mean, CASE WHEN excess > 0 THEN least(1e6, greatest(1.0, mean * (1 - mean) / excess - 1)) ELSE 1e6 END AS strength FROM q),
r AS (SELECT source, mean, (f + mean * strength) / (n + strength) AS rate FROM h, s),
v AS (SELECT source, rate, CASE WHEN rate > 0 THEN greatest(0.5::DOUBLE, least(2::DOUBLE, mean / rate)) ELSE 1 END AS wide FROM r),
k AS (SELECT j.*, rate, coalesce(wide, 1)::DOUBLE AS wide FROM j LEFT JOIN v USING (source))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(rate, 6) AS host_rate,
       NOT base_failed AND coalesce(rate <= 0.5, true) AND NOT (n_symbols > 0.1::DOUBLE * wide * n_words OR (n_dup_lines >= 3 AND n_dup_lines > least(0.3::DOUBLE * wide, 1) * n_lines)
           OR word_chars * wide < 3::DOUBLE * n_words OR word_chars > 10::DOUBLE * wide * n_words) AS kept
FROM k
"""
