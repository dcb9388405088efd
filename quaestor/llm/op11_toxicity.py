"""Toxicity: clauses matched by a weighted finite-state grammar of insults, threats, targets, negation and reported speech.

A clause's words become symbols: insults by a lexicon, the others by short lists. Four
transducers, composed into one machine, read the symbols: negation weakens an insult
that follows it, reported speech weakens all that follows, an insult beside a target
weighs more, and a threat counts with a target alone. Clauses, not words, are scored.

The lexicon is learnt from labelled documents, as word beginnings and whole words
that stand in toxic documents far more often than chance would have it. Copies of one
text are one witness: what counts are the groups of documents with a common least
word hash, kept as 64-bit masks that combine before the shuffle. The sum of a
document's clauses becomes a probability by a logistic curve, fitted to counts of the
labelled documents by rounded sum.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from math import log

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, small_batches

#: Labelled rows that are learnt from, at most (about; drawn by hash of their key).
SAMPLE = 200_000
#: Lengths of word beginnings, entries of the lexicon at most, least and largest weight of one.
SHORT, LONG, ENTRIES = 3, 8, 20_000
LEAST, MOST = 2.5, 6.0
#: Steps of ln(1 + sum of clauses) by which labelled documents are counted.
STEP = 4
#: Intercept and slope before any label is seen, and how many observations they weigh.
PRIOR, HELD = (-3.0, 2.0), 0.05

# Word lists of the grammar.
INSULTS = ("dumb", "fool", "idiot", "imbecile", "jerk", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless", "dummkopf", "trottel", "idiota", "estúpido", "imbécil", "imbécile", "crétin", "abruti")
THREATS = ("kill", "murder", "hurt", "destroy", "stab", "shoot", "töten", "umbringen", "matar", "golpear", "tuer", "frapper")
TARGETS = ("you", "your", "yours", "you're", "he", "she", "they", "him", "her", "them", "du", "dich", "dir", "ihr", "euch", "tú", "te", "usted", "ustedes", "tu", "toi", "vous")
NEGATIONS = ("not", "no", "never", "isn't", "aren't", "don't", "won't", "nicht", "kein", "keine", "nie", "nunca", "jamás", "pas", "jamais")
REPORTS = ("said", "says", "wrote", "called", "quoted", "reported", "sagte", "schrieb", "dijo", "escribió", "dit", "écrit")

#: What a negated and a reported insult keep of its weight, what a target adds to an insult, what a threat at a target weighs.
NEGATED, REPORTED, AIMED, THREAT = 0.3, 0.5, 1.5, 4.0
#: Words that a negation, a target or a threat reaches.
REACH = 3

_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_END = re.compile(r"[.!?;\n]")

#: (state, symbol) to (next state, symbol, factor of the word's own weight, weight added).
Step = Callable[[object, str], tuple[object, str, float, float]]


def negation(state: int, x: str) -> tuple[int, str, float, float]:
    if x == "negation":
        return REACH, x, 1.0, 0.0
    left = max(0, state - 1)
    if state and x in ("insult", "threat"):
        return left, f"negated {x}", NEGATED, 0.0
    return left, x, 1.0, 0.0


def reported(state: int, x: str) -> tuple[int, str, float, float]:
    if x == "report":
        return 1, x, 1.0, 0.0
    return state, x, REPORTED if state else 1.0, 0.0


def target(state: tuple[int, int], x: str) -> tuple[tuple[int, int], str, float, float]:
    """State: words for which a target, and an insult without one, still reach."""
    aimed, open_ = max(0, state[0] - 1), max(0, state[1] - 1)
    if x == "target":
        return (REACH, 0), x, 1.0, AIMED if state[1] else 0.0
    if x == "insult":
        return (aimed, 0 if state[0] else REACH), x, 1.0, AIMED if state[0] else 0.0
    return (aimed, open_), x, 1.0, 0.0


def threat(state: tuple[int, int], x: str) -> tuple[tuple[int, int], str, float, float]:
    """State: words for which a target, and a threat without one, still reach."""
    aimed, open_ = max(0, state[0] - 1), max(0, state[1] - 1)
    if x == "target":
        return (REACH, 0), x, 1.0, THREAT if state[1] else 0.0
    if x == "threat":
        return (aimed, 0 if state[0] else REACH), x, 1.0, THREAT if state[0] else 0.0
    return (aimed, open_), x, 1.0, 0.0


def composed(first: Step, second: Step) -> Step:
    """The transducer that reads what ``second`` makes of what ``first`` writes: factors apply in turn, to what ``second`` adds too."""

    def step(state, x):
        (a, y, f, g), b = first(state[0], x), state[1]
        b, z, h, k = second(b, y)
        return (a, b), z, f * h, g + f * k

    return step


SYMBOLS = ("insult", "threat", "target", "negation", "report", "word")


def tabulated(step: Step, start) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Next state, factor and added weight of each state that can be reached, by symbol; the start is state 0."""
    number, queue, rows = {start: 0}, [start], []
    for state in queue:
        row = []
        for x in SYMBOLS:
            after, _, factor, added = step(state, x)
            if after not in number:
                number[after] = len(number)
                queue.append(after)
            row.append((number[after], factor, added))
        rows.append(row)
    table = np.array(rows)
    return table[:, :, 0].astype(int), table[:, :, 1], table[:, :, 2]


def grammar() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Reported speech over negation over targets over threats, as one table."""
    return tabulated(composed(reported, composed(negation, composed(target, threat))), (0, (0, ((0, 0), (0, 0)))))


def matcher(entries: list[tuple[str, float]]):
    """Finds the lexicon's entries and the threats: those that end in a blank are whole words, the others beginnings of words."""
    found = ahocorasick.Automaton()
    for word in THREATS:
        found.add_word(word, (len(word), True, "threat", 0.0))
    for entry, weight in entries:
        word = entry.rstrip(" ")
        found.add_word(word, (len(word), word != entry, "insult", weight))
    found.make_automaton()
    return found


def clause_scores(text: str, find, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[tuple[float, int, int]]:
    """(score, start, end) of the clauses of a lower-cased text that the grammar matches with a score above 0."""
    hits: dict[int, tuple[str, float]] = {}
    for last, (n, whole, symbol, weight) in find.iter(text):
        start = last - n + 1
        if start and text[start - 1].isalpha() or whole and text[last + 1 : last + 2].isalpha():
            continue
        if start not in hits or hits[start][1] < weight:
            hits[start] = (symbol, weight)
    if not hits:
        return []
    ends = [m.start() for m in _END.finditer(text)]
    out, (after, factor, added) = [], table
    for clause in sorted({bisect_right(ends, h) for h in hits}):
        a, b = ends[clause - 1] + 1 if clause else 0, ends[clause] if clause < len(ends) else len(text)
        state, score = 0, 0.0
        for m in _WORD.finditer(text, a, b):
            symbol, weight = hits.get(m.start()) or (_LISTED.get(m[0], "word"), 0.0)
            k = SYMBOLS.index(symbol)
            score += factor[state, k] * weight + added[state, k]
            state = after[state, k]
        if score > 0:
            out.append((float(score), a, b))
    return out


_LISTED = {w: s for s, words in (("target", TARGETS), ("negation", NEGATIONS), ("report", REPORTS)) for w in words}


def _groups(mask: Column) -> Column:
    """How many groups a mask of 64 stands for, some of them on one bit."""
    return -64 * F.log(1 - F.least(F.bit_count(mask).cast("double"), F.lit(63.5)) / 64)


def _evidence(yes: Column, no: Column, rate: float) -> Column:
    """Minus the logarithm of the chance, about, of so large a share of ``yes`` where ``rate`` is expected."""
    n = yes + no
    share = yes / n
    other = F.when(no > 0, no * F.log((1 - share) / (1 - rate))).otherwise(0.0)
    return F.when(share > rate, yes * F.log(share / rate) + other).otherwise(0.0)


def lexicon(texts: DataFrame) -> list[tuple[str, float]]:
    """Word beginnings and whole words (these end in a blank) with weights, from rows (text, toxic); at most ENTRIES.

    An entry stands in toxic texts with LEAST above chance in log odds, and with more
    evidence, in rows and in groups of copies, than the square of all rows could bring
    about. One whose rows mostly share a longer entry gives way to it; of the rest the
    shortest stand. INSULTS that the rows say nothing of have weight LEAST.
    """
    total = texts.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("yes"), F.count("*").alias("n")).first()
    yes, n = total["yes"], total["n"]
    listed = {f"{w} ": LEAST for w in INSULTS}
    if not 0 < yes < n:
        return sorted(listed.items())
    rate = yes / n
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{M}]+"), F.lit(0)))
    # Exploding arrays of one keeps the words and their bit from being found anew for each use.
    told = texts.select("toxic", F.explode(F.array(words)).alias("words")).where(F.size("words") > 0)
    bit = F.expr("shiftleft(1L, cast(pmod(array_min(transform(words, w -> xxhash64(w))), 64) as int))")
    told = told.select("toxic", "words", F.explode(F.array(bit)).alias("bit")).select("toxic", "bit", F.explode("words").alias("word"))
    marked = lambda k: F.coalesce(F.bit_or(F.when(F.col("toxic") == k, F.col("bit"))), F.lit(0))
    counted = told.groupBy("word").agg(F.sum("toxic").alias("yes"), F.sum(1 - F.col("toxic")).alias("no"), marked(1).alias("ym"), marked(0).alias("nm"))
    starts = F.transform(F.sequence(F.lit(SHORT), F.least(F.lit(LONG), F.length("word"))), lambda k: F.col("word").substr(F.lit(1), k))
    entries = F.when(F.length("word") >= SHORT, F.concat(starts, F.array(F.concat("word", F.lit(" "))))).otherwise(F.array(F.concat("word", F.lit(" "))))
    stems = counted.select(F.explode(entries).alias("entry"), "yes", "no", "ym", "nm").groupBy("entry").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"), F.bit_or("ym").alias("ym"), F.bit_or("nm").alias("nm"))
    weight = F.log((F.col("yes") + 0.5) / yes) - F.log((F.col("no") + 0.5) / (n - yes))
    evidence = F.least(_evidence(F.col("yes").cast("double"), F.col("no").cast("double"), rate), _evidence(_groups(F.col("ym")), _groups(F.col("nm")), rate))
    weighed = stems.withColumns({"weight": F.least(weight, F.lit(MOST)), "evidence": evidence})
    known = cut(weighed.where(F.col("entry").isin(*listed) | (F.col("weight") >= LEAST) & (F.col("evidence") >= 2 * log(n))))
    told = known.where(F.col("entry").isin(*listed)).select("entry", "weight").collect()  # the INSULTS at most
    listed |= {r["entry"]: max(0.0, r["weight"]) for r in told}
    good = known.where((F.col("weight") >= LEAST) & (F.col("evidence") >= 2 * log(n)))
    parent = F.col("entry").substr(F.lit(1), F.length("entry") - 1)
    longer = good.groupBy(parent.alias("entry")).agg(F.max("yes").alias("_part"))
    own = cut(good.join(longer, "entry", "left").where(F.coalesce("_part", F.lit(0)) < 0.8 * F.col("yes")).drop("_part"))
    shorter = own.select("entry", F.explode(F.transform(F.sequence(F.lit(SHORT), F.greatest(F.length("entry") - 1, F.lit(SHORT))), lambda k: F.col("entry").substr(F.lit(1), k))).alias("start")).where("start != entry")
    nested = shorter.join(own.select(F.col("entry").alias("start")), "start", "left_semi").select("entry")
    learnt = own.join(nested, "entry", "left_anti").orderBy(F.desc("evidence"), "entry").limit(ENTRIES)
    return sorted((listed | {r["entry"]: r["weight"] for r in learnt.collect()}).items())


def curve(counts: list[tuple[int, int, int]]) -> tuple[float, float]:
    """Intercept and slope of the probability by ln(1 + sum), from (step, toxic or not, documents), by Newton's method; the slope isn't negative."""
    x = np.array([[1.0, s / STEP] for s, _, _ in counts] or np.zeros((0, 2)))
    y, n = np.array([t for _, t, _ in counts], float), np.array([c for _, _, c in counts], float)
    at = prior = np.array(PRIOR)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        slope = x.T @ (n * (y - p)) - HELD * (at - prior)
        bend = (x * (n * p * (1 - p))[:, None]).T @ x + HELD * np.eye(2)
        move = np.linalg.solve(bend, slope)
        at = at + move * min(1.0, 2 / max(1e-9, np.abs(move).max()))
    return float(at[0]), max(0.0, float(at[1]))


def scored(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", held_out: Column | None = None, sample: int = SAMPLE) -> DataFrame:
    """For each row of ``docs``: doc_id (``key``), held_out, score, predicted, n_clauses, clause_score (the sum), worst_clause.

    Learns from about ``sample`` labelled rows, at most, that ``held_out`` leaves: by
    default those whose key's crc32, as text, doesn't divide by 5. A key with several
    labels is toxic if one says so; null keys have no label and aren't held out; null
    labels are none. Null and empty texts match nothing and get the probability of
    texts without a match. Without labels of both kinds the listed insults and the
    prior curve score. Repeated rows are each returned; an empty table gives an empty
    result; other columns aren't looked at.
    """
    spark = docs.sparkSession
    small_batches(spark)
    out_of = held_out if held_out is not None else F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"), out_of.alias("held_out"))
    told = labels.select(F.col(key).alias("doc_id"), F.col(label).cast("long").alias("toxic")).dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    told = told.where(~F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))) if held_out is None else told
    n = told.count()
    drawn = cut(told.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, sample / max(1, n))))))
    # At most about ``sample`` rows of 16 bytes.
    taught = rows.where(~F.col("held_out")).join(F.broadcast(drawn), "doc_id")
    entries = spark.sparkContext.broadcast(lexicon(taught.select("text", F.least(F.col("toxic"), F.lit(1)).alias("toxic"))))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, table = matcher(entries.value), grammar()
        for batch in batches:
            out = []
            for low in batch.column("low").to_pylist():
                found = clause_scores(low or "", find, table)
                best = max(found, default=None)
                out.append((len(found), sum(x[0] for x in found), None if best is None else low[best[1] : best[2]].strip()))
            n, total, worst = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(n, pa.int64()), pa.array(total, pa.float64()), pa.array(worst, pa.string())], names=["doc_id", "held_out", "n_clauses", "clause_score", "worst_clause"])

    kind = dict(rows.dtypes)["doc_id"]
    matched = cut(rows.select("doc_id", "held_out", F.lower("text").alias("low")).mapInArrow(match, f"doc_id {kind}, held_out boolean, n_clauses long, clause_score double, worst_clause string"))
    height = F.log1p("clause_score")
    # A row for each step of the logarithm and label.
    counts = matched.where(~F.col("held_out")).join(F.broadcast(drawn), "doc_id").groupBy(F.round(height * STEP).cast("int").alias("step"), F.least("toxic", F.lit(1)).alias("toxic")).count().collect()
    a, b = curve([(r["step"], r["toxic"], r["count"]) for r in counts])
    score = 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * height)))
    return matched.select("doc_id", "held_out", score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), "n_clauses", "clause_score", "worst_clause")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scored(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    return found.drop("worst_clause")
