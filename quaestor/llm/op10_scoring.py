"""LM scoring by context-tree weighting over bytes.

Each byte is coded as eight binary decisions. For every decision and every context
of 0 to DEPTH preceding bytes there is a Krichevsky-Trofimov estimator, and a
context's weighted probability is half its own estimate and half the product of
its longer contexts'. Counts come from all training documents as a table of byte
sequences; estimates, weights and the mixtures along each path are computed level
by level with joins. A sequence's mixture is looked up for each byte scored.

The baseline is a unigram model with add-one smoothing. Words that make up a
2**-20th of the training tokens or more (2**20 at most) are looked up in place;
the others are joined to the table of counts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import log, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Lookup, cut, small_batches

#: Bytes of the longest context, 6 at most.
DEPTH = 4
#: Byte sequences whose scores are broadcast at most (16 bytes each); more are joined.
HELD = 1 << 21
#: A word is frequent if it makes up one of so many training tokens.
RARE = 1 << 20
#: Distinct keys that a task gathers before it hands them on.
FLUSH = 400_000
#: Stands before a text and ends it: a byte that UTF-8 never has.
END = b"\xff"


def _layout(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The sequences (long: depth bytes of context, then the byte) of all texts, and where each text's begin.

    ENDs stand before a text, and one, coded like any byte, ends it.
    """
    gap = END * depth
    data = np.frombuffer(gap + b"".join(x + gap for x in texts) if depth else b"".join(x + END for x in texts), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    step = max(depth, 1)
    first = depth + np.concatenate([[0], np.cumsum(sizes + step)[:-1]])
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])
    at = np.repeat(first - begin[:-1], sizes + 1) + np.arange(begin[-1])
    grams = data[at].astype(np.int64)
    for k in range(1, depth + 1):
        grams |= data[at - k].astype(np.int64) << (8 * k)
    return grams, begin


def _blocks(batch: pa.RecordBatch, most: int = 1 << 22) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of a batch of about ``most`` bytes, with their lower-cased texts."""
    texts = [(x or "").encode().lower() for x in batch.column("text").to_pylist()]
    a, size = 0, 0
    for i, x in enumerate(texts):
        size += len(x)
        if size >= most or i == len(texts) - 1:
            yield batch.slice(a, i + 1 - a), texts[a : i + 1]
            a, size = i + 1, 0


def _tallies(depth: int):
    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def handed() -> Iterator[pa.RecordBatch]:
            n, m = len(words), len(keys)
            yield pa.RecordBatch.from_arrays([pa.array([*[x.decode() for x in words], *[None] * m], pa.string()), pa.array(np.concatenate([np.zeros(n, np.int64), keys])), pa.array(np.concatenate([np.fromiter(words.values(), np.int64, n), counts]))], names=["word", "gram", "n"])

        words: Counter = Counter()
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for part, texts in _blocks(batch):
                held = np.array(part.column("held_out").to_pylist(), bool)
                grams, begin = _layout(texts, depth)
                learnt = np.repeat(~held, np.diff(begin))
                for text, out in zip(texts, held.tolist(), strict=True):
                    if not out:
                        words.update(text.split())
                        words[b""] += 1  # the end
                for some, weight in ((grams[learnt], 1), (grams[~learnt], 0)):
                    more, n = np.unique(some, return_counts=True)
                    keys, counts = np.concatenate([keys, more]), np.concatenate([counts, n * weight])
                keys, where = np.unique(keys, return_inverse=True)
                counts = np.bincount(where, counts, len(keys)).astype(np.int64)
                if len(words) > FLUSH or len(keys) > FLUSH:
                    yield from handed()
                    words.clear()
                    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        yield from handed()

    return tally


def _stirling(z: Column) -> tuple[Column, Column]:
    """x from 8 on, and what ln of z's gamma function has beside (x - 1/2) ln x - x + ln(2 pi) / 2. Good to 1e-11."""
    rising = F.lit(1.0)
    for k in range(8):
        rising = rising * (z + k)
    x = F.when(z < 8, z + 8.0).otherwise(z)
    tail = 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x) - 1 / (1680 * x * x * x * x * x * x * x)
    return x, tail - F.when(z < 8, F.log(rising)).otherwise(0.0)


def _estimate(n0: str, n1: str) -> Column:
    """The natural logarithm of the Krichevsky-Trofimov probability of the counts.

    The three gamma functions' large terms are taken together, so that what cancels
    in them costs no digits, however large the counts are.
    """
    a, b = F.col(n0).cast("double"), F.col(n1).cast("double")
    (x, tx), (y, ty), (z, tz) = _stirling(a + 0.5), _stirling(b + 0.5), _stirling(a + b + 1.0)
    share = lambda v: F.when(v * 2 < z, F.log(v / z)).otherwise(F.log1p((v - z) / z))
    moved = x + y - z
    return (x - 0.5) * share(x) + (y - 0.5) * share(y) + (moved - 0.5) * F.log(z) - moved + (tx + ty - tz) + 0.5 * log(2 * pi) - log(pi)


def _mask(depth: int) -> Column:
    return F.lit((1 << (8 * depth)) - 1).cast("long")


def mixtures(grams: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(gram, score): log10 of each sequence's last byte's probability in its context, from counts ``n`` (0 if unseen)."""
    decision = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(1 << i) + F.shiftright(F.col("gram").bitwiseAND(255), 8 - i)).cast("int").alias("node"), F.shiftright("gram", 7 - i).bitwiseAND(1).alias("bit")) for i in range(8)]))
    steps = grams.select("gram", "n", F.shiftright("gram", 8).alias("ctx"), decision.alias("d")).select("gram", "n", "ctx", "d.node", "d.bit")
    ones = F.sum(F.col("n") * F.col("bit"))
    leaves = steps.groupBy("ctx", "node").agg((F.sum("n") - ones).alias("n0"), ones.alias("n1"))
    levels = {depth: cut(leaves.withColumn("lpw", _estimate("n0", "n1")).withColumn("w", F.lit(1.0)))}
    for d in range(depth - 1, -1, -1):
        up = levels[d + 1].groupBy(F.col("ctx").bitwiseAND(_mask(d)).alias("ctx"), "node").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("lpw").alias("kids"))
        up = up.withColumn("own", _estimate("n0", "n1"))
        high, low = F.greatest("own", "kids"), F.least("own", "kids")
        up = up.withColumn("lpw", high + F.log1p(F.exp(low - high)) - log(2))
        levels[d] = cut(up.withColumn("w", F.exp(F.col("own") - log(2) - F.col("lpw"))).drop("own", "kids"))
    one = (F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1.0)
    path = levels[0].select("ctx", "node", (F.col("w") * one).alias("p"), (1 - F.col("w")).alias("rest"))
    for d in range(1, depth + 1):
        above = path.select(F.col("ctx").alias("up"), F.col("node").alias("un"), F.col("p").alias("up_p"), F.col("rest").alias("up_rest"))
        level = levels[d].join(above, (F.col("ctx").bitwiseAND(_mask(d - 1)) == F.col("up")) & (F.col("node") == F.col("un")))
        path = level.select("ctx", "node", (F.col("up_p") + F.col("up_rest") * F.col("w") * one).alias("p"), (F.col("up_rest") * (1 - F.col("w"))).alias("rest"))
    taken = F.log10(F.when(F.col("bit") == 1, F.col("p")).otherwise(1 - F.col("p")))
    return steps.join(path, ["ctx", "node"]).groupBy("gram").agg(F.sum(taken).alias("score"))


def scored(docs: DataFrame, key: str = "doc_id", text: str = "text", held_out: Column | None = None, depth: int = DEPTH, held: int = HELD) -> DataFrame:
    """For each row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    ``held_out`` tells the rows that aren't learnt from: by default those whose
    key's crc32, as text, leaves 2 when divided by 7. Null keys are learnt from; null
    texts are empty and score as their end alone. Repeated rows are all learnt and
    each returned. If nothing can be learnt, all estimates are those of no counts.
    An empty table gives an empty result; other columns aren't looked at.
    """
    spark = docs.sparkSession
    small_batches(spark)
    out_of = held_out if held_out is not None else F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 7 == 2, F.lit(False))
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"), out_of.alias("held_out"))
    tallied = cut(rows.select("text", "held_out").mapInArrow(_tallies(depth), "word string, gram long, n long").groupBy("word", "gram").agg(F.sum("n").alias("n")))
    words = tallied.where("word is not null").select("word", "n")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = total["n"], total["v"]
    scores = cut(mixtures(tallied.where("word is null").select("gram", "n"), depth))
    frequent = spark.sparkContext.broadcast({r["word"].encode(): r["n"] for r in words.where(F.col("n") * RARE >= n).toLocalIterator()})
    small = scores.limit(held + 1).count() <= held
    table = None
    if small:
        got = scores.toArrow()
        table = spark.sparkContext.broadcast((got.column("gram").to_numpy(), got.column("score").to_numpy()))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = {w: float(np.log10((c + 1) / (n + v + 1))) for w, c in frequent.value.items()}
        find = Lookup(*table.value) if small else None
        for batch in batches:
            for part, texts in _blocks(batch):
                ids, out = part.column("doc_id"), {k: [] for k in ("row", "word", "gram", "k", "n_tokens", "n_known", "base", "score", "n_bytes", "m")}
                grams, begin = _layout(texts, depth)
                sums = np.add.reduceat(find(grams), begin[:-1]) if small else np.zeros(len(texts))

                def put(row, word, gram, k, *rest, out=out):
                    for name, x in zip(out, (row, word, gram, k, *(rest or (0, 0, 0.0, 0.0, 0, 0))), strict=True):
                        out[name].append(x)

                for i, text in enumerate(texts):
                    tokens = text.split()
                    tokens.append(b"")
                    base = [logs.get(x) for x in tokens]
                    known = [x for x in base if x is not None]
                    put(i, None, None, 0, len(tokens), len(known), float(sum(known)), float(sums[i]), len(text), 1)
                    if len(known) < len(tokens):
                        for word, k in Counter(x for x, y in zip(tokens, base, strict=True) if y is None).items():
                            put(i, word.decode(), None, k)
                    if not small:
                        found, k = np.unique(grams[begin[i] : begin[i + 1]], return_counts=True)
                        for gram, count in zip(found.tolist(), k.tolist(), strict=True):
                            put(i, None, gram, count)
                row = pa.array(out["row"], pa.int64())
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64())
                columns = [part.column(c).take(row) for c in ("doc_id", "h", "held_out")] + [pa.array(x, t) for x, t in zip(list(out.values())[1:], kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "h", "held_out", *list(out)[1:]])

    kind = dict(rows.dtypes)["doc_id"]
    shape = f"doc_id {kind}, h long, held_out boolean, word string, gram long, k long, n_tokens long, n_known long, base double, score double, n_bytes long, m long"
    parts = rows.withColumn("h", F.xxhash64("text")).mapInArrow(score, shape)
    # A key that no word can be stands in for none, so that those rows spread out.
    apart = F.concat(F.lit(" "), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(" "), F.col("h").cast("string"))
    keyed = parts.withColumn("word", F.coalesce("word", apart))
    met = keyed.join(words.withColumnRenamed("n", "c"), "word", "left")
    if not small:
        met = met.withColumn("gram", F.coalesce("gram", -F.abs(F.xxhash64("word")) - 1)).join(scores.withColumnRenamed("score", "s"), "gram", "left").withColumn("score", F.col("score") + F.col("k") * F.coalesce("s", F.lit(0.0)))
    rare = (F.col("k") > 0) & ~F.col("word").startswith(" ")
    met = met.withColumn("base", F.col("base") + F.when(rare, F.col("k") * F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(float(n + v + 1)))).otherwise(0.0))
    met = met.withColumn("n_known", F.col("n_known") + F.when(rare & (F.col("c") > 0), F.col("k")).otherwise(0))
    by_row = met.groupBy("doc_id", "h", "held_out").agg(F.sum("m").alias("m"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "score", "n_bytes")])
    each = by_row.select("*", F.explode(F.sequence(F.lit(1), F.col("m"))).alias("_copy"))
    per = lambda c: (F.col(c) / F.col("m")).cast("long")
    point = F.col("score") / F.col("m")
    return each.select("doc_id", "held_out", per("n_tokens").alias("n_tokens"), per("n_known").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("base") / F.col("m")).alias("base_score"), point.alias("score"), per("n_bytes").alias("n_bytes"), (-point * float(np.log2(10)) / (F.col("n_bytes") / F.col("m") + 1)).alias("bits_per_byte"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"))
