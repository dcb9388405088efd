"""Periodic runs: stretches of a text in which one group of words repeats four times or more.

All-lag scan: a text's words become numbers, which are compared with themselves
shifted by each lag up to a quarter of their count; a long enough stretch of equal
places is a run of that period. A text whose comparisons exceed WORK is dealt out as
ranges of lags, so that no task has to go through all lags of a long text alone.
Runs that several lags find are kept at the smallest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches

#: A run's periods, and its words, at least.
TIMES, LEAST = 4, 6
#: Comparisons of one range of lags, and the ranges that a text is dealt out as, at most.
WORK, PARTS = 1 << 25, 64
#: Bytes of a text for each word, roughly; only the number of ranges depends on it.
_WORD_BYTES = 6
#: Comparisons made at once for short texts.
_BLOCK = 1 << 18
_RUNS = "runs array<struct<start:bigint,length:bigint,period:bigint>>"
_OUT = f"n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, n_words long, n_dropped long, {_RUNS}"

Run = tuple[int, int, int]


def numbered(words: list[bytes]) -> np.ndarray:
    """A number for each word, the same for equal words and never the type's largest."""
    last = {w: i for i, w in enumerate(words)}
    ids = np.fromiter(map(last.__getitem__, words), np.int64, len(words))
    if len(words) >= 1 << 16:
        ids = np.unique(ids, return_inverse=True)[1]
    return ids.astype(np.uint16 if len(last) < 1 << 16 and (not len(ids) or ids.max() < (1 << 16) - 1) else np.uint32)


def _stretches(equal: np.ndarray, lag: int, least: int) -> Iterator[Run]:
    edges = np.flatnonzero(np.diff(equal.view(np.int8), prepend=0, append=0))
    for a, b in edges.reshape(-1, 2).tolist():
        if b - a >= least:
            yield a, b - a + lag, lag


def scanned(ids: np.ndarray, low: int, high: int) -> list[Run]:
    """(start, length, lag) of each longest stretch with a period of ``lag`` words, for all lags from ``low`` up to ``high``, ``high`` not included."""
    found, n = [], len(ids)
    high = min(high, n // TIMES + 1)
    need = lambda lag: max(LEAST, TIMES * lag) - lag
    if n > 2048:
        for lag in range(low, high):
            equal = ids[lag:] == ids[:-lag]
            if np.count_nonzero(equal) >= need(lag):
                found += _stretches(equal, lag, need(lag))
        return found
    padded = np.concatenate([ids, np.full(n, np.iinfo(ids.dtype).max, ids.dtype)])
    shifts = np.lib.stride_tricks.sliding_window_view(padded, n) if n else padded.reshape(0, 0)
    step = max(1, _BLOCK // max(1, n))
    for first in range(low, high, step):
        lags = np.arange(first, min(first + step, high))
        equal = shifts[first : first + len(lags)] == ids
        enough = np.count_nonzero(equal, axis=1) >= np.maximum(LEAST, TIMES * lags) - lags
        for k in np.flatnonzero(enough).tolist():
            found += _stretches(equal[k], first + k, need(first + k))
    return found


def least_periods(found: list[Run]) -> list[Run]:
    """Each stretch once, with its smallest period, by start and period.

    A stretch of four periods or more that has a smaller period too is found, with the
    same ends, at that lag, as the smaller divides the larger.
    """
    best: dict[tuple[int, int], int] = {}
    for start, length, lag in found:
        if lag < best.get((start, length), lag + 1):
            best[start, length] = lag
    return sorted(((a, n, q) for (a, n), q in best.items()), key=lambda r: (r[0], r[2]))


def summary(words: list[bytes], runs: list[Run]) -> tuple:
    """The values of _OUT for a text's words and runs."""
    top = None
    for r in runs:
        if top is None or r[1] * top[2] > top[1] * r[2]:  # runs are sorted as ties go
            top = r
    listing = "".join(f"{a},{n},{q}\n" for a, n, q in runs)
    kept, dropped = words, 0
    if runs:
        gone = np.zeros(len(words) + 1, np.int64)
        for a, n, q in runs:
            gone[a + q] += 1
            gone[a + n] -= 1
        stays = np.cumsum(gone[:-1]) == 0
        dropped = int(len(words) - stays.sum())
        kept = [words[i] for i in np.flatnonzero(stays).tolist()]
    of_top = (None,) * 4 if top is None else (*top, 1000 * top[1] // top[2])
    return (len(runs), *of_top, hashlib.sha256(listing.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest(), len(words), dropped, [{"start": a, "length": n, "period": q} for a, n, q in runs])


def planted(words: list[bytes], h: int | None) -> list[bytes]:
    """The words with the tail that the contract of the query plants where ``h`` divides by 10."""
    n = len(words)
    if h is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * ((n - a) // len(unit) + 1))[: n - a]


def _words(text: bytes | None, h: int | None) -> list[bytes]:
    return planted((text or b"").split(), h)  # bytes split at the six ASCII blanks


def _range(n: int, part: int, parts: int) -> tuple[int, int]:
    lags = n // TIMES
    return 1 + lags * part // parts, 1 + lags * (part + 1) // parts


def _columns(rows: list[tuple], schema: pa.Schema) -> list[pa.Array]:
    return [pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)]


_RUN_TYPE = pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")]))
_SUMMARY = pa.schema([*[(k, pa.int64()) for k in ("n_runs", "start", "length", "period", "exponent_milli")], ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()), ("n_words", pa.int64()), ("n_dropped", pa.int64()), ("runs", _RUN_TYPE)])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Short texts, all lags of each."""
    for batch in batches:
        out = []
        for text, h in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("plant").to_pylist(), strict=True):
            words = _words(text, h)
            ids = numbered(words)
            out.append(summary(words, least_periods(scanned(ids, *_range(len(ids), 0, 1)))))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *_columns(out, _SUMMARY)], names=["doc_id", *_SUMMARY.names])


def _ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Long texts, one range of lags in a row; the text goes on with the first range alone."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            text, h, part, parts = (row.column(c)[0].as_py() for c in ("text", "plant", "part", "parts"))
            ids = numbered(_words(text.encode(), h))
            found = least_periods(scanned(ids, *_range(len(ids), part, parts)))
            runs = pa.array([[{"start": a, "length": n, "period": q} for a, n, q in found]], _RUN_TYPE)
            carried = pa.array([None if part else text], pa.string())
            yield pa.RecordBatch.from_arrays([row.column("doc_id"), row.column("digest"), row.column("plant"), row.column("copies"), carried, runs], names=["doc_id", "digest", "plant", "copies", "text", "runs"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Long texts again, with what all their ranges have found."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            words = _words(row.column("text")[0].as_py().encode(), row.column("plant")[0].as_py())
            found = [(r["start"], r["length"], r["period"]) for r in row.column("runs")[0].as_py()]
            out = _columns([summary(words, least_periods(found))], _SUMMARY)
            yield pa.RecordBatch.from_arrays([row.column("doc_id"), row.column("copies"), *out], names=["doc_id", "copies", *_SUMMARY.names])


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", plant: Column | None = None, work: int = WORK, parts: int = PARTS) -> DataFrame:
    """For each row of ``docs``: doc_id (``key``) and the columns of its runs.

    n_runs, start, length, period and exponent_milli of the run with the greatest
    exponent, digests of the list of runs and of the text without repeats, n_words,
    n_dropped and ``runs``. Null and empty texts have no words and no run: four nulls
    and the digests of empty texts. Repeated rows are each returned; null keys are
    kept; an empty table gives an empty result; other columns aren't looked at.
    ``plant`` may give a number by which ``planted`` changes a text before the scan.
    Texts of more than about ``work`` comparisons are dealt out as up to ``parts`` ranges.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.select(F.col(key)).schema[0].dataType.simpleString()
    number = (plant if plant is not None else F.lit(None)).cast("long")
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), number.alias("plant"))
    n = F.octet_length("text") / _WORD_BYTES
    ranges = F.least(F.lit(parts), F.ceil(n * n / TIMES / work)).cast("int")
    short = rows.where(ranges <= 1).mapInArrow(_whole, f"doc_id {kind}, {_OUT}")
    # Rows that agree in all are one until the end.
    long = rows.where(ranges > 1).groupBy("doc_id", "text", "plant").agg(F.count("*").alias("copies"))
    long = long.withColumn("parts", ranges).withColumn("digest", F.sha2("text", 256)).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = long.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id", "digest", "part")
    found = dealt.mapInArrow(_ranged, f"doc_id {kind}, digest string, plant long, copies long, text string, {_RUNS}")
    met = found.groupBy("doc_id", "digest", "plant", "copies").agg(F.max("text").alias("text"), F.flatten(F.collect_list("runs")).alias("runs"))
    merged = met.mapInArrow(_merged, f"doc_id {kind}, copies long, {_OUT}")
    each = merged.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies", "_copy")
    return short.unionByName(each)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = periodic_runs(docs, plant=F.crc32(F.col("doc_id").cast("string").cast("binary")))
    return found.drop("n_words", "n_dropped", "runs")
