"""Substring dedup by content-defined chunking.

A gear hash rolls over the bytes before each word; where it is small, a chunk ends.
Cuts so depend on the 16 bytes before them alone, and an insertion moves no cut
but those next to it. Where no blank stands among the 64 bytes before, as in Chinese
or in code without spaces, the same hash ends chunks between characters, more rarely;
such cuts depend on those 64 bytes. Only what has no such place for 512 bytes, as
periodic text may, is cut by length, counted from the cut before. A chunk belongs to
the document with the smallest id that has it (told by a 96-bit digest); in every
other document it is a repeat, and neighbouring repeats that together are long enough
form a span. A short chunk may be met anywhere by chance: a span's ends are chunks of
some length, such as have a neighbour from the same document, or the text's first and
last. Documents are told apart by id and text, so that a span is only ever cut out of
the very text it was found in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import cut, small_batches, texts_of, unboxed

#: One word start in so many ends a chunk.
WORDS = 4
#: Bytes of the gear hash's window, a power of 2.
WINDOW = 16
#: Bytes without a blank after which chunks end between characters too.
BARE = 64
#: One byte in so many can end a chunk there, if none of the WINDOW bytes before it can.
BYTES = 16
#: A chunk is cut at so many bytes at the latest.
LONGEST = 512
#: Bytes of the shortest span.
SPAN = 100
#: Bytes of a chunk that can end a span by itself.
FIRM = 32
#: Documents without an id come after all with one below this, in an order that their texts give.
NAMELESS = 1 << 62


def _gear() -> np.ndarray:
    return np.random.default_rng(8).integers(0, 1 << 32, 256, dtype=np.uint32)


def _inside(part: np.ndarray, rolled: np.ndarray, a: int, b: int) -> np.ndarray:
    """Cuts from ``a`` up to below ``b`` in a stretch without blanks; the bytes before ``a`` that they depend on are in ``part``."""
    if a >= b:
        return np.zeros(0, np.int64)
    low = max(0, a - 4 - WINDOW)
    hit = rolled[low:b] < (1 << 32) // BYTES
    count = np.concatenate([[0], np.cumsum(hit)])
    at = np.arange(len(hit))
    hit &= count[:-1] == count[np.maximum(at - WINDOW, 0)]
    inner = part[low:b] & 0xC0 == 0x80  # bytes inside a character
    ends = hit[a - 1 - low : b - 1 - low].copy()
    run = inner[a - 1 - low : b - 1 - low].copy()
    for k in (2, 3, 4):  # the last character's other bytes
        ends |= run & hit[a - k - low : b - k - low]
        run &= inner[a - k - low : b - k - low]
    return np.flatnonzero(ends & ~inner[a - low : b - low]) + a


def cuts(data: np.ndarray, words: int = WORDS) -> np.ndarray:
    """Where the chunks of a text begin and end: 0, the cuts, its length."""
    n = len(data)
    blank = np.zeros(256, bool)
    blank[[9, 10, 11, 12, 13, 32]] = True
    found, gear, last = [np.zeros(1, np.int64)], _gear(), -1
    for a in range(0, n, 1 << 18):
        low = max(0, a - 3 * WINDOW)
        part = data[low : a + (1 << 18)]
        rolled, width = gear[part], 1
        while width < WINDOW:
            rolled[width:] = rolled[width:] + (rolled[:-width] << np.uint32(width))
            width *= 2
        empty = blank[part]
        at = np.flatnonzero(empty[:-1] & ~empty[1:] & (rolled[:-1] < (1 << 32) // words)) + 1 + low
        found.append(at[at >= max(a, 1)])
        blanks = np.flatnonzero(empty[a - low :]) + a
        marks = np.concatenate([[last], blanks, [low + len(part)]])
        bare = [_inside(part, rolled, max(int(marks[g]) + 1 + BARE, a) - low, int(marks[g + 1]) - low) + low for g in np.flatnonzero(np.diff(marks) > BARE).tolist()]
        if bare:
            found[-1] = np.union1d(found[-1], np.concatenate(bare))
        last = int(blanks[-1]) if len(blanks) else last
    edges = np.concatenate([*found, [n]])
    for i in np.flatnonzero(np.diff(edges) > LONGEST)[::-1].tolist():
        more, at = [], int(edges[i])
        while edges[i + 1] - at > LONGEST:
            at += LONGEST
            while data[at] & 0xC0 == 0x80:  # inside a character
                at -= 1
            more.append(at)
        edges = np.insert(edges, i + 1, more)
    return edges


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 200):
            part = batch.slice(a, 200)
            data, offsets = texts_of(part.column(1))
            counts, places, digests = [], [], []
            for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                edges = cuts(data[x:y]) if y > x else np.zeros(1, np.int64)
                text, at = data[x:y].tobytes(), edges.tolist()
                digests += [xxhash.xxh3_128_digest(text[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
                counts.append(len(at) - 1)
                at_end = np.arange(1, len(at)) == len(at) - 1
                places.append(edges[:-1] << 32 | at_end.astype(np.int64) << 31 | edges[1:])
            whole = b"".join(digests)
            row = pa.array(np.repeat(np.arange(part.num_rows), counts))
            columns = [part.column(0).take(row), part.column(2).take(row), pa.array(np.concatenate(places)), pa.array(np.frombuffer(whole, np.int64)[::2]), pa.array(np.frombuffer(whole, np.int32)[2::4])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "h", "place", "d1", "d2"])


def _joined(shortest: int):
    """Spans out of each text's repeated chunks, which come in order."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("c")
            owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
            place, home = (x.to_numpy(zero_copy_only=False) for x in lists.flatten().flatten())
            start, end, last = place >> 32, place & 0x7FFFFFFF, place >> 31 & 1 == 1
            next_to = (end[:-1] == start[1:]) & (owner[:-1] == owner[1:])
            kin = next_to & (home[:-1] == home[1:])
            firm = (end - start >= FIRM) | (start == 0) | last
            firm[:-1] |= kin
            firm[1:] |= kin
            run = np.concatenate([[0], np.cumsum(~next_to)])
            # Each run from its first firm chunk to its last.
            at = np.flatnonzero(firm)
            _, first = np.unique(run[at], return_index=True)
            a, b = at[first], at[np.append(first[1:], len(at)) - 1] if len(at) else at
            long = end[b] - start[a] >= shortest
            a, b = a[long], b[long]
            homes = [np.unique(home[i : j + 1]) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
            rows = pa.array(owner[a])
            columns = [batch.column("doc").take(rows), batch.column("h").take(rows), pa.array(start[a], pa.int32()), pa.array(end[b], pa.int32()), pa.array([x[x < NAMELESS] for x in homes], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "h", "start", "end", "first_docs"])

    return join


def _identity(docs: DataFrame, key: str, text: str) -> dict[str, Column]:
    """``doc`` and ``h`` of each row: its id (of one that is no integer the XXH64) and its text's XXH64."""
    id_, number = F.col(f"`{key}`"), isinstance(docs.schema[key].dataType, IntegralType)
    return {"doc": id_.cast("long") if number else F.when(id_.isNotNull(), F.xxhash64(id_)), "h": F.xxhash64(F.col(f"`{text}`").cast("string"))}


def chunks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, h, place, d1, d2): every chunk of every whole text.

    ``doc`` and ``h`` tell the row; place is where the chunk begins and, in its low
    half, ends, with bit 31 set in a text's last. Null and empty texts and empty
    tables have none; a repeated row gives its chunks again; other columns aren't
    looked at.
    """
    small_batches(docs.sparkSession)
    at = _identity(docs, key, text)
    rows = docs.select(at["doc"].alias("doc"), F.col(f"`{text}`").cast("string").alias("text"), at["h"].alias("h"))
    return rows.mapInArrow(_chunks, "doc long, h long, place long, d1 long, d2 int")


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = SPAN) -> DataFrame:
    """(doc, h, start, end, first_docs): spans of bytes that stand in an earlier document already.

    Documents come in the order of their ids, ids that are no integers in that of
    their XXH64, which then stands for them; those without an id come last, in an
    order that their texts give. first_docs lists the earlier documents that have an
    id. ``h`` is the text's XXH64: spans are those of one text, not of one id. Rows
    that agree in id and text are one document, and those that share an id alone
    are none the earlier: neither repeats the other. Empty and null texts have no
    chunks. An empty table gives an empty result; other columns aren't looked at.
    """
    turn = F.coalesce("doc", F.shiftrightunsigned("h", 2).bitwiseOR(F.lit(NAMELESS)))
    every = chunks(docs, key, text)
    # Kept apart, the join deals both sides anew and can split a chunk that very many documents have.
    homes = cut(every.groupBy("d1", "d2").agg(F.min(turn).alias("home"), F.max(turn).alias("last")).where("home < last").drop("last"))
    repeats = every.join(homes.hint("shuffle_hash"), ["d1", "d2"]).where(turn > F.col("home"))
    item = F.struct("place", "home")
    by_doc = repeats.groupBy("doc", "h").agg(F.array_sort(F.collect_set(item)).alias("c"))
    return by_doc.mapInArrow(_joined(shortest), "doc long, h long, start int, end int, first_docs array<long>")


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, gone in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist(), strict=True):
            if gone:
                data, kept, at = text.encode(), [], 0
                for x in gone:
                    kept.append(data[at : x["start"]])
                    at = x["end"]
                text = b"".join([*kept, data[at:]]).decode()
            out.append(text)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), batch.column("row")], names=["text", "row"])


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = SPAN) -> DataFrame:
    """``docs`` with the spans of ``spans()`` cut out of their texts.

    Texts that lose all become empty; null texts stay null and repeated rows stay,
    each cut alike. Rows that share an id, or have none, are cut each by the spans of
    its own text. All other columns stay as they are, whatever their names.
    """
    found = spans(docs, key, text, shortest).groupBy("doc", "h").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("gone"))
    rest = docs.drop(text)
    own = docs.select(*[c.alias(k) for k, c in _identity(docs, key, text).items()], F.col(f"`{text}`").cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in rest.columns]).alias("row"))
    met = own.alias("a").join(found.alias("b"), F.col("a.doc").eqNullSafe(F.col("b.doc")) & (F.col("a.h") == F.col("b.h")), "left").select("text", "gone", "row")
    small_batches(docs.sparkSession)
    return unboxed(met.mapInArrow(_cleaned, met.select("text", "row").schema), docs, **{text: F.col("text")})


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("doc").alias("doc_id"), F.col("start").alias("span_start"), F.col("end").alias("span_end"), (F.col("end") - F.col("start")).alias("n_bytes"), "first_docs")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without their repeated passages, n_chars made to fit; those that lose all their words, or had none, go.

    Odd rows are those of ``deduplicated``; columns beyond those of ``documents``
    come through unchanged. An empty table gives an empty result.
    """
    left = deduplicated(docs).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return left.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])
