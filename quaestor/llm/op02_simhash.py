"""SimHash near-duplicates by multi-index hashing.

A text's 64-bit fingerprint takes each bit's majority over the XXH64 values of its
3-word shingles. Two fingerprints within 3 bits agree, in one of their two 32-bit
segments, in all bits but one at most: each fingerprint looks up the table of
segments at its own segment and at those with one bit more, and the matches are
verified over all 64 bits. Where a segment is shared by many fingerprints, pairs
aren't formed: there, the other segment's small Hamming balls meet in the middle
and every meeting point gives a star of links.

The pipeline's stage links more than the query does: also texts whose sets of 5-word
shingles have a Jaccard similarity of 0.8 or more. MinHash bands find the pairs and
the sets themselves confirm them. At 0.8 a pair shares a band with probability
0.9993, at 0.9 in all but 10^-8 of cases.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import boxed, components, cut, small_batches, texts_of, unboxed

SHINGLE = 3
RADIUS = 3
#: Fingerprints in a bucket above which pairs are no longer formed: from about there, the meeting points cost less.
DENSE = 1024
#: Pairs of one text whose sets of shingles are compared in one part.
SHARE = 500
_BLOCK = 1 << 17
#: The stage's shingles, and the similarity (in fifths) from which it links texts.
WIDE, FIFTHS = 5, 4
BANDS, ROWS = 24, 6
#: Longs of a set's parities.
LONGS = 8

# Fixed values of XXH64.
P1, P2, P3, P4, P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261


def _rotated(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def xxh64(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of many slices of a byte array that has 8 spare bytes at its end."""
    m, u = (1 << 64) - 1, np.uint64
    p1, p2, p3, p4, p5 = map(u, (P1, P2, P3, P4, P5))
    wide = np.lib.stride_tricks.as_strided(data[:8].view(u), (len(data) - 7,), (1,))
    half = np.lib.stride_tricks.as_strided(data[:4].view(np.uint32), (len(data) - 3,), (1,))
    order = np.argsort(lengths.astype(np.uint16) if len(lengths) and lengths.max() < 65536 else lengths, kind="stable")
    lengths, starts, out = lengths[order], starts[order], np.empty(len(starts), u)
    edges = [0, *(np.flatnonzero(np.diff(lengths)) + 1).tolist(), len(lengths)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if a == b:
            continue
        size, at, k = int(lengths[a]), starts[a:b], 0
        if size >= 32:
            lanes = [np.full(b - a, x & m, u) for x in (seed + P1 + P2, seed + P2, seed, seed - P1)]
            while k + 32 <= size:
                lanes = [_rotated(x + wide[at + (k + 8 * j)] * p2, 31) * p1 for j, x in enumerate(lanes)]
                k += 32
            h = _rotated(lanes[0], 1) + _rotated(lanes[1], 7) + _rotated(lanes[2], 12) + _rotated(lanes[3], 18)
            for x in lanes:
                h = (h ^ (_rotated(x * p2, 31) * p1)) * p1 + p4
        else:
            h = np.full(b - a, (seed + P5) & m, u)
        h = h + u(size)
        while k + 8 <= size:
            h = _rotated(h ^ (_rotated(wide[at + k] * p2, 31) * p1), 27) * p1 + p4
            k += 8
        if k + 4 <= size:
            h = _rotated(h ^ (half[at + k].astype(u) * p1), 23) * p2 + p3
            k += 4
        while k < size:
            h = _rotated(h ^ (data[at + k].astype(u) * p5), 11) * p1
            k += 1
        h = (h ^ (h >> u(33))) * p2
        h = (h ^ (h >> u(29))) * p3
        out[a:b] = h ^ (h >> u(32))
    whole = np.empty_like(out)
    whole[order] = out
    return whole


def _lowered() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[9:14] = 32
    return table


def _worded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts in lower case with single blanks and 8 spare bytes; where their words start and end; each text's first word."""
    low = _lowered()[data]
    blank = low == 32
    keep = np.ones(len(low), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    at = np.concatenate([[0], np.cumsum(keep)])[offsets]
    low, blank = low[keep], blank[keep]
    n = len(low)
    first = np.zeros(n + 1, bool)
    first[at] = True
    solid = ~blank
    starts = np.flatnonzero(solid & (first[:n] | np.concatenate([[True], blank[:-1]])[:n]))
    ends = np.flatnonzero(solid & (first[1:] | np.concatenate([blank[1:], [True]])[:n])) + 1
    low = np.concatenate([low, np.zeros(8, np.uint8)])
    return low, starts, ends, np.searchsorted(starts, at)


def fingerprints(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The fingerprints (uint64) of texts that lie one after another in ``data``."""
    low, starts, ends, begin = _worded(data, offsets)
    words = np.diff(begin)
    shingles = np.where(words > 0, np.maximum(words - (SHINGLE - 1), 1), 0)
    edge = np.concatenate([[0], np.cumsum(shingles)])
    out = np.zeros((len(words), 64), np.int64)
    for a in range(0, int(edge[-1]), _BLOCK):
        ids = np.arange(a, min(a + _BLOCK, int(edge[-1])))
        doc = np.searchsorted(edge, ids, side="right") - 1
        word = begin[doc] + ids - edge[doc]
        last = np.minimum(word + SHINGLE, begin[doc + 1]) - 1
        bits = np.unpackbits(xxh64(low, starts[word], ends[last] - starts[word]).view(np.uint8).reshape(-1, 8), axis=1)
        for d in range(int(doc[0]), int(doc[-1]) + 1):
            own = bits[max(int(edge[d]) - a, 0) : max(int(edge[d + 1]) - a, 0)]
            many = len(own) // 255 * 255
            out[d] += own[:many].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64) + own[many:].sum(0, dtype=np.uint8)
    return np.packbits(out * 2 > shingles[:, None], axis=1).reshape(-1).view(np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Each text's distinct WIDE-word shingles as sorted hashes; a text of fewer words is one shingle, one without words has none."""
    low, starts, ends, begin = _worded(data, offsets)
    words = np.diff(begin)
    edge = np.concatenate([[0], np.cumsum(np.where(words > 0, np.maximum(words - (WIDE - 1), 1), 0))])
    hashes = np.empty(int(edge[-1]), np.uint64)
    for a in range(0, len(hashes), _BLOCK):
        ids = np.arange(a, min(a + _BLOCK, len(hashes)))
        doc = np.searchsorted(edge, ids, side="right") - 1
        word = begin[doc] + ids - edge[doc]
        last = np.minimum(word + WIDE, begin[doc + 1]) - 1
        hashes[ids] = xxh64(low, starts[word], ends[last] - starts[word])
    at = edge.tolist()
    return [np.unique(hashes[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def bands(shingles: np.ndarray) -> np.ndarray:
    """The BANDS keys (int64) of a set of shingles; none for an empty set."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    odd = np.random.default_rng(2).integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for a in range(0, len(shingles), 1024):
        least = np.minimum(least, (shingles[a : a + 1024, None] * odd[0]).min(0))
    key = (least ^ (least >> np.uint64(29))) * odd[1]
    key = (key ^ (key >> np.uint64(32))).reshape(BANDS, ROWS).sum(1, dtype=np.uint64)
    return ((key ^ (key >> np.uint64(31))) * np.uint64(P2)).view(np.int64)


def parities(shingles: np.ndarray) -> np.ndarray:
    """64 * LONGS bits (int64): whether an odd number of the set's shingles fall to each. Two sets differ in as many shingles as their bits do, or in more."""
    odd = np.bincount((shingles % np.uint64(64 * LONGS)).astype(np.int64), minlength=64 * LONGS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, h) with ``fp``, the number of shingles, the bands and the parities in place of the text."""
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            part = batch.slice(a, 256)
            texts = texts_of(part.column(1))
            sets = shingle_sets(*texts)
            columns = [pa.array(fingerprints(*texts).view(np.int64)), part.column(2), pa.array([len(x) for x in sets], pa.int64()), *(pa.array([f(x) for x in sets], pa.list_(pa.int64())) for f in (bands, parities))]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["doc_id", "fp", "h", "n", "bands", "odd"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, text) with the set of shingles in place of the text."""
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            part = batch.slice(a, 256)
            sets = [x.view(np.int64) for x in shingle_sets(*texts_of(part.column(1)))]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["h", "s"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, ...) with ``fp`` in place of the text."""
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            part = batch.slice(a, 256)
            fp = fingerprints(*texts_of(part.column(1))).view(np.int64)
            rest = part.schema.names[2:]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp), *map(part.column, rest)], names=["doc_id", "fp", *rest])


def fingerprinted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): the whole texts' fingerprints as signed longs; no word gives 0."""
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(_hashed, f"doc_id {kind}, fp long")


def _ball(x: Column, radius: int, upward: bool = False) -> Column:
    """An array of all 32-bit values within ``radius`` (0 to 2) of ``x``; upward: only those that set bits."""
    masks = [0]
    if radius > 0:
        masks += [1 << i for i in range(32)]
    if radius > 1:
        masks += [(1 << i) | (1 << j) for i in range(32) for j in range(i)]
    table = F.lit(np.array(masks, np.int64).tolist())
    kept = F.filter(table, lambda m: x.bitwiseAND(m) == 0) if upward else table
    return F.transform(kept, lambda m: x.bitwiseXOR(m))


def links(prints: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints ``fp`` whose components are those of all pairs within RADIUS bits."""
    lo = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    hi = F.shiftrightunsigned("fp", 32)
    halves = F.array(F.struct(F.lit(0).alias("seg"), hi.alias("key"), lo.alias("rest")), F.struct(F.lit(1).alias("seg"), lo.alias("key"), hi.alias("rest")))
    table = cut(prints.select("fp", F.explode(halves).alias("s")).select("fp", "s.*"))
    dense = cut(table.groupBy("seg", "key").count().where(F.col("count") > DENSE).select("seg", "key", F.lit(True).alias("dense")))
    probes = table.select("fp", "seg", "rest", F.col("key").alias("own"), F.explode(_ball(F.col("key"), 1, upward=True)).alias("key"))
    if dense.isEmpty():
        sparse, full = (probes, table), None
    else:
        marked = [x.join(dense, ["seg", "key"], "left") for x in (probes, table)]
        sparse = tuple(x.where("dense is null") for x in marked)
        full = tuple(x.where("dense") for x in marked)
    a, b = sparse[0].alias("a"), sparse[1].alias("b")
    near = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= RADIUS
    own = (F.col("a.own") != F.col("a.key")) | (F.col("a.fp") < F.col("b.fp"))
    out = a.join(b, (F.col("a.seg") == F.col("b.seg")) & (F.col("a.key") == F.col("b.key")) & near & own).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
    if full:
        # x reaches the bucket with 0 or 1 bits; 2 or 1 are left for it, 1 for y: those that meet are within 3.
        x = full[0].withColumn("at", F.explode(F.when(F.col("own") == F.col("key"), _ball(F.col("rest"), 2)).otherwise(_ball(F.col("rest"), 1)))).select("seg", "key", "at", "fp", F.lit(None).cast("long").alias("hub"))
        y = full[1].withColumn("at", F.explode(_ball(F.col("rest"), 1))).select("seg", "key", "at", F.lit(None).cast("long").alias("fp"), F.col("fp").alias("hub"))
        met = x.unionByName(y).groupBy("seg", "key", "at")
        stars = met.agg(F.min("hub").alias("b"), F.collect_set("fp").alias("a")).where("b is not null and size(a) > 1").select(F.explode("a").alias("a"), "b").where("a != b")
        out = out.unionByName(stars.distinct())
    return out


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs``.

    component_id is the smallest key among the rows that links connect, the row's
    own included. Texts without words, empty or null, have fingerprint 0, which
    links like any other. Rows with a null key belong to components but name none
    unless all keys are null (component_id null). Repeated rows stay. An empty
    table gives an empty result; other columns aren't looked at.
    """
    prints = cut(fingerprinted(docs, key, text))
    return prints.join(_named(prints), "fp").select("doc_id", "fp", "component_id")


def _named(prints: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """(fp, root, component_id) of each fingerprint, by ``edges`` or else by links()."""
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(classes.select("fp")) if edges is None else edges)
    grouped = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    return grouped.join(named, "root").select("fp", "root", "component_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _alike(docs: DataFrame, sketches: DataFrame, pairs: DataFrame) -> DataFrame:
    """The links (a, b) of those ``pairs`` (ha, hb, a, b) whose texts, told by hash, are similar enough.

    Each text is fetched from its first document: rows are dealt by id and hash, so
    those of a text with very many copies don't meet in a task.
    """
    pairs = cut(pairs.distinct())
    firsts = sketches.groupBy("h").agg(F.min("doc_id").alias("first"))
    wanted = pairs.select(F.explode(F.array("ha", "hb")).alias("th")).distinct().join(firsts.toDF("th", "first"), "th")
    rows = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"), F.col("text").cast("string").alias("text"))
    held = rows.join(wanted, F.col("id").eqNullSafe(F.col("first")) & (F.col("h") == F.col("th"))).select("h", "text").dropDuplicates(["h"])
    sets = cut(held.mapInArrow(_sets, "h long, s array<long>"))
    # A text with very many partners goes to them, in parts of SHARE pairs; theirs don't all come to it.
    parts = pairs.groupBy("hb").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("parts"))
    spread = sets.toDF("hb", "sb").join(parts, "hb").select("hb", "sb", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    dealt = pairs.join(parts, "hb").select("ha", "hb", "a", "b", F.pmod(F.xxhash64("ha"), F.col("parts")).cast("int").alias("part"))
    both = dealt.join(spread, ["hb", "part"]).join(sets.toDF("ha", "sa"), "ha")
    shared = F.size(F.array_intersect("sa", "sb"))
    # i / (n - i) >= FIFTHS / 5, n being both sets' sizes.
    return cut(both.where((5 + FIFTHS) * shared >= FIFTHS * (F.size("sa") + F.size("sb"))).select("a", "b").distinct())


def similar(docs: DataFrame, sketches: DataFrame, near: DataFrame) -> DataFrame:
    """(a, b): ``near``, links between fingerprints, and those of similar texts that they don't connect already.

    ``sketches`` holds doc_id, fp, h, n, bands and odd of each row's text. In each band's bucket of texts
    all are first compared with the most central of them, the text whose own buckets
    hold most: of a group of near copies that is one with few changes, to which
    nearly all others are similar. What that leaves unconnected is matched in pairs
    whose parities allow for the similarity, which those of all similar texts do: sets
    that differ in more than a ninth of both sizes aren't similar, and parities never
    differ in more bits than the sets do in shingles. Only such pairs leave the join,
    and no bucket is cut short.
    """
    roots = components(near)
    texts = sketches.groupBy("h").agg(F.min("fp").alias("fp"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    rooted = texts.join(roots.toDF("fp", "root"), "fp", "left").select("h", "n", F.coalesce("root", "fp").alias("root"), F.explode("bands").alias("at"))
    rooted = cut(rooted)
    mixed = rooted.groupBy("at").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count("*").alias("size")).where("least != most").select("at", "size")
    inside = cut(rooted.join(mixed, "at"))
    placed = inside.join(inside.groupBy("h").agg(F.sum("size").alias("reach")), "h")
    hubs = placed.groupBy("at").agg(F.max(F.struct("reach", "h", "root", "n")).alias("hub"))
    members = cut(inside.drop("size").join(hubs, "at"))
    sized = lambda x, y: 5 * F.least(x, y) >= FIFTHS * F.greatest(x, y)
    first = members.where((F.col("root") != F.col("hub.root")) & sized(F.col("n"), F.col("hub.n")))
    # Combined before the shuffle: a text's very many copies give one row a partition.
    marks = cut(sketches.groupBy("h").agg(F.first("odd").alias("odd")))
    first = cut(first.select(F.col("h").alias("ha"), F.col("hub.h").alias("hb"), F.col("root").alias("a"), F.col("hub.root").alias("b"), "n", F.col("hub.n").alias("hn")).distinct())
    central = first.select("hb").distinct().join(marks.toDF("hb", "hub_odd"), "hb")
    # 9 * |x - y, y - x| <= |x| + |y| is a Jaccard similarity of FIFTHS / 5 or more.
    allowed = lambda a, b, n, m: (5 + FIFTHS) * sum((F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(LONGS)), F.lit(0)) <= (5 - FIFTHS) * (F.col(n) + F.col(m))
    could = first.join(marks.toDF("ha", "odd"), "ha").join(central, "hb").where(allowed("odd", "hub_odd", "n", "hn"))
    found = _alike(docs, sketches, could.select("ha", "hb", "a", "b"))
    joined = members.drop("hub").join(components(found).toDF("root", "top"), "root", "left").select("at", "h", "n", F.coalesce("top", "root").alias("root"))
    open_ = joined.groupBy("at").agg(F.min("root").alias("r"), F.max("root").alias("most")).where("r != most").select("at")
    left = joined.join(open_, "at")
    left = cut(left.join(marks, "h"))
    x, y = left.alias("x"), left.alias("y")
    pairs = x.join(y, (F.col("x.at") == F.col("y.at")) & (F.col("x.root") < F.col("y.root")) & sized(F.col("x.n"), F.col("y.n")) & allowed("x.odd", "y.odd", "x.n", "y.n"))
    rest = _alike(docs, sketches, pairs.select(F.col("x.h").alias("ha"), F.col("y.h").alias("hb"), F.col("x.root").alias("a"), F.col("y.root").alias("b")))
    return near.unionByName(found).unionByName(rest)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: that with the smallest doc_id (null last), of several the one with the smallest fingerprint and text hash.

    Components are those of fingerprints within RADIUS bits and of texts with
    similar sets of WIDE-word shingles. Texts without words, null ones too, have
    fingerprint 0 and no shingles. Of rows that agree in id and text one stays. All
    columns come through unchanged, whatever their names; an empty table gives an
    empty result.
    """
    hashed = F.xxhash64("text")
    small_batches(spark)
    kind = dict(docs.dtypes)["doc_id"]
    prints = cut(docs.select("doc_id", F.col("text").cast("string").alias("text"), hashed.alias("h")).mapInArrow(_sketched, f"doc_id {kind}, fp long, h long, n long, bands array<long>, odd array<long>"))
    near = cut(links(prints.select("fp").distinct()))
    named = _named(prints.select("doc_id", "fp"), similar(docs, prints.where("n > 0"), near))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", "h")
    first = prints.join(named, "fp").groupBy("root").agg(F.min(order).alias("_first"))
    kept = first.select(F.col("_first.doc_id").alias("id"), F.col("_first.h").alias("th"))
    rows = boxed(docs, doc_id=F.col("doc_id"), h=hashed)
    whole = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("th")))
    return unboxed(whole.dropDuplicates(["id", "th"]), docs)
