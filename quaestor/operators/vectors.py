"""Nearest vectors for a table of queries: exactly, or by a coarse index that covers every row.

Vectors are normalised once, so that a product of two is their cosine. The index is a
set of centres, fitted to a bounded sample; each row belongs to its nearest one, and a
query looks at the rows of the ``probes`` centres nearest to it. Products are made in
tiles of bounded size, and each task hands on a query's best rows alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Rows that centres are fitted to, about; centres at most; queries handled at once.
SAMPLE, CENTRES, BLOCK = 20_000, 256, 2_048
#: Products that a task makes at once.
TILE = 1_000_000


def _matrix(vectors: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors as rows, and which ones have a direction: a null, an empty and a zero vector have none, nor has one of another length than ``width``, the first one's by default."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    width = int(next(iter(sizes[sizes > 0]), 0)) if width is None else width
    good = (sizes == width) & (width > 0)
    out = np.zeros((len(vectors), width))
    if good.any():
        some = vectors.filter(pa.array(good)).flatten()
        whole = some.is_valid().to_numpy(zero_copy_only=False).reshape(-1, width).all(1)
        out[good] = some.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False).reshape(-1, width)
        good[good] = whole
    length = np.linalg.norm(out, axis=1)
    good &= np.isfinite(length) & (length > 0)
    out[good] /= length[good, None]
    out[~good] = 0.0
    return out, good


def _best(queries: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's number, id, similarity) of the ``k`` best points for each query, a tile of products at a time."""
    held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    step = max(k, TILE // max(1, len(queries)))
    for begin in range(0, len(points) if len(queries) else 0, step):
        near = np.round(queries @ points[begin : begin + step].T, 9)
        # Of equals at the k-th place all stay until the order by id.
        bound = np.maximum(least, np.partition(near, near.shape[1] - k, axis=1)[:, -k] if near.shape[1] > k else -np.inf)
        q, at = np.nonzero(near >= np.reshape(bound, (-1, 1)))
        q, i, s = (np.concatenate(x) for x in zip(held, (q, ids[begin + at], near[q, at]), strict=True))
        order = np.lexsort((i, -s, q))
        first = np.arange(len(q)) - np.searchsorted(q[order], q[order]) < k
        held = [x[order][first] for x in (q, i, s)]
    return tuple(held)


def centres(rows: DataFrame, key: str, vector: str, sample: int = SAMPLE, most: int = CENTRES, rounds: int = 8) -> np.ndarray:
    """Centres of unit vectors: as many as the square root of the sample, by rounds of nearest centre and mean."""
    n = max(1, rows.count())
    drawn = rows.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, sample / n)))).orderBy(F.xxhash64(key)).select(vector).limit(2 * sample).toArrow()
    points, good = _matrix(drawn.column(vector).combine_chunks() if drawn.num_rows else pa.array([], pa.list_(pa.float64())))
    points = points[good]
    found = points[:: max(1, len(points) // max(1, min(most, int(len(points) ** 0.5))))][:most].copy()
    for _ in range(rounds):
        nearest = (points @ found.T).argmax(1)
        for c in range(len(found)):
            mean = points[nearest == c].sum(0)
            if (size := np.linalg.norm(mean)) > 0:
                found[c] = mean / size
    return found


def nearest(asked: DataFrame, rows: DataFrame, k: int, least: float = -1.0, index: np.ndarray | None = None, probes: int = 8, block: int = BLOCK) -> DataFrame:
    """(asked_id, id, similarity, rank): the ``k`` rows (id, vector) of greatest cosine, from ``least`` on, for each of ``asked`` (id, vector).

    Exact without an ``index``; with one (from ``centres``) only rows of a query's
    ``probes`` nearest centres are looked at. Similarities are rounded to nine digits,
    smaller ids come first among equals. Vectors without a direction, nulls among
    them, have no neighbours; vectors of different lengths are none. Queries pass in blocks of
    ``block``; ids are longs.
    """
    spark = rows.sparkSession
    out = None

    def answered(ids: list[int], vectors: list[list[float]]) -> DataFrame:
        wanted, good = _matrix(pa.array(vectors, pa.list_(pa.float64())))
        looked = None
        # Vectors of another length than the index's are few, and looked at in full.
        if index is not None and len(index) and index.shape[1] == wanted.shape[1]:
            order = np.argsort(-(wanted @ index.T), axis=1)[:, :probes]
            looked = np.zeros((len(wanted), len(index)), bool)
            np.put_along_axis(looked, order, True, axis=1)
        shared = spark.sparkContext.broadcast((np.array(ids), wanted, good, looked, index))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, queries, known, probed, middle = shared.value
            for batch in batches:
                points, has = _matrix(batch.column("vector"), queries.shape[1])
                own = batch.column("id").to_numpy(zero_copy_only=False)
                groups = [(np.flatnonzero(has), np.flatnonzero(known))]
                if probed is not None:
                    home = (points @ middle.T).argmax(1)
                    groups = [(np.flatnonzero(has & (home == c)), np.flatnonzero(known & probed[:, c])) for c in np.unique(home[has])]
                parts = [[], [], []]
                for r, q in groups:
                    a, i, s = _best(queries[q], points[r], own[r], k, least)
                    for part, values in zip(parts, (q[a], i, s), strict=True):
                        part.append(values)
                q, i, s = (np.concatenate(p) if p else np.zeros(0) for p in parts)
                order = np.lexsort((i, -s, q))
                q, i, s = q[order].astype(np.int64), i[order], s[order]
                first = np.arange(len(q)) - np.searchsorted(q, q) < k
                yield pa.RecordBatch.from_arrays([pa.array(names[q[first]], pa.int64()), pa.array(i[first], pa.int64()), pa.array(s[first], pa.float64())], names=["asked_id", "id", "similarity"])

        found = rows.where("id is not null").select(F.col("id").cast("long").alias("id"), "vector").mapInArrow(search, "asked_id long, id long, similarity double")
        return found.withColumn("rank", F.row_number().over(W.partitionBy("asked_id").orderBy(F.desc("similarity"), "id"))).where(F.col("rank") <= k)

    held: dict[int, list] = {}

    def put(some: list) -> None:
        nonlocal out
        more = answered([x["id"] for x in some], [x["vector"] for x in some])
        out = more if out is None else out.unionByName(more)

    for r in asked.where("id is not null and size(vector) > 0").select("id", "vector").toLocalIterator():  # a block of one length at a time
        some = held.setdefault(len(r["vector"]), [])
        some.append(r)
        if len(some) == block:
            put(held.pop(len(r["vector"])))
    for some in held.values():
        put(some)
    return out if out is not None else spark.createDataFrame([], "asked_id long, id long, similarity double, rank int")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(wanted, met, recall): how many pairs of ``exact`` are in ``found``."""
    both = exact.select("asked_id", "id").join(found.select("asked_id", "id", F.lit(1).alias("_m")), ["asked_id", "id"], "left")
    return both.agg(F.count("*").alias("wanted"), F.count("_m").alias("met")).withColumn("recall", F.round(F.try_divide("met", "wanted"), 4))
