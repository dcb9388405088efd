"""Media columns: payloads kept as PNG in binary columns, read back and hashed.

A payload becomes an RGB picture of 8-bit samples, WIDTH pixels wide. The reader
checks the signature, every chunk's checksum and the sizes, inflates the IDAT
chunks and undoes the row filters with numpy. Each row is stored under the filter
that leaves the least sum of absolute differences, of FILTERS by default: those whose
undoing is a running sum over whole rows or columns. AVERAGE and PAETH are undone by
anti-diagonals, all pixels of one at once. The feature is a hash of the picture's
low-frequency cosine transform.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, without

WIDTH = 64
ROW = 3 * WIDTH
#: Samples of the reduced picture's side, and of the corner of its transform that is hashed.
SIDE, CORNER = 32, 8
_IDAT = 1 << 20
# Fixed values of the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
NONE, SUB, UP, AVERAGE, PAETH = range(5)
#: Filters that rows are stored under.
FILTERS = (NONE, SUB, UP)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def _paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    a, b, c = (x.astype(np.int16) for x in (a, b, c))
    pa_, pb, pc = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
    return np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c)).astype(np.uint8)


def filtered(rows: np.ndarray, kind: int) -> np.ndarray:
    """Picture rows (uint8, ROW samples each) under one of the five filters."""
    left, up, corner = (np.zeros_like(rows) for _ in range(3))
    left[:, 3:], up[1:], corner[1:, 3:] = rows[:, :-3], rows[:-1], rows[:-1, :-3]
    guess = [np.zeros_like(rows), left, up, ((left.astype(np.uint16) + up) // 2).astype(np.uint8), None][kind]
    return rows - (_paeth(left, up, corner) if guess is None else guess)


def best_filters(rows: np.ndarray, kinds: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """For each row the filter of ``kinds`` whose bytes, taken as signed, have the least sum of magnitudes; and the rows under these."""
    made = np.stack([filtered(rows, k) for k in kinds])
    chosen = np.abs(made.view(np.int8).astype(np.int16)).sum(2).argmin(0)
    return np.array(kinds, np.uint8)[chosen], made[chosen, np.arange(len(rows))]


def _summed(kinds: np.ndarray, rows: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Undoes NONE, SUB and UP in all rows at once, by running sums modulo 256."""
    out, n = rows.copy(), len(rows)
    sub = kinds == SUB
    out[sub] = np.cumsum(rows[sub].reshape(-1, rows.shape[1] // 3, 3), axis=1, dtype=np.uint8).reshape(-1, rows.shape[1])
    if (kinds == UP).any():
        # Sums down from the last row that isn't UP; the row above stands in for one.
        down = np.cumsum(np.concatenate([above[None], out]), axis=0, dtype=np.uint8)
        since = np.maximum.accumulate(np.where(kinds == UP, 0, np.arange(1, n + 1)))
        out = down[1:] - np.where(since[:, None] > 0, down[since - 1], 0)
    return out


def _by_diagonals(kinds: np.ndarray, rows: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Undoes AVERAGE and PAETH: a pixel needs those to its left and above, so an anti-diagonal's depend on earlier ones only."""
    n, width = len(rows), rows.shape[1] // 3
    out = np.zeros((n + 1, width + 1, 3), np.uint8)
    out[0, 1:], raw = above.reshape(width, 3), rows.reshape(n, width, 3)
    for t in range(n + width - 1):
        y = np.arange(max(0, t - width + 1), min(n, t + 1))
        x = t - y
        left, up, corner = out[y + 1, x], out[y, x + 1], out[y, x]
        mean = ((left.astype(np.uint16) + up) // 2).astype(np.uint8)
        out[y + 1, x + 1] = raw[y, x] + np.where((kinds[y] == AVERAGE)[:, None], mean, _paeth(left, up, corner))
    return out[1:, 1:].reshape(n, -1)


def unfiltered(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Undoes the filters: all rows at once, or in runs where some need their neighbours on both sides."""
    if not len(kinds) or kinds.max() > PAETH:
        raise ValueError("PNG: unknown row filter")
    crossed = kinds >= AVERAGE
    out, above = [], np.zeros(rows.shape[1], np.uint8)
    edges = [0, *(np.flatnonzero(np.diff(crossed)) + 1).tolist(), len(kinds)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        out.append((_by_diagonals if crossed[a] else _summed)(kinds[a:b], rows[a:b], above))
        above = out[-1][-1]
    return out[0] if len(out) == 1 else np.concatenate(out)


def encode(payload: bytes, kinds: tuple[int, ...] = FILTERS, level: int = 6) -> bytes:
    """A payload of a positive multiple of ROW bytes as a PNG file, each row under the best filter of ``kinds``."""
    height, rest = divmod(len(payload), ROW)
    if not height or rest:
        raise ValueError(f"a payload has a positive multiple of {ROW} bytes")
    out = [SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, height, 8, 2, 0, 0, 0))]
    chosen, rows = best_filters(np.frombuffer(payload, np.uint8).reshape(height, ROW), kinds)
    packed = zlib.compress(np.concatenate([chosen[:, None], rows], axis=1).tobytes(), level)
    out += [_chunk(b"IDAT", packed[i : i + _IDAT]) for i in range(0, len(packed), _IDAT)]
    return b"".join([*out, _chunk(b"IEND", b"")])


def decode(media: bytes) -> np.ndarray:
    """The samples (height, ROW) of a PNG file of the form that ``encode`` writes."""
    if media[:8] != SIGNATURE:
        raise ValueError("PNG: no signature")
    at, size, parts, ended = 8, None, [], False
    while not ended:
        if at + 12 > len(media):
            raise ValueError("PNG: it ends early")
        n, kind = struct.unpack_from(">I4s", media, at)
        data = media[at + 8 : at + 8 + n]
        if len(data) < n or struct.unpack(">I", media[at + 8 + n : at + 12 + n].rjust(4, b"\0"))[0] != zlib.crc32(data, zlib.crc32(kind)):
            raise ValueError(f"PNG: checksum of {kind!r}")
        if kind == b"IHDR":
            if len(data) != 13:
                raise ValueError("PNG: its header isn't 13 bytes")
            size = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            parts.append(data)
        ended, at = kind == b"IEND", at + 12 + n
    if size is None or size[0] != WIDTH or size[2:] != (8, 2, 0, 0, 0):
        raise ValueError("PNG: not 8-bit RGB of the stored width")
    try:
        lines = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8)
    except zlib.error as e:
        raise ValueError(f"PNG: {e}") from e
    if not size[1] or len(lines) != size[1] * (ROW + 1):
        raise ValueError("PNG: wrong number of samples")
    lines = lines.reshape(size[1], ROW + 1)
    return unfiltered(lines[:, 0], lines[:, 1:])


def _cosines() -> np.ndarray:
    k, n = np.arange(CORNER)[:, None], np.arange(SIDE)[None, :]
    return np.cos(np.pi * k * (2 * n + 1) / (2 * SIDE))


def cosine_hash(samples: np.ndarray, cosines: np.ndarray) -> bytes:
    """64 bits: which low-frequency coefficients of the reduced picture exceed their median."""
    height = len(samples)
    gray = samples.reshape(height, SIDE, -1).sum(2, dtype=np.int64)
    if height >= SIDE:
        edges = np.arange(SIDE + 1) * height // SIDE
        small = np.add.reduceat(gray, edges[:-1], axis=0) / np.diff(edges)[:, None]
    else:
        small = gray[np.arange(SIDE) * height // SIDE].astype(float)
    low = np.round(cosines @ small @ cosines.T, 3).reshape(-1)
    return np.packbits(low > np.median(low[1:])).tobytes()


def stored(docs: DataFrame, text: str = "text", media: str = "media", kinds: tuple[int, ...] = FILTERS) -> DataFrame:
    """``docs`` with ``n_bytes`` and the PNG column ``media`` in place of the text.

    The payload is the whole text's UTF-8 (null: none), padded with bytes 32 to a
    positive multiple of ROW. Repeated rows stay, and an empty table gives an empty
    result. Columns of the two names are replaced; one named _text goes.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 100):
                part = batch.slice(a, 100)
                texts = [(x or "").encode() for x in part.column("_text").to_pylist()]
                files = [encode(x.ljust(max(1, -(-len(x) // ROW)) * ROW, b" "), kinds) for x in texts]
                yield part.drop_columns(["_text"]).append_column("n_bytes", pa.array(list(map(len, texts)), pa.int64())).append_column(media, pa.array(files, pa.binary()))

    small_batches(docs.sparkSession)
    rows = without(docs, "n_bytes", media, "_text")
    rest = rows.drop(text)
    schema = rest.withColumns({"n_bytes": F.lit(0).cast("long"), media: F.lit(b"")}).schema
    return rows.withColumnRenamed(text, "_text").withColumn("_text", F.col("_text").cast("string")).mapInArrow(packed, schema)


def described(rows: DataFrame, media: str = "media") -> DataFrame:
    """``rows`` with what the PNG column holds, read from its bytes, in its place.

    payload_bytes, payload_sha256, tail_crc32 (of the last 16 bytes), media_bytes,
    media_sha256 and ``feature``, 8 bytes; all null where there is no file. A damaged
    file raises ValueError. Repeated rows stay, columns of these names are replaced,
    and an empty table gives an empty result.
    """
    added = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature binary"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cosines = _cosines()
        for batch in batches:
            for a in range(0, batch.num_rows, 100):
                part, out = batch.slice(a, 100), []
                for file in part.column(media).to_pylist():
                    if file is None:
                        out.append((None,) * 6)
                        continue
                    samples = decode(file)
                    payload = samples.tobytes()
                    out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(file), hashlib.sha256(file).hexdigest(), cosine_hash(samples, cosines)))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                part = part.drop_columns([media])
                for field, kind, values in zip(added.split(", "), kinds, zip(*out, strict=True), strict=True):
                    part = part.append_column(field.split()[0], pa.array(values, kind))
                yield part

    names = [x.split()[0] for x in added.split(", ")]
    rows = without(rows, *names)
    order = [c for c in rows.columns if c != media]
    schema = rows.select(*order).withColumns({x.split()[0]: F.lit(None).cast(x.split()[1]) for x in added.split(", ")}).schema
    return rows.mapInArrow(read, schema)


def hexed(column: str) -> Column:
    return F.lower(F.hex(column))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return described(stored(docs)).withColumn("feature", hexed("feature"))
