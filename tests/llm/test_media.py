import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaestor.llm import op03_media as M


@pytest.mark.parametrize("kinds", [(0,), (1,), (2,), (3,), (4,), (0, 1, 2), (0, 1, 2, 3, 4)])
@pytest.mark.parametrize("height", [1, 2, 33, 90])
def test_filters_round_trip(kinds, height):
    rng = random.Random(height)
    noise = bytes(rng.randrange(256) for _ in range(M.ROW * height))
    prose = b" ".join(rng.choice([b"budget", b"of", b"the", b"ward"]) for _ in range(M.ROW * height))[: M.ROW * height]
    for payload in (noise, prose, prose[: len(prose) // 2] + noise[: len(noise) - len(prose) // 2]):
        assert M.decode(M.encode(payload, kinds)).tobytes() == payload


def by_pixels(kinds, rows):
    """The PNG specification's reconstruction, a byte at a time."""
    out = np.zeros_like(rows)
    at = lambda y, x: int(out[y, x]) if y >= 0 and x >= 0 else 0
    for y in range(len(rows)):
        for x in range(rows.shape[1]):
            a, b, c = at(y, x - 3), at(y - 1, x), at(y - 1, x - 3)
            p = a + b - c
            near = min((abs(p - v), i, v) for i, v in enumerate((a, b, c)))[2]
            out[y, x] = (int(rows[y, x]) + [0, a, b, (a + b) // 2, near][kinds[y]]) % 256
    return out


def test_mixed_filters_by_brute_force():
    rng = np.random.default_rng(3)
    for n in (1, 7, 40):
        rows = rng.integers(0, 256, (n, M.ROW), dtype=np.uint8)
        for most in (3, 5):
            kinds = rng.integers(0, most, n).astype(np.uint8)
            assert (M.unfiltered(kinds, rows) == by_pixels(kinds, rows)).all()
    text = np.frombuffer((b"".join(b"row %d of some text, " % (i * i) for i in range(400)))[: M.ROW * 30], np.uint8).reshape(30, M.ROW)
    kinds, lines = M.best_filters(text, M.FILTERS)
    assert (M.unfiltered(kinds, lines) == text).all()
    size = lambda r: np.abs(r.view(np.int8).astype(int)).sum()
    assert all(size(lines[i]) == min(size(M.filtered(text, k)[i]) for k in M.FILTERS) for i in range(30))


def test_damage_is_found():
    file = bytearray(M.encode(b"a" * M.ROW))
    for at in (3, 17, 45, len(file) - 6):
        bad = bytearray(file)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            M.decode(bytes(bad))
    with pytest.raises(ValueError):
        M.decode(bytes(file[:-12]))
    end = M._chunk(b"IEND", b"")
    head = M._chunk(b"IHDR", struct.pack(">IIBBBBB", M.WIDTH, 1, 8, 2, 0, 0, 0))
    for body in (M._chunk(b"IHDR", b"short"), head + M._chunk(b"IDAT", b"no zlib"), head, head + M._chunk(b"IDAT", zlib.compress(b"\x09" + bytes(M.ROW)))):
        with pytest.raises(ValueError):
            M.decode(M.SIGNATURE + body + end)


def test_columns(spark, odd, documents):
    rows = M.described(M.stored(odd.withColumn("media", F.lit("clash")).withColumn("feature", F.lit(1)).withColumn("_text", F.lit(2)))).collect()
    assert len(rows) == 9
    texts = {(r.doc_id, r.n_chars): r.text for r in odd.collect()}
    for r in rows:
        data = (texts[r.doc_id, r.n_chars] or "").encode()
        payload = data + b" " * (-len(data) % 192 or (0 if data else 192))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-16:]) and len(r.feature) == 8
    same = [r for r in rows if r.doc_id == 1]
    assert same[0] == same[1]
    assert M.described(M.stored(documents([]))).count() == 0
    missing = M.described(M.stored(documents([(1, "a", "s")])).withColumn("media", F.lit(None).cast("binary"))).first()
    assert (missing.doc_id, missing.payload_sha256, missing.feature) == (1, None, None)


def test_hash_is_near_for_near_pictures():
    rng = random.Random(2)
    payload = bytearray(rng.randrange(256) for _ in range(M.ROW * 60))
    c = M._cosines()
    a = M.cosine_hash(M.decode(M.encode(bytes(payload))), c)
    payload[500] ^= 8
    b = M.cosine_hash(M.decode(M.encode(bytes(payload))), c)
    other = M.cosine_hash(M.decode(M.encode(bytes(rng.randrange(256) for _ in range(M.ROW * 60)))), c)
    far = lambda x, y: bin(int.from_bytes(x) ^ int.from_bytes(y)).count("1")
    assert far(a, b) <= 4 < far(a, other)
