"""Periodic runs against a search of all stretches."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

from pyspark.sql import functions as F

from quaestor.llm import op12_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EMPTY = hashlib.sha256(b"").hexdigest()


def brute(words):
    """Every run: each stretch's smallest period by trying all, kept where neither neighbour keeps it."""
    runs, n = [], len(words)
    for q in range(1, n // 4 + 1):
        a = 0
        while a + q < n:
            b = a
            while b + q < n and words[b] == words[b + q]:
                b += 1
            if b > a and b - a + q >= max(6, 4 * q):
                part = words[a : b + q]
                if not any(all(part[i] == part[i + d] for i in range(len(part) - d)) for d in range(1, q)):
                    runs.append((a, b - a + q, q))
            a = b + 1
    return sorted(runs, key=lambda r: (r[0], r[2]))


def expected(doc_id, text, plant=True):
    words = WORD.findall(text or "")
    n = len(words)
    if plant and doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    top = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    gone = {i for a, m, q in runs for i in range(a + q, a + m)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    lines = "".join(f"{a},{m},{q}\n" for a, m, q in runs)
    first = (None,) * 4 if top is None else (*top, 1000 * top[1] // top[2])
    return (doc_id, len(runs), *first, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def texts(seed=5, many=160):
    rng = random.Random(seed)
    out = []
    for _ in range(many):
        words = []
        for _ in range(rng.randint(0, 6)):
            unit = [rng.choice("abc") * rng.randint(1, 2) for _ in range(rng.randint(1, 5))]
            words += (unit * 7)[: rng.randint(1, 6 * len(unit))]
            words += [rng.choice("abcdefgh") for _ in range(rng.randint(0, 5))]
        out.append(rng.choice([" ", "\n", " \t"]).join(words))
    return out


def made():
    rows = list(enumerate(texts()))
    long = "x y " * 1500
    odd = [(1000, None), (1001, ""), (1002, " \n "), (None, "a " * 9), (None, None), (7, "a " * 9), (7, "a " * 9), (1003, long), (1004, "é  é  é  é  é  é "), (1005, "a b " * 8)]
    return [*rows, *odd]


def key(row):
    return tuple(map(str, row))


def test_runs_by_brute_force(spark):
    docs = spark.createDataFrame(made(), "doc_id long, text string").withColumn("runs", F.lit("mine"))
    plant = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    want = sorted((expected(k, t) for k, t in made()), key=key)
    whole = op12_runs.periodic_runs(docs, plant=plant).drop("n_words", "n_dropped", "runs").collect()
    assert sorted(map(tuple, whole), key=key) == want
    assert sum(r.n_runs > 0 for r in whole) > 60
    ranged = op12_runs.periodic_runs(docs, plant=plant, work=16, parts=5).drop("n_words", "n_dropped", "runs").collect()
    assert sorted(map(tuple, ranged), key=key) == want


def test_runs_of_odd_tables(spark, odd, tmp_path):
    got = op12_runs.periodic_runs(odd).collect()
    assert len(got) == 9 and sum(r.collapsed_sha256 == EMPTY for r in got) == 4
    assert all(r.runs_sha256 == EMPTY and r.start is None for r in got if r.n_runs == 0)
    long = next(r for r in got if r.doc_id == 4)
    assert (long.n_words, long.start, long.length, long.period) == (30000, 0, 30000, 977)
    assert op12_runs.periodic_runs(odd.limit(0)).collect() == []


def test_long_texts_in_ranges(spark):
    rng = random.Random(9)
    unit = [str(rng.random()) for _ in range(3000)]
    text = " ".join(unit + ["z"] * 70000 + unit * 5)
    (r,) = op12_runs.periodic_runs(spark.createDataFrame([(3, text)], "doc_id long, text string")).collect()
    assert [(x.start, x.length, x.period) for x in r.runs] == [(3000, 70000, 1), (73000, 15000, 3000)]
    assert r.n_dropped == 69999 + 12000
