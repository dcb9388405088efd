import zlib
from collections import defaultdict
from functools import cache
from math import exp, fsum, lgamma, log, log10, pi

import pytest
from pyspark.sql import functions as F

from quaestor.llm import op10_scoring as C

DEPTH = 2


def held(k):
    return k is not None and zlib.crc32(str(k).encode()) % 7 == 2


def low(text):
    return (text or "").encode().lower()


def model(rows):
    """The weighted tree, by recursion from the root."""
    counts, words = defaultdict(lambda: [0, 0]), defaultdict(int)
    for k, t in rows:
        if held(k):
            continue
        for w in [*low(t).split(), b""]:
            words[w] += 1
        for c, b in steps(t):
            for i in range(8):
                for d in range(DEPTH + 1):
                    counts[c[DEPTH - d :], 1 << i | b >> 8 - i][b >> 7 - i & 1] += 1
    estimate = lambda n: lgamma(n[0] + 0.5) + lgamma(n[1] + 0.5) - lgamma(sum(n) + 1) - 2 * lgamma(0.5)

    @cache
    def weighted(c, node):
        own = estimate(counts.get((c, node), [0, 0]))
        if len(c) == DEPTH:
            return own
        kids = sum(weighted(bytes([x]) + c, node) for x in range(256) if (bytes([x]) + c, node) in counts)
        m = max(own, kids)
        return m + log(exp(own - m) + exp(kids - m)) - log(2)

    def one(c, node, full):
        n = counts.get((c, node), [0, 0])
        own = (n[1] + 0.5) / (sum(n) + 1)
        if len(c) == DEPTH:
            return own
        w = exp(estimate(n) - log(2) - weighted(c, node))
        return w * own + (1 - w) * one(full[DEPTH - len(c) - 1 :], node, full)

    def score(t):
        out = 0.0
        for c, b in steps(t):
            for i in range(8):
                p = one(b"", 1 << i | b >> 8 - i, c)
                out += log10(p if b >> 7 - i & 1 else 1 - p)
        return out

    return words, score


def steps(t):
    y = b"\xff" * DEPTH + low(t) + b"\xff"
    return [(y[i - DEPTH : i], y[i]) for i in range(DEPTH, len(y))]


@pytest.mark.parametrize("shared", [1 << 21, 3])
@pytest.mark.parametrize("rare", [1 << 20, 3])
def test_by_brute_force(spark, monkeypatch, shared, rare):
    monkeypatch.setattr(C, "RARE", rare)
    rows = [(1, "Aab b"), (2, "ab ab\n"), (3, ""), (None, None), (4, "zz ab"), (4, "zz ab"), (7, "q é"), (31, "a\0b"), (33, "\0"), *[(i, "ab bb a" * (i % 3)) for i in range(8, 30)]]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, score string")
    got = sorted(map(tuple, C.scored(df, depth=DEPTH, held=shared).collect()), key=str)
    words, score = model(rows)
    n, v = sum(words.values()), len(words)
    want = []
    for k, t in rows:
        tokens = [*low(t).split(), b""]
        want.append((k, held(k), len(tokens), sum(w in words for w in tokens), n, sum(log10((words.get(w, 0) + 1) / (n + v + 1)) for w in tokens), score(t)))
    assert len(got) == len(want)
    for a, b in zip(got, sorted(want, key=str), strict=True):
        assert a[:5] == b[:5] and a[5:7] == pytest.approx(b[5:7], abs=1e-9)
        assert a.__getitem__(8) == pytest.approx(-a[6] * log(10) / log(2) / (a[7] + 1))


def test_estimates(spark):
    counts = [(a, b) for a in (0, 1, 2, 7, 8, 9, 100, 12345) for b in (0, 1, 5, 8, 64, 10**5)]
    terms = lambda n: [log((i + 0.5) / (i + 1)) for i in range(n)]
    got = spark.createDataFrame([*counts, *((b, a) for a, b in counts)], "n0 long, n1 long").withColumn("e", C._estimate("n0", "n1")).collect()
    for r in got:
        a, b = sorted((r.n0, r.n1))
        want = fsum(terms(b) + [log((i + 0.5) / (b + i + 1)) for i in range(a)])
        assert r.e == pytest.approx(want, rel=1e-12, abs=1e-10)
    # Counts of 10^13 keep their digits: ln of 1 / sqrt(pi n).
    huge = spark.range(1).select(F.lit(0).alias("n0"), F.lit(10**13).alias("n1")).select(C._estimate("n0", "n1").alias("e")).first().e
    assert huge == pytest.approx(-0.5 * log(pi * 10**13), abs=1e-10)


def test_probabilities_sum_to_one(spark):
    counts = spark.createDataFrame([(b << 8 | x, n) for b in (0, 97) for x, n in [(y, 5 if y == 98 else 0) for y in range(256)]], "gram long, n long")
    got = C.mixtures(counts, depth=1).collect()
    for b in (0, 97):
        assert sum(10**r.score for r in got if r.gram >> 8 == b) == pytest.approx(1)


def test_odd_rows(spark, odd, documents):
    got = C.scored(odd).collect()
    assert len(got) == 9 and all(r.score < 0 and r.base_score < 0 for r in got)
    assert C.scored(documents([])).count() == 0
    nothing = C.scored(documents([(k, "a b", "s") for k in range(40) if held(k)]))
    assert all(r.train_tokens == 0 and r.n_known == 0 for r in nothing.collect())
