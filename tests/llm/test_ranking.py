"""Ranked search against scores of every document."""

import random
import re
from collections import Counter
from math import floor, log

import duckdb
import pytest

from quaestor.llm import op13_ranking

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, k=10):
    counted = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in docs]
    counted = [(d, c, sum(c.values())) for d, c in counted if c]
    total, length = len(counted), sum(n for *_, n in counted)
    df = Counter(x for _, c, _ in counted for x in c)
    out = []
    for key, text in items:
        scores = []
        for d, c, n in counted:
            m = 25 + (75 * n * total) // length
            score = sum(floor(1000 * log((2 * total + 2) / (2 * df[x] + 1))) * ((10**9 * c[x]) // (1000 * c[x] + 8 * m)) for x in TERM.findall((text or "").translate(LOWER)) if c[x])
            if score > 0:
                scores.append((-score, d is None, d or 0, d))
        out += [(key, i + 1, s[3], -s[0]) for i, s in enumerate(sorted(scores)[:k])]
    return sorted(map(str, out))


def tables(seed, docs=150, items=12):
    rng = random.Random(seed)
    vocabulary = [rng.choice(["é", "a", "B", "ß9", "漢"]) + str(i) for i in range(60)]
    text = lambda n: "".join(rng.choice(vocabulary[: rng.randint(1, 60)]) + rng.choice([" ", "-", "  ", "\n"]) for _ in range(n))
    made = [(i, text(rng.randint(0, 60))) for i in range(docs)]
    made += [(docs + i, made[3][1]) for i in range(25)] + [(3, made[3][1]), (None, made[3][1]), (None, None), (docs + 99, ""), (docs + 100, "B1 " * 4000)]
    asked = [(i, text(rng.randint(1, 30))) for i in range(items)]
    return made, [*asked, (items, made[3][1]), asked[0], (None, "B1 é2"), (items + 1, None), (items + 2, "..."), (items + 3, "unheard of")]


@pytest.mark.parametrize("seed", [1, 2])
def test_ranked_by_brute_force(spark, seed):
    docs, items = tables(seed)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    i = spark.createDataFrame([(*x, "mine") for x in items], "item_id long, text string, score string")
    want = brute(docs, items)
    assert sorted(str(tuple(r)) for r in op13_ranking.ranked(d, i).collect()) == want
    assert sorted(str(tuple(r)) for r in op13_ranking.ranked(d, i, block=40).collect()) == want
    few = op13_ranking.ranked(d, i, k=3).collect()
    assert sorted(str(tuple(r)) for r in few) == brute(docs, items, 3)


def test_ranked_empty(spark, odd):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert op13_ranking.ranked(odd, none).collect() == []
    assert op13_ranking.ranked(odd.limit(0), some).collect() == []
    got = op13_ranking.ranked(odd, some).collect()
    assert op13_ranking.ranked(odd, some).columns == ["item_id", "rank", "doc_id", "score"]
    assert [(r.rank, r.doc_id) for r in sorted(got, key=lambda r: r.rank)] == [(1, 1), (2, 1), (3, None)]


def test_ranked_against_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    want = con.execute(op13_ranking.SQL).fetchall()
    got = [tuple(r) for r in op13_ranking.op13_ranked_search(spark, folder).select("item_id", "rank", "doc_id", "score").collect()]
    assert sorted(got) == sorted(want) and len(got) > 20
