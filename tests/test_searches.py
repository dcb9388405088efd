"""Searches for tables of queries, sessions around points and places in an order, by brute force."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quaestor.functions import parsing as P
from quaestor.functions import text as X
from quaestor.operators import fuzzy, intervals, keywords, matching, queues, relational, vectors


def grams(name):
    words = "".join(c if c.isalnum() else " " for c in name.lower()).split()
    return {f"  {w} "[i : i + 3] for w in words for i in range(len(w) + 1)}


def test_similar_names(spark):
    rng = random.Random(2)
    words = ["red", "reed", "widget", "widgets", "gadget", "budget", "école", "a"]
    names = [" ".join(rng.choice(words) + rng.choice(["", "s", str(rng.randint(0, 9))]) for _ in range(rng.randint(1, 4))) for _ in range(150)]
    rows = [*enumerate(names), (900, None), (901, "--"), (902, names[0].upper()), (903, names[0])]
    df = spark.createDataFrame(rows, "id long, name string")
    distinct = sorted({n.lower() for _, n in rows if n})
    sim = lambda a, b: round(len(grams(a) & grams(b)) / len(grams(a) | grams(b)), 9) if grams(a) | grams(b) else 0.0
    asked = {n.lower() for i, n in rows if n and i % 7 == 0}
    for cutoff, parts in ((0.22, 3), (0.6, 1000)):
        got = {(r.asked, r.name, r.similarity) for r in fuzzy.similar_names(df.where("id % 7 = 0"), df, cutoff, parts).collect()}
        assert got == {(a, b, sim(a, b)) for a in asked for b in distinct if sim(a, b) >= cutoff}
    best = fuzzy.most_similar(df.where("id = 0"), df, 4).orderBy("rank").collect()
    want = sorted((-sim(names[0].lower(), n.lower()), i) for i, n in rows if n and sim(names[0].lower(), n.lower()) >= 0.22)[:4]
    assert [(-r.similarity, r.id) for r in best] == want
    assert fuzzy.most_similar(df.limit(0), df, 4).count() == 0


def test_nearest_vectors(spark):
    rng = random.Random(3)
    vec = lambda: [rng.gauss(0, 1) for _ in range(12)]
    heads = [vec() for _ in range(9)]
    rows = [(i, [x + rng.gauss(0, 0.4) for x in heads[i % 9]]) for i in range(600)]
    rows += [(700, None), (701, []), (702, [0.0] * 12), (703, [1.0] * 5), (704, rows[5][1]), (None, vec())]
    df = spark.createDataFrame(rows, "id long, vector array<double>").repartition(4)
    asked = df.where("id % 60 = 5 or id >= 700")
    exact = vectors.nearest(asked, df, 5, block=4)

    def cos(a, b):
        return round(sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5, 9)

    good = {i: v for i, v in rows if i is not None and v and len(v) == 12 and any(v)}
    for q in (5, 65, 704):
        want = sorted((-cos(good[q], v), i) for i, v in good.items())[:5]
        got = exact.where(f"asked_id = {q}").orderBy("rank").collect()
        assert [r.id for r in got] == [i for _, i in want] and [r.similarity for r in got] == pytest.approx([-s for s, _ in want], abs=2e-9)
    assert {r.asked_id for r in exact.collect()} == {q for q in good if q % 60 == 5 or q >= 700} | {703}  # its own, being alone of its length
    index = vectors.centres(df, "id", "vector")
    some = vectors.nearest(asked, df, 5, index=index, probes=max(1, len(index) // 4))
    assert vectors.recall(some, exact).first().recall >= 0.9
    every = vectors.nearest(asked, df, 5, index=index, probes=len(index))
    assert vectors.recall(every, exact).first().recall == 1.0


def test_keyword_table(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 5)))
    docs = [(i, word().title(), " ".join(word() for _ in range(rng.randint(0, 6))), word() if i % 3 else None) for i in range(120)]
    asked = [(i, [word() for _ in range(4)] + ["ab", "a", "has blank", None]) for i in range(9)] + [(50, None), (51, [])]
    weights = {"title": (28, 18), "body": (3, 3), "note": (24, 14)}
    got = keywords.keyword_table(spark.createDataFrame(asked, "id long, terms array<string>"), spark.createDataFrame(docs, "key long, title string, body string, note string"), "key", weights, 7).collect()
    want = []
    for q, terms in asked:
        scores = []
        for key, *fields in docs:
            score = 0
            for t in {t.lower() for t in terms or [] if t and len(t) >= 2 and " " not in t}:
                score += max([0, *((e if f.lower() == t else i if t in f.lower() else 0) for f, (e, i) in zip(fields, weights.values()) if f is not None)])
            if score:
                scores.append((-score, key))
        want += [(q, k, -s, n + 1) for n, (s, k) in enumerate(sorted(scores)[:7])]
    assert sorted(tuple(r) for r in got) == sorted(want) and want


@pytest.mark.parametrize("kind", ["date", "timestamp", "double"])
def test_sessions(spark, kind):
    rng = random.Random(5)
    base = {"date": dt.date(2024, 1, 1), "timestamp": dt.datetime(2024, 1, 1), "double": 0.0}[kind]
    at = (lambda n: base + n / 8) if kind == "double" else (lambda n: base + dt.timedelta(days=n) if kind == "date" else base + dt.timedelta(minutes=n * 7))
    spans = [(i, a := rng.randint(0, 300), None if i % 9 == 0 and a > 250 else a + rng.choice([0, 3, 40])) for i in range(40)]
    spans += [(100, 5, 4), (101, 20, 22), (102, 20, 22)]
    points = [(i, rng.choice([rng.randint(-5, 320), 21])) for i in range(200)]
    s = spark.createDataFrame([(k, at(a), None if b is None else at(b)) for k, a, b in spans] + [(200, None, None)], f"session long, opened {kind}, closed {kind}")
    p = spark.createDataFrame([(i, at(n)) for i, n in points] + [(999, None)], f"id long, day {kind}")
    held = lambda n: max(((a, k) for k, a, b in spans if a <= n and (b is None or n <= b)), default=(None, None))[1]
    got = intervals.holding(p, s, "day", "opened", "closed", "session", bins=7, crowd=5).collect()
    assert {r.id: r.session for r in got} == {i: held(n) for i, n in points} | {999: None}
    firsts = sorted({a for _, a, _ in spans})
    beside = {r.id: (r.previous, r.next) for r in intervals.neighbours_in_time(p, s, "day", "opened").collect()}
    for i, n in points:
        before, after = [a for a in firsts if a < n], [a for a in firsts if a > n]
        assert beside[i] == (at(before[-1]) if before else None, at(after[0]) if after else None)
    found = {r.id: r.start for r in relational.as_of(p, s.withColumnRenamed("opened", "day").drop("session", "closed"), "day").collect()}
    assert found == {i: at(max(a for a in firsts if a <= n)) for i, n in points if n >= firsts[0]}
    assert intervals.holding(p.limit(0), s, "day", "opened", "closed", "session").count() == 0


def test_places_with_nulls_and_far_values(spark):
    rows = [(None,), (None,), (2**62,)] + [(i,) for i in range(500)]
    df = spark.createDataFrame(rows, "k long").repartition(5)
    got = sorted((r.n, r.k) for r in queues.ordinal(df, "k").collect() if r.k is not None)
    assert got == [*((i + 1, i) for i in range(500)), (501, 2**62)] and queues.ordinal(df, "k").count() == 503
    text = spark.createDataFrame([("b",), ("a",), ("c",)], "k string")
    assert sorted((r.n, r.k) for r in queues.ordinal(text, "k").collect()) == [(1, "a"), (2, "b"), (3, "c")]


def test_candidates_and_assignments(spark):
    rows = spark.createDataFrame([("センター·A",), ("ｾﾝﾀｰ ･Ｂ",), ("a‑b—c　d",), (None,)], "t string")
    assert [r.n for r in rows.select(X.normalize_candidate(F.col("t")).alias("n")).collect()] == ["センタ-・A", "センタ-・B", "a-b-cd", None]
    reply = "1\ttopic-12\n2. topic-3\n3: `t0`,\n3 → \"t1\"\n4 - null\n5 t9\n x\n6t0\n7   t0 because\n9 t0\n4:t0\n4: null"
    got = P.assignments(spark.createDataFrame([(1, reply), (2, None)], "id long, r string"), "id", "r", 8, ("topic-12", "topic-3", "t0", "t1"))
    assert {r["item"]: r.topic for r in got.where("id = 1").collect()} == {1: "topic-12", 2: None, 3: "t1", 4: None, 5: None, 6: None, 7: "t0", 8: None}
    assert got.where("id = 2 and topic is null").count() == 8


def test_references_of_several_types(spark):
    child = spark.createDataFrame([(1, "a", 5), (2, "b", None), (2, "x", 7)], "k long, s string, n int")
    got = relational.orphans(child, [("k", "k", spark.range(1, 2).toDF("k"), "k"), ("s", "s", spark.createDataFrame([("a",), ("b",)], "s string"), "s"), ("n", "n", spark.createDataFrame([(5,), (7,)], "n int"), "n")])
    assert {r.rule: r.violations for r in got.collect()} == {"k": 2, "s": 1, "n": 1}


def test_nested_sessions_make_no_pairs(spark):
    rng = random.Random(8)
    # Each holds all points inside it: 600 spans around 600 points, and short ones among them.
    spans = [(i, i, 2000 - i) for i in range(600)] + [(1000 + i, a := rng.randint(0, 1999), a + rng.randint(0, 30)) for i in range(300)] + [(5000, 700, None), (None, 3, 9)]
    points = [(i, rng.randint(-3, 2003)) for i in range(600)]
    s, p = spark.createDataFrame(spans, "session long, opened long, closed long"), spark.createDataFrame(points, "id long, day long")
    found = intervals.holding(p, s, "day", "opened", "closed", "session", bins=16, crowd=50)
    least = lambda k: -1 if k is None else k
    want = {i: max(((a, least(k)) for k, a, b in spans if a <= n and (b is None or n <= b)), default=(None, -1))[1] for i, n in points}
    assert {r.id: least(r.session) for r in found.collect()} == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "_part" not in plan and plan.count("Join") == 1  # with the points alone


def test_recipients_by_first_reason(spark):
    rng = random.Random(9)
    who = lambda: rng.choice([*range(12), None])
    named = [(rng.choice([1, 2, 3, None]), who(), rng.choice(["1 asked", "3 spoke"])) for _ in range(25)]
    sits = [(k, c) for k in (1, 2, 4, None) for c in rng.sample([0, 1, 2, None], 2)] * 2
    members = [(rng.choice([0, 1, 2, None]), who()) for _ in range(30)]
    got = matching.first_reasons(spark.createDataFrame(named, "k long, who long, reason string"), spark.createDataFrame(sits, "k long, committee long"), spark.createDataFrame(members, "committee long, who long"), "k", "2 member")
    every = named + [(k, w, "2 member") for k, c in sits for d, w in members if c is not None and c == d]
    want = {(k, w): min(r for a, b, r in every if (a, b) == (k, w)) for k, w, _ in every}
    rows = got.collect()
    assert {(r.k, r.who): r.reason for r in rows} == want and len(rows) == len(want)


def test_recipients_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(matching, "BLOCK", 16, raising=False)
    monkeypatch.setattr(matching, "DEALT", 3, raising=False)
    rng = random.Random(11)
    who = lambda: rng.choice([*range(90), None])
    named = [(rng.choice([*range(4000), None]), who(), rng.choice(["1 asked", "2 member", "3 spoke", None])) for _ in range(9000)]
    sits = [(k, c) for k in [*range(3900), None] for c in rng.sample([0, 1, 2, None], rng.choice([1, 1, 1, 1, 3]))]
    members = [(rng.choice([0, 1, 2, None]), who()) for _ in range(150)]
    got = matching.first_reasons(spark.createDataFrame(named, "k long, who long, reason string"), spark.createDataFrame(sits, "k long, committee long"), spark.createDataFrame(members, "committee long, who long"), "k", "2 member")
    of = {c: {w for d, w in members if d == c} for c in (0, 1, 2)}
    want = {}
    for k, w, r in [*named, *((k, w, "2 member") for k, c in sits if c is not None for w in of[c])]:
        want[k, w] = min((x for x in (r, want.get((k, w))) if x), default=None)
    rows = got.collect()
    assert len(rows) == len(want) and {(r.k, r.who): r.reason for r in rows} == want


def test_recipients_take_little_room(spark, monkeypatch, tmp_path):
    # As few parts as so few reports fill: 2,000 of them, five committees with 600 members each.
    monkeypatch.setattr(matching, "PARTS", 2, raising=False)
    monkeypatch.setattr(matching, "DEALT", 4, raising=False)
    sits, members = spark.range(2000).selectExpr("id as k", "hash(id) % 5 as c").selectExpr("k", "abs(c) as committee"), spark.range(3000).selectExpr("cast(id % 5 as int) as committee", "id as who")
    named = spark.range(2000).selectExpr("id as k", "id as who", "'1 asked' as reason")
    matching.first_reasons(named, sits, members, "k", "2 member").write.parquet(str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    own = sits.where("k % 5 = committee").count()
    assert back.count() == 2000 * 601 - own and back.distinct().count() == back.count()
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 0.5 * back.count()


def test_repeated_queries_and_documents_make_no_pairs(spark):
    docs = [(i, ["Red bolt", "red ring", "blue bolt", None][i % 4], "Brand") for i in range(400)]
    asked = [(1000 + i, [["red", "bolt"], ["BOLT", "red", "bolt"], ["brand"], ["none"]][i % 4]) for i in range(80)]
    got = keywords.keyword_table(spark.createDataFrame(asked, "id long, terms array<string>"), spark.createDataFrame(docs, "key long, name string, brand string"), "key", {"name": (9, 4), "brand": (5, 2)}, 3)
    best = {0: [(0, 8, 1), (4, 8, 2), (8, 8, 3)], 2: [(0, 5, 1), (1, 5, 2), (2, 5, 3)], 3: []}
    assert sorted(tuple(r) for r in got.collect()) == sorted((q, *x) for q, _ in asked for x in best[0 if q % 4 == 1 else q % 4])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [asked_id" not in plan and "Aggregate [terms" in plan


def test_best_vectors_by_tiles(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(7)
    queries, points, ids = rng.integers(0, 3, (9, 4)) / 2.0, rng.integers(0, 3, (500, 4)) / 2.0, rng.permutation(500)
    for tile in (50, 1_000_000):
        monkeypatch.setattr(vectors, "TILE", tile)
        q, i, s = vectors._best(queries, points, ids, 6, 0.5)
        near = np.round(queries @ points.T, 9)
        want = [(a, int(c), -b) for a in range(9) for b, c in sorted((-near[a, n], ids[n]) for n in range(500) if near[a, n] >= 0.5)[:6]]
        assert list(zip(q.tolist(), i.tolist(), s.tolist())) == want


def test_near_names_by_tiles(monkeypatch):
    import numpy as np

    rng = random.Random(10)
    names = ["".join(rng.choice("ab ") for _ in range(rng.randint(0, 9))) for _ in range(120)]
    lists, ids = [sorted(grams(n)) for n in names], np.array(rng.sample(range(120), 120))
    for tile in (30, 1_000_000):
        monkeypatch.setattr(fuzzy, "TILE", tile)
        q, i, c, u = fuzzy._near(lists[:20], lists, ids, 5, 0.3)
        sim = lambda a, b: len(set(a) & set(b)) / max(1, len(set(a) | set(b)))
        want = [(n, j) for n, a in enumerate(lists[:20]) for _, _, j in sorted((-round(sim(a, b), 9), int(ids[j]), j) for j, b in enumerate(lists) if a and sim(a, b) >= 0.3)[:5]]
        assert list(zip(q.tolist(), i.tolist())) == want and all(abs(x / y - sim(lists[a], lists[b])) < 1e-12 for a, b, x, y in zip(q, i, c, u))
