import datetime as dt
import hashlib
import hmac

from pyspark.sql import functions as F

from quaestor.functions import parsing as P
from quaestor.operators import relational as R
from quaestor.operators import versions as V


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_sections(spark):
    md = "intro\n\n# One\na\n b\n## Two\n# Opinions\nhidden\n## Under\nhidden too\n# Last\nc"
    got = P.markdown_sections(spark.createDataFrame([(1, md), (2, None)], "id long, md string"), "id", "md", "body", F.col("heading") == "Opinions").orderBy("section").collect()
    assert [(r.heading, r.content) for r in got] == [("body", "intro"), ("One", "a b"), ("Last", "c")]


def test_assignments(spark):
    text = "1\t`t0`\n2: t9\n 3 → t1,\nnonsense\n1 - t1\n7 t0\n4 null"
    got = P.assignments(spark.createDataFrame([(1, text)], "id long, text string"), "id", "text", 4, ("t0", "t1")).orderBy("item").collect()
    assert [r.topic for r in got] == ["t1", None, "t1", None]


def test_daily_pick(spark):
    ids, seed = [f"c{i}" for i in range(7)], 2166136261
    for c in "2026-04-01":
        seed = (seed ^ ord(c)) * 16777619 % 2**32
    want = sorted(ids)
    for i in range(len(want) - 1, 0, -1):
        seed = (seed * 1664525 + 1013904223) % 2**32
        j = seed % (i + 1)
        want[i], want[j] = want[j], want[i]
    assert value(spark, P.daily_pick(F.array(*map(F.lit, ids[::-1])), F.lit(dt.date(2026, 4, 1)))) == want[:3]
    assert value(spark, P.daily_pick(F.array(F.lit("a")), F.lit(dt.date(2026, 4, 1)))) == ["a"]


def test_names(spark):
    assert value(spark, P.questioner(F.lit("本会議で山田 太郎議員が質問"))) == "山田太郎"
    assert value(spark, P.questioner(F.lit("none"))) is None
    assert value(spark, P.committee(F.lit("付託（総務委員会）"))) == "総務委員会"
    assert value(spark, P.questioner(F.lit("定例会。本会議で、鈴木議員が代表質問。"))) == "鈴木"
    assert value(spark, P.committee(F.lit("付託委員会: 文教委員会、（総務委員会）"))) == "文教委員会"
    assert value(spark, P.committee(F.lit("また建設委員会で"), ("建設委員会",))) == "建設委員会" and value(spark, P.committee(F.lit("なし"))) is None
    assert value(spark, P.role_title(F.lit("  市民 "), ("市民",))) is None


def test_session_values(spark):
    now = F.lit(dt.datetime(2026, 1, 1, 1, 0)).cast("timestamp")
    start = F.lit(dt.datetime(2026, 1, 1, 0, 50, 30)).cast("timestamp")
    assert value(spark, P.remaining_minutes(F.lit(15), start, now)) == 6
    assert value(spark, P.remaining_minutes(F.lit(None).cast("int"), start, now)) is None
    assert value(spark, P.progress(F.lit(8), F.lit("chat"), F.array(F.lit("a"), F.lit("a"), F.lit("b")))) == 10
    assert value(spark, P.stale(F.lit("pending"), start, F.lit(None).cast("timestamp"), now)) and not value(spark, P.stale(F.lit("running"), start, start, now))
    assert value(spark, P.off_topic(F.lit("recipe for curry"), ("curry",), ("school",))) == "blocked"
    assert value(spark, P.japan_day(F.lit(dt.datetime(2026, 1, 1, 15, 0)).cast("timestamp"))) == dt.date(2026, 1, 2)
    assert value(spark, P.token_cost(F.lit(1000), F.lit(None).cast("int"), F.lit(2.5), F.lit(10.0))) == 0.0025
    m = value(spark, P.text_metrics(F.lit("a😀")))
    assert (m.chars, m.utf16_units, m.bytes) == (2, 3, 5)
    assert value(spark, P.keyed_digest("k")(F.lit("x"))) == hmac.new(b"k", b"x", hashlib.sha256).hexdigest()
    assert [(x.text, x.match) for x in value(spark, P.segments(F.lit("a.B and a.b!"), "A.b"))] == [("a.B", True), (" and ", False), ("a.b", True), ("!", False)]
    got = value(spark, P.message(F.lit('{"text": "hi", "next_stage": "summary", "quick_replies": ["y"]}'), ("summary",)))
    assert (got.text, got.stage, got.quick_replies, got.has_report) == ("hi", "summary", ["y"], False)
    assert value(spark, P.message(F.lit("plain"), ("s",))).text == "plain"


def test_versions(spark):
    reg = spark.createDataFrame([("a", "active", 1), ("b", "staging", 1), ("c", "staging", 0)], "id string, status string, ok int")
    status = lambda df: {r.id: r.status for r in df.collect()}
    assert status(V.activated(reg, "b", F.col("ok") == 1)) == {"a": "archived", "b": "active", "c": "staging"}
    assert status(V.activated(reg, "c", F.col("ok") == 1)) == status(reg)
    cur = spark.createDataFrame([("t", 1, "old"), ("t", 2, "old")], "topic string, item long, note string")
    rev = spark.createDataFrame([("t", 1, "x", "exclude"), ("t", 2, "new", "revise"), ("t", 3, "new", "approve")], "topic string, item long, note string, decision string")
    assert sorted(map(tuple, V.published_relations(cur, rev, ["topic", "item"]).collect())) == [("t", 2, "new"), ("t", 3, "new")]
    state = spark.createDataFrame([("a", "n", 9), ("b", "n", 5)], "k string, name string, top long")
    seen = spark.createDataFrame([("a", "n", 3), ("b", "renamed", 2), ("c", "n", 1)], "k string, name string, top long")
    assert {r.k: r.top for r in V.high_water(state, seen, "k", "top").collect()} == {"a": 9, "b": 2, "c": 1}
    old = spark.createDataFrame([("a", "x", 1), ("b", "x", 4), ("d", "x", 2)], "k string, tags string, version int")
    new = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "k string, tags string")
    assert {r.k: (r.tags, r.version) for r in V.bumped(old, new, "k", ["tags"]).collect()} == {"a": ("x", 1), "b": ("y", 5), "c": ("z", 1), "d": ("x", 2)}
    topics, pairs = V.numbered_pairs(spark.createDataFrame([("p",), ("q",), ("r",)], "topic string"), spark.createDataFrame([("q", 1), ("q", 2), ("p", 3)], "topic string, opinion long"))
    assert {r.topic: r.sort_order for r in topics.collect()} == {"q": 0, "p": 1} and pairs.count() == 3
    rows = spark.createDataFrame([("t", "s" * 30), ("t", ""), (None, "short")], "title string, summary string")
    assert sorted(sorted(r.issues) for r in V.title_audit(rows, 10, 20).collect()) == [["duplicate_title"], ["duplicate_title", "missing_summary"], ["missing_title", "summary_too_short"]]
    made = V.batched(spark.range(10), "id", 4, lambda xs: [{"n": len(xs), "first": xs[0]["id"]}], "n long, first long")
    assert sorted(map(tuple, made.collect())) == [(2, 8), (4, 0), (4, 4)]
    have = spark.createDataFrame([(1, "x")], "k long, v string")
    assert V.ensured(have, spark.createDataFrame([(1,), (2,)], "k long"), ["k"], lambda d: d.withColumn("v", F.lit("new"))).count() == 2


def test_changes(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", "x")], "k long, p string, q string")
    new = spark.createDataFrame([(1, "a", None), (2, "b", "y"), (3, "c", None)], "k long, p string, q string")
    assert sorted(r.k for r in R.changed(old, new, "k", ["p", "q"]).collect()) == [2, 3]
    assert {(r.k, r.p) for r in R.merged(old, new.where("k > 1"), ["k"]).collect()} == {(1, "a"), (2, "b"), (3, "c")}


def test_sync_by_presence(spark):
    d = spark.createDataFrame([(1, "a", "m"), (2, None, "m"), (3, None, "m"), (4, "x", "n")], "k long, d string, m string")
    e = spark.createDataFrame([(1, "a", "m"), (2, None, "m"), (4, "x", "m"), (5, None, "m")], "k long, d string, m string")
    assert {r.k: r.action for r in R.sync_plan(d, e, "k", "d").collect()} == {1: "keep", 2: "keep", 3: "insert", 4: "keep", 5: "delete"}
    assert {r.k: r.action for r in R.sync_plan(d, e, "k", "d", "m").collect()} == {1: "keep", 2: "keep", 3: "insert", 4: "update", 5: "delete"}


def test_as_of_over_gaps(spark):
    """Ranges without a start, points before all and after the last of them."""
    points = [(i, k) for i, k in enumerate([-5, 0, 1, 7, 500, 999, 1000, 10**6, 10**6, 12, 2 * 10**6])]
    starts = [0, 7, 999, 10**6 - 3]
    got = {r.id: r.start for r in R.as_of(spark.createDataFrame(points, "id long, k long"), spark.createDataFrame([(s,) for s in starts], "k long"), "k", ranges=16).collect()}
    assert got == {i: max(s for s in starts if s <= k) for i, k in points if k >= 0}


def test_orphans_and_terciles(spark):
    child = spark.createDataFrame([(1, 5), (2, 6), (2, None), (9, 5)], "a long, b long")
    pa, pb = spark.createDataFrame([(1,), (2,)], "k long"), spark.createDataFrame([(5,), (6,)], "k long")
    assert {r.rule: r.violations for r in R.orphans(child, [("a", "a", pa, "k"), ("b", "b", pb, "k"), ("all", "a", child, "a")]).collect()} == {"a": 1, "b": 1, "all": 0}
    rows = [("g", x) for x in (1, 1, 2, 3, 3, 3, 9)] + [("h", 4)]
    got = sorted((r.g, r.v, r.tier) for r in R.tercile(spark.createDataFrame(rows, "g string, v long"), ["g"], "v").collect())
    a = [1, 1, 2, 3, 3, 3, 9]
    low, high = a[int(6 / 3)], a[int(12 / 3)]
    assert got == [("g", x, 1 if x <= low else 2 if x <= high else 3) for x in a] + [("h", 4, 1)]


def test_backfill_stops():
    from quaestor.operators import queues as Q

    left = [90]
    assert Q.until_done(lambda: left[0], lambda: left.__setitem__(0, max(left[0] - 30, 0))) == 0
    assert Q.until_done(lambda: 7, lambda: None) == 7


def test_pages(spark):
    from quaestor.operators import listing as L

    rows = spark.range(25).toDF("k")
    last = L.paged(rows, [F.col("k")], 3, 10).collect()
    assert [r.k for r in last] == list(range(20, 25)) and not any(r.has_more for r in last)
    assert all(r.has_more for r in L.paged(rows, [F.col("k")], 2, 10).collect())
    empty = L.clamped(rows.limit(0), [F.col("k")], 4, 10)
    assert empty.count() == 0 and {r.page for r in L.clamped(rows, [F.col("k")], -3, 10).collect()} == {1}
