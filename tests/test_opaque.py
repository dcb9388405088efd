import threading

import pytest

from quaestor.operators import opaque as O


class Passing(Exception):
    status_code = 429


def test_retries():
    waits, tries = [], []

    def call(kind):
        tries.append(kind)
        if kind == "once" and len(tries) < 2:
            raise Passing
        if kind == "busy":
            raise RuntimeError("model Overloaded")
        if kind == "wrong":
            raise ValueError("bad request")
        return kind

    assert O.retried(call, "once", sleep=waits.append) == "once" and waits == [0.5]
    with pytest.raises(RuntimeError):
        O.retried(call, "busy", sleep=waits.append)
    assert waits == [0.5, 0.5, 1.0]
    with pytest.raises(ValueError):
        O.retried(call, "wrong", sleep=waits.append)
    assert len(waits) == 3


def test_batches_of_a_hot_group(spark):
    rows = [("hot", i) for i in range(95)] + [("b", i) for i in range(3)] + [(None, 1), ("b", None)]
    got = O.in_batches(spark.createDataFrame(rows, "g string, i long").repartition(7), "g", "i", 10).collect()
    assert sorted((r.g, r.batch, [x.i for x in r.rows]) for r in got) == sorted([("hot", n, list(range(95))[n * 10 : n * 10 + 10]) for n in range(10)] + [("b", 0, [0, 1, 2])])


def test_calls_run_some_at_a_time(spark):
    def together(i):
        # Five calls meet, which they can only while they run together.
        threading.__dict__.setdefault("_met_in_test", threading.Barrier(5)).wait(30)
        return i * 2 if i != 3 else 1 // 0

    rows = spark.range(10).selectExpr("id as i", "id as k").coalesce(1)
    got = O.called(rows, ["i"], together, "long", workers=5).collect()
    assert sorted((r.k, r.result) for r in got if r.error is None) == [(i, i * 2) for i in range(10) if i != 3]
    assert [(r.k, r.error.split(":")[0]) for r in got if r.error] == [(3, "ZeroDivisionError")]


def calls(bad_extract="", bad_merge="", bad_judge="", bad_assign=""):
    """A stub: a topic is an opinion's title; a word in ``bad_...`` makes the call fail."""

    def extract(rows):
        if any(bad_extract and r["content"] == bad_extract for r in rows):
            raise ValueError("extract")
        return [{"title": t, "description": "d"} for t in sorted({r["title"] for r in rows})]

    def merge(drafts):
        if any(bad_merge and d["title"] == bad_merge for d in drafts):
            raise ValueError("merge")
        return [{"title": t, "description": "m"} for t in sorted({d["title"] for d in drafts})]

    def judge(drafts, existing):
        if any(bad_judge and d["title"] == bad_judge for d in drafts):
            raise ValueError("judge")
        has = {t["title"] for t in existing}
        return [0, 99] + [n for n, d in enumerate(drafts, 1) if d["title"] not in has for _ in range(2)]

    def assign(rows, topics):
        if any(bad_assign and r["content"] == bad_assign for r in rows):
            raise ValueError("assign")
        by = {t["title"]: t["topic"] for t in topics}
        return "\n".join(f"{n}\t{by.get(r['title'], 'unheard-of')}" for n, r in enumerate(rows, 1))

    return O.Calls(extract, merge, judge, assign)


def analysed(spark, opinions, existing, made, **kw):
    topics, assigned, failures = O.topic_analysis(spark.createDataFrame(opinions, "subject string, opinion long, title string, content string").repartition(5), spark.createDataFrame(existing, "subject string, topic string, title string, description string"), made, delay=0.0, **kw)
    return ({(r.subject, r.topic, r.title, r.is_new) for r in topics.collect()}, sorted((r.subject, r.opinion, r.topic) for r in assigned.collect()), sorted((r.subject, r.phase, r.batch) for r in failures.collect()))


def test_analysis(spark):
    opinions = [("x", i, f"t{i % 7}", "c") for i in range(95)] + [("y", i, "t0", "bad" if i == 25 else "c") for i in range(50)] + [("z", 1, "t1", "c")]
    topics, assigned, failures = analysed(spark, opinions, [("x", "old", "t3", ""), ("x", "older", "t9", ""), ("w", "other", "t1", "")], calls(bad_assign="bad"), extract_size=40, fan=8)
    new = [f"t{i}" for i in range(7) if i != 3]
    assert topics == {("x", "old", "t3", False), ("x", "older", "t9", False), ("y", "new-1", "t0", True), ("z", "new-1", "t1", True)} | {("x", f"new-{n}", t, True) for n, t in enumerate(new, 1)}
    ids = {t: i for s, i, t, _ in topics if s == "x"}
    # The second batch of twenty in y fails: its opinions are there without a topic.
    assert assigned == sorted([("x", i, ids[f"t{i % 7}"]) for i in range(95)] + [("y", i, None if 20 <= i < 40 else "new-1") for i in range(50)] + [("z", 1, "new-1")], key=lambda r: r[:2])
    assert failures == [("y", "assign", 1)]


@pytest.mark.parametrize("phase", ["extract", "merge", "judge"])
def test_a_failing_subject_goes_alone(spark, phase):
    opinions = [("x", 1, "t1", "c"), ("x", 2, "bad", "bad"), ("y", 1, "t1", "c")]
    topics, assigned, failures = analysed(spark, opinions, [("x", "a", "t1", ""), ("y", "b", "t1", "")], calls(**{f"bad_{phase}": "bad"}))
    assert topics == {("y", "b", "t1", False)} and assigned == [("y", 1, "b")] and failures == [("x", phase, 0)]


def test_nothing_to_analyse(spark):
    assert analysed(spark, [], [("x", "a", "t", "")], calls()) == (set(), [], [])
