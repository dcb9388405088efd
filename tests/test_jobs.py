import json
import random
from datetime import UTC, datetime, timedelta

import pytest

from quaestor.streaming import jobs, windows

START = datetime(2026, 1, 1, tzinfo=UTC)
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def minute(n):
    return (START + timedelta(minutes=n)).isoformat()


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKS)
    yield spark
    spark.conf.set(key, before)


#: (job, minute, kind, requested minute): "a" is done at once; "b" fails five times, "c" hangs, is asked for anew and then done; "gone" isn't there.
EVENTS = [
    ("a", 0, "enqueue", None), ("a", 2, "done", 0),
    ("b", 0, "enqueue", None), ("b", 1, "failed", 0), ("b", 3, "failed", 0), ("b", 6, "failed", 0), ("b", 11, "failed", 0), ("b", 20, "failed", 0), ("b", 30, "done", 0),
    ("c", 5, "enqueue", None), ("c", 22, "enqueue", None), ("c", 23, "done", 5), ("c", 24, "done", 22),
    ("gone", 1, "enqueue", None), (None, 1, "enqueue", None), ("a", 3, "other", 0),
]
WANT = [
    ("a", 0, "pending", 0), ("a", 0, "claimed", 1), ("a", 2, "done", 1),
    ("b", 0, "pending", 0), ("b", 0, "claimed", 1), ("b", 1, "retry", 1), ("b", 2, "claimed", 2), ("b", 3, "retry", 2), ("b", 5, "claimed", 3), ("b", 6, "retry", 3), ("b", 10, "claimed", 4), ("b", 11, "retry", 4), ("b", 19, "claimed", 5), ("b", 20, "failed", 5),
    ("c", 5, "pending", 0), ("c", 5, "claimed", 1), ("c", 15, "claimed", 2), ("c", 22, "pending", 0), ("c", 22, "claimed", 1), ("c", 24, "done", 1),
]


def ran(spark, folder, batches, restart):
    """The transitions (job, minute, action, attempts) of batches of events, each a run of its own where ``restart`` is."""
    (folder / "in").mkdir(parents=True)
    existing = spark.createDataFrame([("a",), ("b",), ("c",), ("c",), ("end",)], "job_id string")

    def begin():
        stream = windows.ndjson(spark, str(folder / "in"), "job_id string, at timestamp, kind string, requested_at timestamp")
        return jobs.live_queue(stream, existing, late="10 minutes").writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "state")).start()

    q = begin()
    for i, rows in enumerate([*batches, [("end", 100, "other", None)], [("end", 101, "enqueue", None)], [("end", 102, "done", 1)]]):
        (folder / "in" / f"{i}.ndjson").write_text("\n".join(json.dumps({"job_id": j, "at": minute(m), "kind": k, "requested_at": None if r is None else minute(r)}) for j, m, k, r in rows))
        q.processAllAvailable()
        if restart and i == 1:
            q.stop()
            q = begin()
    q.stop()
    found = spark.read.parquet(str(folder / "out")).where("job_id <> 'end'").collect()
    return sorted((r.job_id, int((r.at.astimezone(UTC) - START).total_seconds() // 60), r.action, r.attempts) for r in found)


def test_queue_in_any_order_and_after_a_restart(rocks, tmp_path):
    shuffled = random.Random(3).sample(EVENTS, len(EVENTS))
    early, rest = [e for e in shuffled if e[1] <= 8], [e for e in shuffled if e[1] > 8]
    # The late half of the early events still is within the watermark.
    batches = [early[::2], early[1::2], rest[::2], rest[1::2]]
    assert ran(rocks, tmp_path / "x", batches, restart=True) == sorted(WANT)


def test_transitions_don_t_depend_on_when_time_passes():
    rng = random.Random(1)
    for _ in range(300):
        asked = [rng.randint(0, 200) for _ in range(rng.randint(1, 3))]
        events = sorted([(m * jobs.MINUTE, "enqueue", -1) for m in asked] + [(rng.randint(0, 260) * jobs.MINUTE, rng.choice(["done", "failed"]), rng.choice(asked) * jobs.MINUTE) for _ in range(rng.randint(0, 9))])
        rules, end = (10 * jobs.MINUTE, 5, 7 * 1440 * jobs.MINUTE), 300 * jobs.MINUTE
        _, left, whole = jobs.advanced(None, events, end, *rules)
        job, waiting, steps = None, list(events), []
        for until in sorted(rng.sample(range(300), 6)) + [300]:
            job, waiting, out = jobs.advanced(job, waiting, until * jobs.MINUTE, *rules)
            steps += out
        assert steps == whole and left == waiting == []
        claims = [n for _, action, n, _ in whole if action == "claimed"]
        assert all(n >= 1 for n in claims) and [t for t, *_ in whole] == sorted(t for t, *_ in whole)
