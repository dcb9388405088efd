"""A live queue: requests, claims, back-off, stuck jobs and ends, as a fold over each job's events in event time.

Needs ``spark.sql.streaming.stateStore.providerClass`` to name the RocksDB provider.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MINUTE = 60_000
OUTPUT = "job_id string, at timestamp, action string, attempts int, requested_at timestamp"


def advanced(job: tuple | None, events: list[tuple], until: int, stuck: int, attempts: int, keep: int) -> tuple[tuple | None, list[tuple], list[tuple]]:
    """The job, the events left and the transitions up to a time, in order of time; events come before what falls due then.

    A job is (status, attempts, requested, due) in milliseconds, an event (at, kind,
    requested), a transition (at, action, attempts, requested).
    """
    events, out = sorted(events), []
    while True:
        due = job[3] if job else None
        if events and events[0][0] <= until and (due is None or events[0][0] <= due):
            at, kind, of = events.pop(0)
            if kind == "enqueue":
                job = ("pending", 0, at, at)
                out.append((at, "pending", 0, at))
            elif job and job[0] == "processing" and job[2] == of and kind in ("done", "failed"):
                n = job[1]
                action = "done" if kind == "done" else "failed" if n >= attempts else "retry"
                wait = keep if action == "failed" else min(60, 2 ** (n - 1)) * MINUTE
                job = None if action == "done" else ("failed" if action == "failed" else "pending", n, of, at + wait)
                out.append((at, action, n, of))
        elif due is not None and due <= until:
            if job[0] == "failed":
                job = None
            else:
                # A lock that is older than ``stuck`` counts as free.
                job = ("processing", job[1] + 1, job[2], due + stuck + 1)
                out.append((due, "claimed", job[1], job[2]))
        else:
            return job, events, out


class _Queue(StatefulProcessor):
    def __init__(self, stuck: int, attempts: int, keep: int):
        self.rules = (stuck, attempts, keep)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "status string, attempts int, requested long, due long")
        self.waiting = handle.getListState("waiting", "at long, kind string, requested long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        """Events wait until the watermark has passed them, so that their order of arrival doesn't count."""
        new = [Row(at=r["at_ms"], kind=r["kind"], requested=r["requested_ms"]) for r in rows]
        self.waiting.appendList(new)
        self.handle.registerTimer(max(min(r["at"] for r in new), timerValues.getCurrentWatermarkInMs() + 1))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        job = tuple(self.job.get()) if self.job.exists() else None
        events = [tuple(e) for e in self.waiting.get()] if self.waiting.exists() else []
        job, left, out = advanced(job, [(a, k, r if r is not None else -1) for a, k, r in events], timerValues.getCurrentWatermarkInMs(), *self.rules)
        if job:
            self.job.update(job)
        elif self.job.exists():
            self.job.clear()
        if left:
            self.waiting.put([Row(at=a, kind=k, requested=r) for a, k, r in left])
        elif events:
            self.waiting.clear()
        ahead = [e[0] for e in left] + ([job[3]] if job else [])
        if ahead:
            self.handle.registerTimer(min(ahead))
        stamp = lambda ms: datetime.fromtimestamp(ms / 1000, UTC)
        for at, action, n, requested in out:
            yield Row(job_id=key[0], at=stamp(at), action=action, attempts=n, requested_at=stamp(requested))

    def close(self) -> None:
        pass


def live_queue(events: DataFrame, existing: DataFrame | None = None, late: str = "10 minutes", stuck_minutes: int = 10, attempts: int = 5, keep_days: int = 7) -> DataFrame:
    """(job_id, at, action, attempts, requested_at): each job's transitions, from events (job_id, at, kind, requested_at).

    ``kind`` is enqueue, done or failed. A request is claimed as soon as it is due, and
    once more where nothing has been heard for ``stuck_minutes``; a claim adds an attempt.
    A failure waits 1, 2, 4 ... up to 60 minutes, and is final from ``attempts`` on. An
    end counts for the request that its ``requested_at`` names, and only while that is
    claimed. A new request starts over. Finished jobs leave no state, failed ones for
    ``keep_days``. Jobs outside ``existing`` aren't queued; events without a job, a time or a known
    kind are left out, as are those that come later than ``late``. Transitions come once the watermark has passed them.
    """
    known = events.where(F.col("job_id").isNotNull() & F.col("at").isNotNull() & F.col("kind").isin("enqueue", "done", "failed"))
    if existing is not None:
        known = known.join(existing.select("job_id").distinct(), "job_id", "left_semi")
    timed = known.withWatermark("at", late).withColumns({"at_ms": F.unix_millis("at"), "requested_ms": F.unix_millis("requested_at"), "job_id": F.col("job_id").cast("string")})
    return timed.groupBy("job_id").transformWithState(_Queue(stuck_minutes * MINUTE, attempts, keep_days * 1440 * MINUTE), OUTPUT, "append", "EventTime")
