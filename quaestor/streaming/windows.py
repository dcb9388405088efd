"""Streams: counts in tumbling windows, impressions once each, folds of events, NDJSON."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def window_counts(events: DataFrame, key: str, ts: str = "ts", window: str = "10 minutes", late: str = "2 days", limit: int = 60) -> DataFrame:
    """Requests of each key and window, and whether they exceed ``limit``; windows are forgotten after ``late``."""
    counted = events.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), key).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), key, "n", (F.col("n") > limit).alias("limited"))


def impressions(events: DataFrame, keys: list[str], ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each impression once within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def ndjson(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Rows of a folder of NDJSON files as they arrive; lines of another form give nulls."""
    return spark.readStream.text(folder).select(F.from_json("value", schema).alias("r")).select("r.*")


def folded_slots(events: DataFrame) -> DataFrame:
    """Events (slot, seq, kind) folded into each slot's state: planned, running, done or failed, and its turns.

    An error is final. What is kept doesn't depend on the order of arrival: turns and
    ends that come before the start, in an earlier batch too, count once it has come.
    Events are expected once each; ``impressions`` drops those that are sent twice.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        started, ended, failed, turns = state.get if state.exists else (False, False, False, 0)
        for rows in batches:
            kinds = rows["kind"]
            started |= bool((kinds == "started").any())
            ended |= bool((kinds == "complete").any())
            failed |= bool((kinds == "error").any())
            turns += int((kinds == "turn").sum())
        state.update((started, ended, failed, turns))
        status = "failed" if failed else "planned" if not started else "done" if ended else "running"
        yield pd.DataFrame({"slot": [key[0]], "status": [status], "turns": [turns if started else 0]})

    return events.groupBy("slot").applyInPandasWithState(fold, "slot string, status string, turns long", "started boolean, ended boolean, failed boolean, turns long", "update", GroupStateTimeout.NoTimeout)
