"""Count panels from event streams: late events, repeated events, sessions, last values."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyloom.shipping import ship


def window_counts(events: DataFrame, kinds: list[str], length: str = "1 day", slide: str | None = None, late: str = "2 days") -> DataFrame:
    """user_id, start, n, c per user and window of a stream (or table) of events.

    Events later than `late` behind the newest are dropped, repeated event ids within it count once.
    """
    seen = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])
    windows = F.window("ts", length, slide) if slide else F.window("ts", length)
    counts = seen.groupBy("user_id", windows.alias("w")).agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("event_type") == k).alias(f"c{i}") for i, k in enumerate(kinds)))
    return counts.select("user_id", F.col("w.start").alias("start"), F.col("n").cast("double").alias("n"), F.array(*(F.col(f"c{i}").cast("double") for i in range(len(kinds)))).alias("c"))


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "2 days") -> DataFrame:
    """user_id, start, end, n of runs of events without a pause over `gap`."""
    seen = events.withWatermark("ts", late) if events.isStreaming else events
    return seen.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


LAST = "user_id long, events long, last_ts timestamp, last_value double"


def _last(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    events, last_ts, last_value = state.get if state.exists else (0, None, None)
    for batch in batches:
        known = batch[batch["value"].notna()]
        events += len(batch)
        if len(known):
            row = known.loc[known["ts"].idxmax()]
            if last_ts is None or row["ts"].value >= last_ts:
                last_ts, last_value = row["ts"].value, float(row["value"])
    state.update((events, last_ts, last_value))
    yield pd.DataFrame({"user_id": [key[0]], "events": [events], "last_ts": [pd.Timestamp(last_ts) if last_ts is not None else pd.NaT], "last_value": [last_value]})


def last_values(events: DataFrame) -> DataFrame:
    """user_id, events so far, time and value of the newest known value: carried forward over batches."""
    ship(events.sparkSession)
    return events.select("user_id", "ts", "value").groupBy("user_id").applyInPandasWithState(_last, LAST, "events long, last_ts long, last_value double", "update", GroupStateTimeout.NoTimeout)
