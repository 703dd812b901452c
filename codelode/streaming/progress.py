"""Progress events and rate limits, as streams and as batches (survey R1-R5, W10).

The same transformations work on both; watermarks bound the state of streams.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Statuses of a task, and which of them end it.
STATUSES = ["pending", "in_progress", "completed", "failed"]
ENDED = ["completed", "failed"]


def percent(current: Column, total: Column) -> Column:
    """R1."""
    return F.when(total > 0, F.least(F.lit(100.0), 100.0 * current / total)).otherwise(0.0)


def windows(events: DataFrame, size: str, slide: str | None = None, late: str = "1 hour", keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Tumbling (or, with slide, sliding) counts and sums; late rows up to the watermark count."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """Runs of a user's events without a longer pause."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def latest(events: DataFrame) -> DataFrame:
    """The last event of each task."""
    return events.groupBy("task_id").agg(F.max_by(F.struct("phase", "current", "total", "ts"), F.struct("ts", "current")).alias("e")).select("task_id", "e.*")


def unexpired(tasks: DataFrame, now: Column, seconds: int = 3600) -> DataFrame:
    """Ended tasks go after an hour."""
    return tasks.where(~F.col("status").isin(ENDED) | (F.timestamp_diff("SECOND", F.col("ts"), now) <= seconds))


def within_limit(events: DataFrame, most: int, seconds: int) -> DataFrame:
    """W10, R5, batch: whether each request is among the first `most` of the last `seconds`."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy(at).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("recent", F.count("*").over(w)).withColumn("allowed", F.col("recent") <= most)


def track(events: DataFrame) -> DataFrame:
    """R2: each task's state machine over a stream: pending, in progress, then completed or
    failed, and nothing after that; progress never goes back. State leaves an hour after the end."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        status, progress = state.get if state.exists else ("pending", 0.0)
        for rows in parts:
            for _, r in rows.sort_values("ts").iterrows():
                if status in ENDED:
                    break
                if r["phase"] == "error":
                    status = "failed"
                else:
                    done = min(1.0, max(0.0, r["current"] / r["total"])) if r["total"] else 0.0
                    progress = max(progress, done)
                    status = "completed" if progress >= 1.0 else "in_progress"
        state.update((status, progress))
        if status in ENDED:
            state.setTimeoutDuration(3_600_000)
        yield pd.DataFrame({"task_id": [key[0]], "status": [status], "progress": [progress]})

    return events.groupBy("task_id").applyInPandasWithState(step, "task_id string, status string, progress double", "status string, progress double", "update", GroupStateTimeout.ProcessingTimeTimeout)
