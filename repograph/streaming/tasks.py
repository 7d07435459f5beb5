"""Tasks as a stream of changes: latest states, eviction after a time to live, and counts over windows of event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from repograph import constants as K


def read_changes(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    """A stream of (task_id, status, at) from event files; their times carry no zone and count as UTC."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return rows.select(F.col("user_id").alias("task_id"), F.col("event_type").alias("status"), F.col("ts").cast("timestamp").alias("at"), "event_id")


def latest_states(changes: DataFrame) -> DataFrame:
    """(task_id, status, at, changes), updated as changes come; the engine keeps the state, one row a task."""
    seen = F.struct("at", "event_id")
    grouped = changes.groupBy("task_id").agg(F.max_by("status", seen).alias("status"), F.max("at").alias("at"), F.count("*").alias("changes"))
    return grouped


def evictions(changes: DataFrame, ttl_seconds: int = K.TASK_TTL_SECONDS, delay: str = "10 minutes", finished: tuple[str, ...] = ("completed", "failed")) -> DataFrame:
    """(task_id, status, evicted): a row for each change that is a task's latest, and one when a finished task's time to live
    has gone by, by event time. Its state is then forgotten; a task that is not finished stays."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            status, _ = state.get
            state.remove()
            yield pd.DataFrame({"task_id": [key[0]], "status": [status], "evicted": [True]})
            return
        rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
        last, status = int(rows["at"].iloc[-1].timestamp() * 1000), rows["status"].iloc[-1]
        if state.exists and state.get[1] > last:
            status, last = state.get
        state.update((status, last))
        if status in finished:
            state.setTimeoutTimestamp(max(last + 1000 * ttl_seconds, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"task_id": [key[0]], "status": [status], "evicted": [False]})

    marked = changes.withWatermark("at", delay)
    return marked.groupBy("task_id").applyInPandasWithState(
        step, "task_id long, status string, evicted boolean", "status string, last long", "update", GroupStateTimeout.EventTimeTimeout
    )


def windowed_counts(changes: DataFrame, size: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """(start, status, n) over tumbling windows; rows that come later than the delay are left out."""
    grouped = changes.withWatermark("at", delay).groupBy(F.window("at", size), "status").agg(F.count("*").alias("n"))
    return grouped.select(F.col("window.start").alias("start"), "status", "n")


def session_counts(changes: DataFrame, gap: str = "2 hours", delay: str = "1 hour") -> DataFrame:
    """(task_id, start, end, n): runs of a task's changes with pauses shorter than the gap."""
    grouped = changes.withWatermark("at", delay).groupBy(F.session_window("at", gap), "task_id").agg(F.count("*").alias("n"))
    return grouped.select("task_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
