"""Tasks and call slots: latest state, eviction, rotation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repograph import constants as K
from repograph.operators.graph import first_match


def latest_state(changes: DataFrame, made: DataFrame | None = None) -> DataFrame:
    """(task_id, status, at, changes): the last of a task's changes (task_id, status, at); setters are unconditional.

    With ``made`` (task_id), changes of unknown tasks are ignored.
    """
    if made is not None:
        changes = changes.join(made.select("task_id"), "task_id", "left_semi")
    return changes.groupBy("task_id").agg(F.max_by("status", "at").alias("status"), F.max("at").alias("at"), F.count("*").alias("changes"))


def evicted(states: DataFrame, now: Column, ttl_seconds: int = K.TASK_TTL_SECONDS, finished: tuple[str, ...] = ("completed", "failed")) -> DataFrame:
    """What stays: finished tasks whose last change (updated_at) is more than the time to live ago are dropped."""
    old = F.col("updated_at") < now - F.expr(f"make_dt_interval(0, 0, 0, {ttl_seconds})")
    return states.where(~(F.col("status").isin(*finished) & old))


def slots(keys: DataFrame, models: DataFrame) -> DataFrame:
    """(seq, api_key, model_name): every key (api_key, place) with every model, key by key. Settings, so few rows."""
    pairs = keys.join(models, F.lit(True))
    return pairs.select("api_key", "model_name", (F.row_number().over(Window.orderBy("place", "model_name")) - 1).cast("long").alias("seq"))


def first_available(rows: DataFrame, keys: list[str], order: Column, free: Column) -> DataFrame:
    return first_match(rows.where(free), keys, [order])


def wait_seconds(rows: DataFrame, now: Column) -> DataFrame:
    """(soonest, available) of slots with rate_limited_until: nothing to wait for if one is free; the buffer is not added."""
    left = F.greatest(F.lit(0.0), F.unix_micros(F.col("rate_limited_until")) / 1e6 - F.unix_micros(now) / 1e6)
    wait = F.coalesce(left, F.lit(0.0))
    return rows.agg(F.min(wait).alias("soonest"), F.count_if(wait == 0).alias("available"))


def limited(rows: DataFrame, key: Column, now: Column, retry_after: Column | None = None) -> DataFrame:
    """Slots after the one that ``key`` picks was refused: it cools for as long as was told, or the default, and a bit."""
    seconds = F.coalesce(F.lit(None).cast("double") if retry_after is None else retry_after, F.lit(K.RATE_LIMIT_DEFAULT)) + K.RATE_LIMIT_BUFFER
    until = F.timestamp_micros((F.unix_micros(now) + seconds * 1e6).cast("long"))
    return rows.withColumn("rate_limited_until", F.when(key, until).otherwise(F.col("rate_limited_until")))


def reset(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rate_limited_until", F.lit(None).cast("timestamp"))
