from pyspark.sql import functions as F

from repograph.streaming import tasks

SF = "/root/testdata/sf0.001"


def run(frame, mode, tmp_path, name):
    query = frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return frame.sparkSession.table(name)


def changes(spark, tmp_path, parts=3):
    events = spark.read.parquet(f"{SF}/events.parquet")
    ordered = events.orderBy("ts").coalesce(1)
    n = events.count()
    for k in range(parts):  # files in the order of time
        rows = ordered.where((F.col("event_id") >= k * n // parts) & (F.col("event_id") < (k + 1) * n // parts))
        rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return tasks.read_changes(spark, f"{tmp_path}/in", events.schema), events


def test_latest_states(spark, tmp_path):
    stream, events = changes(spark, tmp_path)
    got = {r.task_id: (r.status, r.changes) for r in run(tasks.latest_states(stream), "complete", tmp_path, "latest").collect()}
    want = events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("s"), F.count("*").alias("n")).collect()
    assert got == {r.user_id: (r.s, r.n) for r in want}


def test_windows(spark, tmp_path):
    stream, events = changes(spark, tmp_path)
    got = run(tasks.windowed_counts(stream, delay="60 days"), "complete", tmp_path, "windows").agg(F.sum("n")).first()[0]
    assert got == events.count()


def test_evictions(spark, tmp_path):
    stream, events = changes(spark, tmp_path)
    rows = run(tasks.evictions(stream, ttl_seconds=3600, finished=("purchase", "error")), "update", tmp_path, "evicted").collect()
    gone = {r.task_id for r in rows if r.evicted}
    assert gone and all(r.status in ("purchase", "error") for r in rows if r.evicted)
