from pyspark.sql import functions as F

from tidewell.plans.streams import event_windows
from tidewell.session import scratch
from tidewell.streaming.tables import run_to_table, stream_of, upsert_latest, windowed_counts


def test_upsert_takes_the_latest_over_batches(spark):
    path = scratch(spark, "up")
    for rows in ([("a", 1, 3), ("b", 2, 9), (None, 1, 1)], [("a", 5, 1), ("b", 1, 1)], [("c", 1, None), ("a", 5, 0)]):
        spark.createDataFrame(rows, "k string, t int, v int").coalesce(1).write.mode("append").parquet(path)
    out = upsert_latest(stream_of(spark, path), ["k"], F.col("t")).collect()
    assert {r.k: (r.t, r.v) for r in out} == {"a": (5, 1), "b": (2, 9), "c": (1, None)}


def test_windows_close_behind_the_watermark(spark):
    path = scratch(spark, "win")
    rows = [("2024-01-01 00:05:00", "x", 1.0), ("2024-01-01 00:50:00", "x", 2.0), ("2024-01-01 01:30:00", "x", 4.0), ("2024-01-01 03:00:00", "y", 8.0)]
    spark.createDataFrame(rows, "ts string, kind string, value double").coalesce(1).write.parquet(path)
    e = stream_of(spark, path).select(F.to_timestamp("ts").alias("ts"), "kind", "value")
    out = run_to_table(windowed_counts(e, F.col("ts"), ["kind"])).collect()
    assert sorted((r.kind, r.n, r.total) for r in out) == [("x", 1, 4.0), ("x", 2, 3.0)]


def test_event_windows_do_not_depend_on_files(spark):
    d = scratch(spark, "events")
    for ts in ("2024-01-01 09:30:00", "2024-01-01 01:10:00", "2024-01-01 05:20:00", "2024-01-01 01:40:00"):
        spark.createDataFrame([(ts, "x", 1.0)], "ts string, event_type string, value double").coalesce(1).write.mode("append").parquet(f"{d}/events.parquet")
    out = event_windows(spark, d).collect()
    assert sorted((r.start, r.n) for r in out) == [("2024-01-01 01:00", 2), ("2024-01-01 05:00", 1)]
