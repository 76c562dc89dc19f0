"""Queries that run as streams over what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.urls import canonical_url
from tidewell.plans.etl import SQL as ETL_SQL
from tidewell.session import scratch, table
from tidewell.streaming.tables import run_to_table, stream_of, upsert_latest, windowed_counts


def latest_page_stream(spark: SparkSession, d: str) -> DataFrame:
    """The latest row of each page, merged delivery by delivery: the deliveries land as folders of files, a few files to a batch."""
    landing = scratch(spark, "landing")
    table(spark, d, "l3_cache").select("canonical_url", "row_id", "run_id", "fetched_at").repartition("run_id").write.parquet(landing)
    rows = stream_of(spark, landing).select(canonical_url("canonical_url").alias("page"), "row_id", "run_id", F.coalesce("fetched_at", F.lit(float("-inf"))).alias("t")).where("page <> ''")
    return upsert_latest(rows, ["page"], F.struct("t", "row_id")).select("page", "row_id", "run_id")


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Hourly events per type; windows that the watermark has not closed yet are not out. All files are one batch, so none is late for another."""
    e = stream_of(spark, f"{d}/events.parquet", files=None).select("event_type", "value", F.col("ts").cast("timestamp").alias("ts"))
    return run_to_table(windowed_counts(e, F.col("ts"), ["event_type"])).select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


QUERIES = {"str_latest_page": latest_page_stream, "str_event_windows": event_windows}
SQL = {
    "str_latest_page": ETL_SQL["etl_latest_page"],
    "str_event_windows": """
with g as (select date_trunc('hour', ts) as s, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2)
select strftime(s, '%Y-%m-%d %H:%M') as start, event_type, n, total from g where s + interval 1 hour <= (select max(ts) from events) - interval 10 minute""",
}
