"""Queries on the deliveries of ``l3_cache``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.urls import canonical_url
from tidewell.operators.snapshot_diff import snapshot_changes
from tidewell.session import table


def _changes(spark: SparkSession, sf_dir: str, old_values: bool) -> DataFrame:
    rows = table(spark, sf_dir, "l3_cache").select("run_id", "canonical_url", "content_hash", "fetched_at")
    return snapshot_changes(rows, "run_id", canonical_url("canonical_url"), F.col("content_hash"), F.col("fetched_at"), old_values=old_values)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir, False).select(F.col("snapshot").alias("run_id"), F.col("key").alias("canonical_url"), "change")


def p1_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir, True).withColumnsRenamed({"snapshot": "run_id", "key": "canonical_url", "old_time": "old_fetched_at", "new_time": "new_fetched_at"})


CANONICAL_SQL = r"""
  regexp_replace(regexp_replace(
    regexp_replace(split_part(lower(trim(canonical_url)), '#', 1), '([?&])(?:(?:utm_|ref=|source=|fbclid=)[^&]*&?)+', '\1', 'g'),
    '[?&]+$', ''), '/+$', '')"""

_LATEST = f"""
with page as (select run_id, {CANONICAL_SQL} as canonical_url, lower(content_hash) as h, fetched_at from l3_cache),
latest as (select run_id, canonical_url, h, fetched_at from (
  select *, row_number() over (partition by run_id, canonical_url order by fetched_at desc nulls last, h desc nulls last) as n
  from page where canonical_url <> '') where n = 1),
runs as (select run_id, lag(run_id) over (order by run_id) as before from (select distinct run_id from l3_cache)),
now as (select r.before, l.* from latest l join runs r using (run_id) where r.before is not null),
was as (select r.run_id as after, l.* from latest l join runs r on r.before = l.run_id),
diff as (
  select coalesce(n.run_id, w.after) as run_id, coalesce(n.canonical_url, w.canonical_url) as canonical_url,
    case when w.run_id is null then 'added' when n.run_id is null then 'removed' when n.h <> w.h then 'changed' end as change,
    w.h as old_hash, n.h as new_hash, w.fetched_at as old_fetched_at, n.fetched_at as new_fetched_at
  from now n full join was w on n.run_id = w.after and n.canonical_url = w.canonical_url)
"""

QUERIES = {"p1_found": p1_found, "p1_changes": p1_changes}
SQL = {
    "p1_found": _LATEST + "select run_id, canonical_url, change from diff where change is not null",
    "p1_changes": _LATEST + "select run_id, canonical_url, change, old_hash, new_hash, old_fetched_at, new_fetched_at from diff where change is not null",
}
