"""What changed between consecutive full snapshots.

A bucketed key-to-hash index is kept of the last delivery: one row per key, bucketed and sorted by the key, so that
probing it with the next delivery is a merge join without a shuffle. ``IndexStore`` finds it again by name in a later
session, and once probed the new index takes the old one's place. Old values are fetched for changed and removed keys
alone, again by bucket. A table that holds several deliveries is indexed in one scan, a partition per delivery.

Defined results: a null or empty key names no record and is left out; in a snapshot the row with the
latest time counts (null or NaN is earliest; between equal times the greater hash, a known one before
null); repeated rows are one record; a null hash is unknown and never makes a change; an empty table or a
single snapshot has no changes; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.session import cut, delete, scratch

KEY, HASH, TIME, SNAP = "_tw_key", "_tw_hash", "_tw_time", "_tw_snapshot"
ADDED, REMOVED, CHANGED = "added", "removed", "changed"


def latest_per_key(rows: DataFrame, key: Column, digest: Column, time: Column, snapshot: Column | None = None) -> DataFrame:
    """(snapshot, key, hash, time) with one row per key; partial aggregation makes a hot key cheap before the shuffle."""
    t = time.cast("double")
    flat = rows.select(key.alias(KEY), F.lower(digest).alias(HASH), F.when(F.isnan(t), None).otherwise(t).alias(TIME), *([snapshot.alias(SNAP)] if snapshot is not None else []))
    by = [KEY] + [SNAP] * (snapshot is not None)
    best = F.max(F.struct(TIME, HASH)).alias("best")
    return flat.where(F.coalesce(F.col(KEY), F.lit("")) != "").groupBy(*by).agg(best).select(*by, f"best.{HASH}", f"best.{TIME}")


def _buckets(spark: SparkSession, buckets: int | None) -> int:
    return buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))


def probe(old: DataFrame, new: DataFrame, *, old_values: bool = False) -> DataFrame:
    """Keys added, removed or changed between two indexes (key, hash, time) of the same buckets, with both hashes.

    With ``old_values`` the times follow: the old one is looked up for changed and removed keys alone.
    """
    was, now = old.select(F.col(KEY).alias("k_old"), F.col(HASH).alias("old_hash")), new.select(F.col(KEY).alias("k_new"), F.col(HASH).alias("new_hash"), *([F.col(TIME).alias("new_time")] if old_values else []))
    kind = F.when(F.col("k_old").isNull(), ADDED).when(F.col("k_new").isNull(), REMOVED).when(F.col("old_hash") != F.col("new_hash"), CHANGED)
    both = was.hint("merge").join(now, F.col("k_old") == F.col("k_new"), "full")
    found = both.select(F.coalesce("k_new", "k_old").alias("key"), kind.alias("change"), "old_hash", "new_hash", "k_old", *(["new_time"] if old_values else [])).where("change is not null")
    if not old_values:
        return found.drop("k_old")
    times = old.select(F.col(KEY).alias("k"), F.col(TIME).alias("old_time"))
    gone = found.where(F.col("change") != ADDED).hint("merge").join(times, F.col("k_old") == F.col("k"))
    order = ["key", "change", "old_hash", "new_hash", "old_time", "new_time"]
    return gone.select(*order).unionByName(found.where(F.col("change") == ADDED).withColumn("old_time", F.lit(None).cast("double")).select(*order))


class IndexStore:
    """The kept index of the last delivery of a table: ``path``/``name``/v<number>, the greatest number counts."""

    def __init__(self, spark: SparkSession, path: str, name: str, *, buckets: int = 64):
        self.spark, self.root, self.name, self.buckets = spark, f"{path}/{name}", name, buckets

    def _versions(self) -> list[int]:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
        # A version counts once it was written to the end.
        return sorted(int(n[1:]) for n in names if n[1:].isdigit() and fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{n}/_SUCCESS")))

    def _table(self, version: int) -> DataFrame:
        made = f"tidewell_{uuid.uuid4().hex}"  # a name in this session's catalog for what lies in the folder
        self.spark.sql(f"create table {made} ({KEY} string, {HASH} string, {TIME} double) using parquet clustered by ({KEY}) sorted by ({KEY}) into {self.buckets} buckets location '{self.root}/v{version}'")
        return self.spark.table(made)

    def last(self) -> DataFrame | None:
        """(key, hash, time) of the last delivery, or None before the first."""
        known = self._versions()
        return self._table(known[-1]) if known else None

    def deliver(self, rows: DataFrame, key: Column, digest: Column, time: Column, *, old_values: bool = False) -> DataFrame:
        """Changes from the last delivery to ``rows``, whose index then takes the old one's place; the first delivery only adds."""
        known = self._versions()
        number, made = (known[-1] if known else 0) + 1, f"tidewell_{uuid.uuid4().hex}"
        latest = latest_per_key(rows, key, digest, time)
        latest.select(KEY, HASH, TIME).repartition(self.buckets, KEY).write.format("parquet").bucketBy(self.buckets, KEY).sortBy(KEY).option("path", f"{self.root}/v{number}").saveAsTable(made)
        new = self.spark.table(made)
        old = self.last_before(number) if known else new.limit(0)
        found = cut(probe(old, new, old_values=old_values), "changes")
        for n in known:
            delete(self.spark, f"{self.root}/v{n}")
        return found

    def last_before(self, number: int) -> DataFrame:
        return self._table(max(n for n in self._versions() if n < number))


def snapshot_changes(rows: DataFrame, snapshot: str, key: Column, digest: Column, time: Column, *, old_values: bool = False, buckets: int | None = None) -> DataFrame:
    """Changes between the consecutive snapshots that one table holds, in the order of the ``snapshot`` column's values.

    Gives ``snapshot`` (the later one), ``key``, ``change`` and both hashes, with ``old_values`` also both times. All
    snapshots are indexed in one scan; the index is dropped once its changes are written.
    """
    spark = rows.sparkSession
    n, name, path = _buckets(spark, buckets), f"tidewell_index_{uuid.uuid4().hex}", scratch(spark, "index")
    latest = latest_per_key(rows.where(F.col(snapshot).isNotNull()), key, digest, time, F.col(snapshot).cast("string"))
    latest.repartition(n, KEY).write.format("parquet").partitionBy(SNAP).bucketBy(n, KEY).sortBy(KEY).option("path", path).saveAsTable(name)
    index = spark.table(name)
    runs = [r[0] for r in index.select(SNAP).distinct().orderBy(SNAP).collect()]  # one value per delivery
    of = {run: index.where(F.col(SNAP) == F.lit(run)).drop(SNAP) for run in runs}
    out = [probe(of[a], of[b], old_values=old_values).select(F.lit(b).alias("snapshot"), "*") for a, b in zip(runs, runs[1:])]
    schema = "snapshot string, key string, change string, old_hash string, new_hash string" + ", old_time double, new_time double" * old_values
    found = cut(reduce(DataFrame.unionByName, out), "changes") if out else spark.createDataFrame([], schema)
    spark.sql(f"drop table {name}")
    delete(spark, path)
    return found
