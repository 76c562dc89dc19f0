"""Backward as-of join: the last version at or before each request.

Versions and requests are put in time order per key. So that a key with a third of all rows is no single task, time
is cut into buckets: the last version of each (key, bucket) is carried forward over the few buckets of a key, and
rows are ordered only inside their bucket.

Defined results: a null key or time meets nothing and keeps null; between versions of equal time the greater value
counts; a version at the request's own time counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_last(requests: DataFrame, versions: DataFrame, *, key: str, time: str, value: str, bucket_seconds: float = 3600.0) -> DataFrame:
    """``requests`` with ``<value>`` and ``asof_time`` of the last version of ``key`` at or before ``time`` (seconds)."""
    v = versions.select(F.col(key).alias("_k"), F.col(time).cast("double").alias("_t"), F.struct(F.col(time).cast("double").alias("t"), F.col(value).alias("v")).alias("_v"), F.lit(0).alias("_kind")).where("_k is not null and _t is not null")
    r = requests.withColumns({"_k": F.col(key), "_t": F.col(time).cast("double"), "_kind": F.lit(1)})
    whole = r.select(*requests.columns, "_k", "_t", "_kind", F.lit(None).cast(v.schema["_v"].dataType).alias("_v")).unionByName(v, allowMissingColumns=True)
    whole = whole.withColumn("_b", F.floor(F.col("_t") / bucket_seconds))
    last = whole.where("_kind = 0").groupBy("_k", "_b").agg(F.max("_v").alias("_last"))
    slots = whole.where("_k is not null and _t is not null").select("_k", "_b").distinct().join(last, ["_k", "_b"], "left")
    over = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = slots.select("_k", "_b", F.max("_last").over(over).alias("_before"))
    inside = Window.partitionBy("_k", "_b").orderBy("_t", "_kind", "_v").rowsBetween(Window.unboundedPreceding, 0)
    seen = whole.withColumn("_now", F.max("_v").over(inside)).where("_kind = 1").join(carried, ["_k", "_b"], "left")
    best = F.when(F.col("_k").isNotNull() & F.col("_t").isNotNull(), F.coalesce("_now", "_before"))
    return seen.withColumn("_best", best).select(*requests.columns, F.col("_best.v").alias(value), F.col("_best.t").alias("asof_time"))
