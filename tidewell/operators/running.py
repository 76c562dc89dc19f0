"""Running sums and ranks over a whole table without one task for all of it.

Rows are ranged by their order into parts; sums of the parts are carried forward (one row per part), and inside a part
a window goes on from there.

Defined results: nulls in ``value`` count as 0; ties in ``order`` are broken by the further columns the caller names;
an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.session import cut


def with_running(df: DataFrame, order: list[Column], sums: dict[str, Column], *, parts: int | None = None) -> DataFrame:
    """``df`` with, for each name, the sum of its column over all rows up to and with this one in ``order``."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = df.withColumns({f"_v_{k}": F.coalesce(c, F.lit(0)) for k, c in sums.items()})
    ranged = cut(values.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    parts_ = ranged.groupBy("_part").agg(*[F.sum(f"_v_{k}").alias(f"_s_{k}") for k in sums]).select("_part", *[F.coalesce(F.sum(f"_s_{k}").over(before), F.lit(0)).alias(f"_b_{k}") for k in sums])
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(F.broadcast(parts_), "_part")  # as many rows as parts
    return out.select(*df.columns, *[(F.sum(f"_v_{k}").over(inside) + F.col(f"_b_{k}")).alias(k) for k in sums])
