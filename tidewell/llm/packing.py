"""Filling fixed-capacity containers by hierarchical residual packing.

Items are dealt to partitions of a bounded number of items and packed best-fit decreasing in each. Containers that
are nearly full are emitted; the others become items themselves, are dealt anew to fewer partitions and packed
again, up a tree, until one partition holds what is left or a round saves less than ``saving`` of its containers
(every round deals anew, so what did not meet in one may meet in the next). No task sees many more than ``per_task``
items. A round that goes on leaves at most (1 - ``saving``) of the containers, so the number of rounds is bounded by
the logarithm of the items.

An item longer than the capacity is cut into full pieces and a rest; all others stay whole.

Defined results: items of size 0 or null take no room and have no container (null); equal sizes are packed in the
order of their ids; rows that repeat an id are items of their own; an empty table gives no rows; a null
capacity or one below 1 gives no rows; more than ``MOST_LIMITS`` container sizes are refused.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.session import cut, drop

MOST_LIMITS = 1000
BIN = "packing string, capacity int, bin string, fill int, members array<struct<id:bigint,piece:int,size:int>>"


def best_fit(sizes: list[int], capacity: int) -> list[int]:
    """Container numbers, best-fit decreasing."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    room: list[tuple[int, int]] = []  # (free room, container), sorted
    out, n = [0] * len(sizes), 0
    for i in order:
        at = bisect_left(room, (sizes[i], -1))
        if at < len(room):
            free, c = room.pop(at)
        else:
            free, c, n = capacity, n, n + 1
        out[i] = c
        if free - sizes[i] > 0:
            insort(room, (free - sizes[i], c))
    return out


def _packer(r: int):
    """Packs one partition of round ``r``."""

    def one(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["fill", "bin"], kind="stable", ascending=[False, True])
        capacity = int(b["capacity"].iloc[0])
        bins: dict[int, tuple[int, list]] = {}
        for c, fill, members in zip(best_fit(b["fill"].tolist(), capacity), b["fill"], b["members"]):
            n, held = bins.get(c, (0, []))
            bins[c] = (n + int(fill), held + list(members))
        rows = [(key[0], capacity, f"{r}-{key[1]}-{c}", n, held) for c, (n, held) in bins.items()]
        return pd.DataFrame(rows, columns=["packing", "capacity", "bin", "fill", "members"])

    return one


def _sizes(limits: DataFrame):
    """The container sizes as an array column: a small table of checked size, read once."""
    rows = limits.where("capacity >= 1").select("packing", "capacity").distinct().limit(MOST_LIMITS + 1).collect()
    if len(rows) > MOST_LIMITS:
        raise ValueError(f"more than {MOST_LIMITS} container sizes")
    made = [F.struct(F.lit(r["packing"]).alias("packing"), F.lit(r["capacity"]).cast("int").alias("capacity")) for r in sorted(rows, key=lambda r: (str(r["packing"]), r["capacity"]))]
    return F.array(*made) if made else F.expr("cast(array() as array<struct<packing:string,capacity:int>>)")


def pieces(items: DataFrame, limits: DataFrame) -> DataFrame:
    """(packing, capacity, id, piece, size): items whole or, beyond the capacity, cut into full pieces and a rest."""
    each = items.where("size > 0").select("id", "size", F.explode(_sizes(limits)).alias("l")).select("l.*", "id", "size")
    n = F.ceil(F.col("size") / F.col("capacity")).cast("int")
    cutted = each.select("packing", "capacity", "id", "size", F.explode(F.sequence(F.lit(0), n - 1)).alias("piece"))
    return cutted.select("packing", "capacity", "id", "piece", F.least(F.col("capacity"), F.col("size") - F.col("piece") * F.col("capacity")).cast("int").alias("size"))


def pack(items: DataFrame, limits: DataFrame, *, full: float = 0.995, per_task: int = 20_000, saving: float = 0.001) -> DataFrame:
    """(packing, id, piece, size, container). ``items``: id, size; ``limits``: packing, capacity."""
    items = cut(items.select("id", "size"), "items")
    spark = items.sparkSession
    whole = pieces(items, limits)
    open_ = cut(whole.select("packing", "capacity", F.concat_ws("-", F.lit("i"), "id", "piece").alias("bin"), F.col("size").alias("fill"), F.array(F.struct("id", "piece", "size")).alias("members")), "open")
    done, r = [], 0
    while counts := {x["packing"]: x["count"] for x in open_.groupBy("packing").count().collect()}:  # one row per packing
        parts = {k: max(1, -(-n // per_task)) for k, n in counts.items()}
        share = F.create_map(*[v for k, n in parts.items() for v in (F.lit(k), F.lit(n))])[F.col("packing")]
        dealt = open_.withColumn("part", F.pmod(F.xxhash64(F.lit(r), "bin"), share))
        packed = cut(dealt.groupBy("packing", "part").applyInPandas(_packer(r), BIN), "packed")
        drop(spark, open_)
        if max(parts.values()) == 1 or packed.count() > (1 - saving) * sum(counts.values()):
            done.append(packed)
            break
        nearly = F.col("fill") >= F.col("capacity") * full
        done.append(packed.where(nearly))
        open_, r = cut(packed.where(~nearly), "open"), r + 1
    if not done:
        return whole.select("packing", "id", "piece", "size", F.lit(None).cast("string").alias("container"))
    bins = done[0]
    for d in done[1:]:
        bins = bins.unionByName(d)
    placed = bins.select("packing", F.col("bin").alias("container"), F.explode("members").alias("m")).select("packing", "m.id", "m.piece", "m.size", "container")
    none = items.where("size is null or size <= 0").select("id", F.explode(_sizes(limits)).alias("l")).select("l.packing", "id", F.lit(0).alias("piece"), F.lit(0).alias("size"), F.lit(None).cast("string").alias("container"))
    return placed.unionByName(none)
