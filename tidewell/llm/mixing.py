"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

The mix is a number of equal blocks of tokens, many to a shard of the records. Blocks go to sources by the highest
quotients share / (2 * blocks held + 1); a source that has used up its tokens times its cap drops out and the others
go on. Each source's blocks are apportioned the same way to its shards by their tokens, giving integer quotas per
shard; inside a shard, whole passes over all its records come first and a seeded choice of records fills the rest.

The highest quotients are those above one bar, so a part of weight w holds round(w * divisor) blocks, up to its cap,
and only the divisor is searched: on the driver for the few sources, by sums over all shards for a source's shards.
Shards never reach the driver.

Defined results: records of sources without target are used 0 times; targets without records get nothing, which the
report shows; null sources are the source ""; records without tokens or id are used 0 times;
rows that repeat an id are one record, the longest; without ``total`` the mix is
the largest in which every source that has tokens can hold its share; an empty table gives no rows; more than
``MOST_TARGETS`` targets are refused.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.session import cut

MOST_TARGETS = 1000
STEPS = 64  # divisors tried in one pass over the shards


def sainte_lague(weights: list[float], seats: int, caps: list[int] | None = None) -> list[int]:
    """Seats per weight by highest quotients; ties go to the first; nobody gets more than the cap.

    All seats above a bar that surely holds too few are given at once, the last ones by their quotients.
    """
    most = caps or [seats] * len(weights)
    whole = sum(w for w, c in zip(weights, most) if w > 0 and c > 0)
    start = max(0.0, (seats - len(weights)) / whole) if whole else 0.0
    held = [min(c, int(w * start)) if w > 0 else 0 for w, c in zip(weights, most)]
    heap = [(-w / (2 * h + 1), i) for i, (w, h, c) in enumerate(zip(weights, held, most)) if w > 0 and h < c]
    heapq.heapify(heap)
    for _ in range(seats - sum(held)):
        if not heap:
            break
        _, i = heapq.heappop(heap)
        held[i] += 1
        if held[i] < most[i]:
            heapq.heappush(heap, (-weights[i] / (2 * held[i] + 1), i))
    return held


def apportion_shards(shards: DataFrame, seats: dict[str, int]) -> DataFrame:
    """``shards`` (source, shard, t, cap) with ``q``: the source's ``seats`` by highest quotients of ``t``, no more than ``cap``.

    Of equal quotients at the bar the smaller shards' numbers go first.
    """
    names = sorted(seats)
    of = lambda values: F.create_map(*[v for s in names for v in (F.lit(s), F.lit(values[s]))])[F.col("source")]
    held = lambda d: F.least(F.col("cap").cast("double"), F.floor(F.col("t") * d + 0.5).cast("double"))
    ends = shards.groupBy("source").agg(F.max((F.col("cap") + 1.0) / F.col("t")).alias("high"), F.sum("cap").alias("caps"), F.sum("t").alias("t")).collect()  # one row per target source
    high = {r["source"]: float(r["high"]) for r in ends}
    low = {r["source"]: 0.0 for r in ends}
    want = {s: min(float(seats[s]), float(r["caps"])) for r in ends for s in [r["source"]]}
    names = [s for s in names if s in low]
    for _ in range(9 if names else 0):  # STEPS ** 9 is beyond a double's precision
        step = {s: (high[s] - low[s]) / STEPS for s in names}
        sums = shards.groupBy("source").agg(*[F.sum(held(of(low) + of(step) * i)).alias(f"s{i}") for i in range(1, STEPS)]).collect()
        for r in sums:
            s = r["source"]
            under = sum(r[f"s{i}"] <= want[s] for i in range(1, STEPS))  # the sums grow with the divisor
            low[s], high[s] = low[s] + under * step[s], low[s] + (under + 1) * step[s]
    if not names:
        return shards.withColumn("q", F.lit(0.0))
    base = cut(shards.withColumn("q", held(of(low))).withColumn("more", held(of(high)) - F.col("q")), "quotas")
    given = {r["source"]: r["q"] for r in base.groupBy("source").agg(F.sum("q").alias("q")).collect()}
    extra = None
    for s in names:
        left = int(want[s] - given[s])
        if left > 0:
            tied = base.where((F.col("source") == s) & (F.col("more") > 0)).orderBy("shard").limit(left).select("source", "shard", F.lit(1.0).alias("x"))
            extra = tied if extra is None else extra.unionByName(tied)
    if extra is None:
        return base.drop("more")
    return base.join(extra, ["source", "shard"], "left").select("source", "shard", "t", "cap", (F.col("q") + F.coalesce("x", F.lit(0.0))).alias("q"))


def mix(records: DataFrame, targets: DataFrame, *, total: int | None = None, per_block: float = 50.0, least_blocks: int = 20_000, seed: int = 0, per_shard: int = 50_000) -> DataFrame:
    """(id, source, tokens, uses). ``records``: id, source, tokens; ``targets``: source, target_share, max_repeats.

    The mix has ``per_block`` blocks per shard, and ``least_blocks`` at least, so that rounding to blocks stays small at every size.
    """
    listed = targets.limit(MOST_TARGETS + 1).collect()
    if len(listed) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    goals = {r["source"]: (max(0.0, r["target_share"] or 0.0), max(0, r["max_repeats"] or 0)) for r in listed}
    flat = records.select("id", F.struct(F.coalesce("tokens", F.lit(0)).alias("tokens"), F.lower(F.trim(F.coalesce("source", F.lit("")))).alias("source")).alias("r"))
    known = cut(flat.groupBy("id").agg(F.max("r").alias("r")).select("id", "r.source", "r.tokens"), "sized")
    usable = known.where(F.col("source").isin(list(goals)) & (F.col("tokens") > 0) & F.col("id").isNotNull())
    sums = {r["source"]: (r["n"], r["t"]) for r in usable.groupBy("source").agg(F.count("*").alias("n"), F.sum("tokens").alias("t")).collect()}
    have = [s for s in sorted(goals) if s in sums and goals[s][0] > 0 and goals[s][1] > 0]
    if not have:
        return known.withColumn("uses", F.lit(0))
    whole = sum(goals[s][0] for s in have)
    if total is None:
        total = int(min(sums[s][1] * goals[s][1] / (goals[s][0] / whole) for s in have))
    count = {s: max(1, sums[s][0] // per_shard) for s in have}
    blocks = min(total, max(least_blocks, int(per_block * sum(count.values()))))
    size = max(1.0, total / max(1, blocks))
    quota = dict(zip(have, sainte_lague([goals[s][0] for s in have], blocks, [int(sums[s][1] * goals[s][1] / size) + 1 for s in have])))

    of = lambda values: F.create_map(*[v for s in have for v in (F.lit(s), F.lit(values[s]))])[F.col("source")]
    dealt = usable.where(F.col("source").isin(have)).withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "id"), of(count)))
    repeats = of({s: goals[s][1] for s in have})
    shards = cut(dealt.groupBy("source", "shard").agg(F.sum("tokens").alias("t")).withColumn("cap", F.floor(F.col("t") * repeats / size) + 1), "shards")
    tokens = F.least(F.col("q") * size, (F.col("t") * repeats).cast("double"))
    quotas = apportion_shards(shards, quota).select("source", "shard", F.floor(tokens / F.col("t")).cast("int").alias("passes"), (tokens - F.floor(tokens / F.col("t")) * F.col("t")).alias("rest"))
    used = dealt.join(quotas, ["source", "shard"]).groupBy("source", "shard").applyInPandas(_choose(seed + 1), "id long, u int")
    return known.join(used, "id", "left").select("id", "source", "tokens", F.coalesce("u", F.lit(0)).alias("uses"))


def _choose(seed: int):
    """Uses of one shard's records: whole passes, then records in seeded order that fit, then the one that fits the rest best."""

    def one(b: pd.DataFrame) -> pd.DataFrame:
        order = pd.util.hash_array(b["id"].to_numpy(dtype="int64"), hash_key=f"{seed:016d}")
        b = b.assign(_o=order).sort_values(["_o", "id"])
        rest, more = float(b["rest"].iloc[0]), [0] * len(b)
        sizes = b["tokens"].tolist()
        for i, t in enumerate(sizes):
            if t <= rest:
                more[i], rest = 1, rest - t
        last = min((i for i, m in enumerate(more) if not m), key=lambda i: abs(sizes[i] - rest), default=None)
        if last is not None and abs(sizes[last] - rest) < rest:
            more[last] = 1
        return pd.DataFrame({"id": b["id"], "u": b["passes"].to_numpy() + more})

    return one
