"""Splits that keep related records together.

Records are linked through the entities they name. Components come from parallel hooking and shortcutting over a
parent table: every round hooks roots to smaller neighbouring roots with one join and one minimum, then halves
paths by joining the table with itself, until nothing moves. A record that names several entities links them by a
star, so no pairs within a group are made. Split totals are met by subset-sum bitsets over size multiplicities:
only the histogram of component sizes (at most about sqrt(2 n) sizes) reaches the driver.

Defined results: a null record id is left out; null texts and records that name nothing are components of their
own; repeated rows change nothing; aliases that are null or hold no letter or digit name nothing; an alias of
several entities names them all; an empty table gives empty results; shares are scaled to sum to one, and equal
fits go to the split first in the table.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.pairs import bare
from tidewell.operators.skew import hot_keys, salted_join
from tidewell.session import cut, drop

HANGUL = re.compile(r"[가-힣]")


def name_key(text: str | None) -> str:
    """Case, accents and encoding made even; Korean names are compared without spaces."""
    words = re.findall(r"[^\W_]+", bare(text))
    return ("" if HANGUL.search("".join(words)) else " ").join(words)


def named_entities(records: DataFrame, aliases: DataFrame) -> DataFrame:
    """(rid, entity_id): entities that a record's text names. ``records``: rid, text; ``aliases``: alias, entity_id.

    All runs of words up to the longest alias are joined with the aliases; in Korean, all beginnings of what
    starts at a word, since endings may follow a name. The longest name at a place counts.
    """

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            k = b.alias.map(name_key)
            yield pd.DataFrame({"name": k, "words": k.map(lambda x: len(x.split())), "chars": k.map(len), "entity_id": b.entity_id})

    known = cut(aliases.where("alias is not null and entity_id is not null").select("alias", "entity_id").mapInPandas(keys, "name string, words int, chars int, entity_id string").where("name <> ''").distinct(), "names")
    most = known.agg(F.max("words"), F.max(F.when(F.col("name").rlike("[가-힣]"), F.col("chars"))), F.min(F.when(F.col("name").rlike("[가-힣]"), F.col("chars")))).first()
    longest, chars, least = most[0] or 0, most[1] or 0, most[2] or 1

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for rid, text in zip(b.rid, b.text):
                words = re.findall(r"[^\W_]+", bare(text))
                for i, w in enumerate(words):
                    if HANGUL.search(w):
                        rest = "".join(words[i : i + chars])[:chars]
                        starts = {0} | {m.end() for m in re.finditer(r"\d+[년월일]?", rest[:12]) if m.start() == 0 or rest[: m.start()].strip("0123456789년월일") == ""}
                        out += [(rid, i, rest[s : s + n]) for s in starts for n in range(least, len(rest) - s + 1)]
                    out += [(rid, i, " ".join(words[i : i + n])) for n in range(1, min(longest, len(words) - i) + 1) if not HANGUL.search(w)]
            yield pd.DataFrame(out, columns=["rid", "at", "name"])

    said = lambda rows: rows.mapInPandas(places, "rid string, at int, name string")
    texts = records.where("text is not null").select("rid", "text")
    # Which names are hot is told by one record in fifty; it only decides how the join is laid out.
    some = said(texts.where(F.pmod(F.xxhash64("rid", F.lit(11)), F.lit(50)) == 0)).join(known.select("name").distinct(), "name", "left_semi")
    found = salted_join(said(texts), known, "name", hot_keys(some, "name"), F.col("rid"))
    best = Window.partitionBy("rid", "at")
    return found.withColumn("most", F.max("chars").over(best)).where("chars = most").select("rid", "entity_id").distinct()


def components(edges: DataFrame, *, rounds: int = 60) -> DataFrame:
    """(node, root) for the nodes of ``edges`` (a, b); the root is the smallest node of its component."""
    both = cut(edges.select("a", "b").where("a <> b").distinct(), "edges")
    nodes = both.select(F.col("a").alias("node")).unionByName(both.select(F.col("b").alias("node"))).distinct()
    parent = cut(nodes.select("node", F.col("node").alias("root")), "parent")
    spark = edges.sparkSession
    for _ in range(rounds):
        pa, pb = parent.toDF("a", "ra"), parent.toDF("b", "rb")
        ends = both.join(pa, "a").join(pb, "b").where("ra <> rb")
        hooks = ends.select(F.greatest("ra", "rb").alias("root"), F.least("ra", "rb").alias("to")).groupBy("root").agg(F.min("to").alias("to"))
        hooked = parent.join(hooks, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        up = hooked.toDF("root", "top")
        short = hooked.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
        after = cut(short, "parent")
        moved = after.alias("x").join(parent.alias("y"), "node").where("x.root <> y.root").limit(1).count()
        drop(spark, parent)
        parent = after
        if not moved:
            return parent
    raise RuntimeError("components did not settle")


def record_groups(records: DataFrame, aliases: DataFrame) -> DataFrame:
    """(rid, root) for every record: ``root`` is the smallest entity of its component, or null if it names none."""
    names = cut(named_entities(records, aliases), "named")
    first = names.groupBy("rid").agg(F.min("entity_id").alias("a"))
    star = names.join(first, "rid").select("a", F.col("entity_id").alias("b"))
    roots = components(star)
    own = first.join(roots, first.a == roots.node, "left").select("rid", F.coalesce("root", "a").alias("root"))
    return records.select("rid").where("rid is not null").distinct().join(own, "rid", "left")


def subset_counts(sizes: dict[int, int], target: int) -> dict[int, int]:
    """How many components of each size to take so that their sum is closest to ``target`` (below it on a tie).

    A bitset holds the sums that can be reached; multiplicities are split into powers of two, so every size takes
    log2(multiplicity) shifts.
    """
    steps = []
    for size, many in sorted(sizes.items(), reverse=True):
        part = 1
        while many > 0:
            steps.append((size, min(part, many)))
            many -= min(part, many)
            part *= 2
    limit = (1 << (2 * target + 1)) - 1
    span = math.isqrt(len(steps)) + 1
    kept, reach = [], 1
    for i, (size, take) in enumerate(steps):
        if i % span == 0:  # the bitsets between two kept ones are made again on the way back
            kept.append(reach)
        reach = (reach | (reach << (size * take))) & limit
    best = next(target + d for k in range(target + 1) for d in (-k, k) if reach >> (target + d) & 1)
    taken: dict[int, int] = {}
    for at in range((len(kept) - 1) * span, -1, -span):
        block, before = steps[at : at + span], [kept.pop()]
        for size, take in block[:-1]:
            before.append((before[-1] | (before[-1] << (size * take))) & limit)
        for (size, take), was in zip(reversed(block), reversed(before)):
            if not was >> best & 1:
                best -= size * take
                taken[size] = taken.get(size, 0) + take
    return taken


def split_counts(hist: dict[int, int], shares: list[float], *, most: int = 1 << 22, keep: int = 64) -> list[dict[int, int]]:
    """For every split but the last, how many components of each size it takes; ``shares`` sum to one.

    The first total is as close to its share as the sizes allow, the next as close as what is left allows. Beyond
    ``most`` records, all but ``keep`` components of each size are first shared out in proportion and the largest of
    the rest go where most is missing, so that the bitsets span ``most`` at the most. That stands only if every total is
    the multiple of the sizes' common divisor that is nearest to its share, which no choice betters; else the bitsets run over all.
    """
    total = sum(s * m for s, m in hist.items())
    goals = [round(total * x) for x in shares[:-1]]

    def exact(rest: dict[int, int], goals: list[int]) -> list[dict[int, int]]:
        rest, out = dict(rest), []
        for goal in goals:
            out.append(subset_counts(rest, goal))
            for size, many in out[-1].items():
                rest[size] -= many
        return out

    if total <= most or not goals:
        return exact(hist, goals)
    unit = math.gcd(*hist)
    bulk = [{s: math.floor(max(0, m - keep) * x) for s, m in hist.items()} for x in shares]
    pool = {s: m - sum(b[s] for b in bulk) for s, m in hist.items()}
    missing = [g - sum(s * m for s, m in b.items()) for g, b in zip([*goals, total - sum(goals)], bulk)]
    left = sum(s * m for s, m in pool.items())
    for s in sorted(pool, reverse=True):
        while pool[s] and left > most:
            i = max(range(len(shares)), key=missing.__getitem__)
            bulk[i][s] += 1
            pool[s] -= 1
            missing[i] -= s
            left -= s
    if min(missing) >= 0:
        for b, more in zip(bulk, exact(pool, missing[:-1])):
            for s, m in more.items():
                b[s] += m
        if all(sum(s * m for s, m in b.items()) == unit * -((unit - 2 * g) // (2 * unit)) for g, b in zip(goals, bulk)):
            return bulk[:-1]
    return exact(hist, goals)


def assign_splits(groups: DataFrame, targets: list[tuple[str, float]], *, seed: int = 0, unit_bits: int = 22) -> DataFrame:
    """(rid, split): whole components, totals as close to the target shares as the sizes allow.

    Totals are exact at every size; ``split_counts`` says what changes beyond 2**unit_bits records.
    """
    spark = groups.sparkSession
    keyed = groups.withColumn("component", F.coalesce(F.concat(F.lit("e:"), F.col("root")), F.concat(F.lit("r:"), F.col("rid"))))
    sized = cut(keyed.groupBy("component").agg(F.count("*").alias("size")), "sizes")
    hist = {r["size"]: r["many"] for r in sized.groupBy("size").agg(F.count("*").alias("many")).collect()}
    whole = sum(max(0.0, w) for _, w in targets) or 1.0
    ordered = sorted(targets, key=lambda t: t[1])
    counts = split_counts(hist, [max(0.0, w) / whole for _, w in ordered], most=1 << unit_bits) if hist else []
    plan = [(size, name, many) for (name, _), taken in zip(ordered, counts) for size, many in taken.items() if many]
    last = ordered[-1][0] if ordered else None
    # Ranks within a size without one task for all components of that size: counts of hashed cells, then ranks inside cells.
    cells = sized.withColumn("cell", F.pmod(F.xxhash64(F.lit(seed), "component"), F.lit(1024)))
    offsets = cells.groupBy("size", "cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy("size").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select("size", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("size", "cell").orderBy(F.xxhash64(F.lit(seed + 1), "component"), "component")
    ranked = cells.withColumn("r", F.row_number().over(inside)).join(offsets, ["size", "cell"]).select("component", "size", (F.col("r") + F.col("offset")).alias("rank"))
    bounds, seen = [], {}
    for size, name, many in plan:
        low = seen.get(size, 0)
        bounds.append((size, name, low, low + many))
        seen[size] = low + many
    ranges = spark.createDataFrame(bounds, "size long, split string, low long, high long")
    placed = ranked.join(ranges.withColumnRenamed("size", "s"), (F.col("size") == F.col("s")) & (F.col("rank") > F.col("low")) & (F.col("rank") <= F.col("high")), "left")
    return keyed.join(placed.select("component", F.coalesce("split", F.lit(last)).alias("split")), "component").select("rid", "split")
