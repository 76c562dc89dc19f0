"""Guards on rewordings, paired arms, thresholds, samples by size, list depths and further sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.operators.running import with_running
from tidewell.plans.stats import _LABELS, _int, _labels
from tidewell.session import scratch, table

NEGATION = r"\b(not|no|never|without|except)\b|n't\b"
# The kind of answer a question asks for; the first that fits counts.
KINDS = (("count", "how many|how much|몇 명|몇 개"), ("person", "^who|누구"), ("place", "where|which town|어디"), ("time", "when|which year|어느 해|언제"), ("value", "price|revenue|loss|level|temperature|얼마|몇 도"))


def guards(spark: SparkSession, d: str) -> DataFrame:
    """Rewordings whose numbers or negation differ from their base question, per class."""
    p = table(spark, d, "paraphrase_clusters").where("query is not null").select("query_id", "base_query_id", "query", "is_paraphrase", "freshness_class").distinct()
    numbers = lambda c: F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit("[0-9]+"), 0)))
    b = p.where("not is_paraphrase").select("base_query_id", F.col("query").alias("base"))
    j = p.where("is_paraphrase").join(b, "base_query_id")
    flip = F.lower("query").rlike(NEGATION) != F.lower("base").rlike(NEGATION)
    return j.groupBy("freshness_class").agg(F.count("*").alias("n"), F.sum(_int(numbers(F.col("query")) != numbers(F.col("base")))).alias("numbers_differ"), F.sum(_int(flip)).alias("negation_differs"))


def answer_kinds(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "queries").where("query is not null").select("query_id", "query", "language").distinct()
    kind = F.coalesce(*[F.when(F.lower("query").rlike(k), name) for name, k in KINDS], F.lit("other"))
    return q.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def paired_cells(spark: SparkSession, d: str) -> DataFrame:
    """Both judge files as two arms over all items: agreement cells of a full outer join."""
    arm = lambda prefix, name: _labels(spark, d).where(F.col("judge").startswith(prefix)).groupBy("q", "gold", "ans").agg(F.max("wrong").alias(name))
    a, b = arm("llama", "a").alias("x"), arm("qwen", "b").alias("y")
    on = F.col("x.q").eqNullSafe(F.col("y.q")) & F.col("x.gold").eqNullSafe(F.col("y.gold")) & F.col("x.ans").eqNullSafe(F.col("y.ans"))
    cell = F.when(F.col("a").isNull(), "only_b").when(F.col("b").isNull(), "only_a").when(F.col("a") == F.col("b"), F.when(F.col("a") == 1, "both_wrong").otherwise("both_right")).otherwise("differ")
    return a.join(b, on, "full").groupBy(cell.alias("cell")).agg(F.count("*").alias("n"))


def youden(spark: SparkSession, d: str) -> DataFrame:
    """For each judge, the threshold on the share of the other judges saying INCORRECT that best tells its verdict; ties to the smaller.

    Counts per grid value and running sums, not a product of the grid with the labels.
    """
    lab = _labels(spark, d)
    item = lab.groupBy("q", "gold", "ans").agg(F.sum("wrong").alias("w"), F.count("*").alias("k")).where("k > 1")
    on = ["q", "gold", "ans"]
    share = (F.col("w") - F.col("wrong")) / (F.col("k") - 1)
    g = lab.join(item, on).groupBy("judge", F.ceil(F.round(share * 100, 6)).alias("cut")).agg(F.sum("wrong").alias("p"), F.sum(1 - F.col("wrong")).alias("n"))
    own = Window.partitionBy("judge")
    above = own.orderBy(F.desc("cut")).rowsBetween(Window.unboundedPreceding, 0)  # at most 101 grid values per judge
    r = g.withColumn("tp", F.sum("p").over(above)).withColumn("fp", F.sum("n").over(above)).withColumn("all_p", F.sum("p").over(own)).withColumn("all_n", F.sum("n").over(own))
    j = r.withColumn("youden", F.round(F.col("tp") / F.col("all_p") - F.col("fp") / F.col("all_n"), 6))
    return j.groupBy("judge").agg(F.max(F.struct("youden", (-F.col("cut")).alias("c"))).alias("b")).select("judge", (-F.col("b.c") / 100).alias("threshold"), "b.youden")


def size_sample(spark: SparkSession, d: str) -> DataFrame:
    """Systematic sample of 20 customers in proportion to their order totals, in key order."""
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("size"))
    whole = o.agg(F.sum("size").alias("whole"))
    r = with_running(o, [F.col("o_custkey")], {"upto": F.col("size")}).crossJoin(whole).withColumn("step", F.expr("whole div 20"))
    return r.where("upto div step > (upto - size) div step").select("o_custkey", "size", "upto")


def depths(spark: SparkSession, d: str) -> DataFrame:
    """Known changes among the first 2, 5 and 10 results of the lists of each round."""
    m = table(spark, d, "url_manifest").select("run_id", "query_id", "rank", "url_hash", "changed").distinct()
    x = m.select("run_id", "query_id", "rank", "changed", F.explode(F.array(F.lit(2), F.lit(5), F.lit(10))).alias("depth")).where("rank <= depth")
    q = x.groupBy("run_id", "depth", "query_id").agg(F.max(_int(F.coalesce("changed", F.lit(False)))).alias("any"), F.count("changed").alias("known"))
    return q.groupBy("run_id", "depth").agg(F.count("*").alias("n"), F.sum("any").alias("n_changed"), F.sum("known").alias("known"))


def best_under_cost(spark: SparkSession, d: str) -> DataFrame:
    """Per part type the cheapest supplier among those within 5 % of the type's greatest volume, by ordered tie-breaks."""
    li = table(spark, d, "lineitem").join(table(spark, d, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    g = li.groupBy("p_type", "l_suppkey").agg(F.sum("l_quantity").alias("volume"), F.round(F.sum("l_extendedprice") / F.sum("l_quantity"), 4).alias("unit_price"))
    near = g.withColumn("top", F.max("volume").over(Window.partitionBy("p_type"))).where("volume >= 0.95 * top")
    order = Window.partitionBy("p_type").orderBy("unit_price", F.desc("volume"), "l_suppkey")
    return near.withColumn("n", F.row_number().over(order)).where("n = 1").select("p_type", "l_suppkey", "volume", "unit_price")


def tsv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Aliases written as tab-separated values and read back with a schema."""
    a = table(spark, d, "entity_aliases")
    path = scratch(spark, "tsv")
    a.write.option("sep", "\t").option("header", True).csv(path)
    return spark.read.schema(a.schema).option("sep", "\t").option("header", True).csv(path).groupBy("lang").agg(F.count("*").alias("n"), F.countDistinct("entity_id").alias("n_entities"))


def expired(spark: SparkSession, d: str) -> DataFrame:
    """Rows kept and deleted by age, a day before the last fetch, per round."""
    t = table(spark, d, "l3_cache").where("fetched_at is not null").select("run_id", "fetched_at")
    last = t.agg(F.max("fetched_at").alias("last"))
    return t.crossJoin(F.broadcast(last)).groupBy("run_id").agg(F.sum(_int(F.col("fetched_at") >= F.col("last") - 86400)).alias("kept"), F.sum(_int(F.col("fetched_at") < F.col("last") - 86400)).alias("deleted"))


def prior_exposure(spark: SparkSession, d: str) -> DataFrame:
    """Events whose type the same user had in any earlier event: all but the first of a user and type, so a count does."""
    e = table(spark, d, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    return e.groupBy("event_type").agg(F.sum("n").alias("n"), F.sum(F.col("n") - 1).alias("n_exposed"))


def recent_exposure(spark: SparkSession, d: str) -> DataFrame:
    """Events whose user had the same type among the last 5,000 events of all users (a bounded frame).

    Places come from running counts over ranged parts; the event before of a user and type is the only one to look at.
    """
    e = with_running(table(spark, d, "events").select("event_id", "ts", "user_id", "event_type"), [F.col("ts"), F.col("event_id")], {"place": F.lit(1)})
    before = F.lag("place").over(Window.partitionBy("user_id", "event_type").orderBy("place"))
    return e.withColumn("gap", F.col("place") - before).groupBy("event_type").agg(F.count("*").alias("n"), F.sum(_int(F.coalesce(F.col("gap") <= 5000, F.lit(False)))).alias("n_exposed"))


_NUM = "list_sort(list_distinct(regexp_extract_all({0}, '[0-9]+')))"
_NEG = r"regexp_matches(lower({0}), '\b(not|no|never|without|except)\b|n''t\b')"
QUERIES = {
    "fn_guards": guards, "fn_answer_kinds": answer_kinds, "join_paired_cells": paired_cells, "st_youden": youden, "smp_by_size": size_sample, "etl_depths": depths,
    "op_best_under_cost": best_under_cost, "src_tsv_round_trip": tsv_round_trip, "etl_expired": expired, "win_prior_exposure": prior_exposure, "win_recent_exposure": recent_exposure,
}
SQL = {
    "fn_guards": f"""
with p as (select distinct query_id, base_query_id, query, is_paraphrase, freshness_class from paraphrase_clusters where query is not null),
j as (select p.freshness_class, p.query as q, b.query as b from p join (select distinct base_query_id, query, query_id, freshness_class from p where not is_paraphrase) b on b.base_query_id = p.base_query_id where p.is_paraphrase)
select freshness_class, count(*) as n, sum(({_NUM.format("q")} <> {_NUM.format("b")})::int) as numbers_differ, sum(({_NEG.format("q")} <> {_NEG.format("b")})::int) as negation_differs from j group by 1""",
    "fn_answer_kinds": "select case " + " ".join(f"when regexp_matches(lower(query), '{k}') then '{n}'" for n, k in KINDS) + " else 'other' end as kind, count(*) as n from (select distinct query_id, query, language from queries where query is not null) group by 1",
    "join_paired_cells": f"""
with {_LABELS}, a as (select q, gold, ans, max(wrong) as a from lab where judge like 'llama%' group by 1, 2, 3), b as (select q, gold, ans, max(wrong) as b from lab where judge like 'qwen%' group by 1, 2, 3)
select case when a is null then 'only_b' when b is null then 'only_a' when a = b then case when a = 1 then 'both_wrong' else 'both_right' end else 'differ' end as cell, count(*) as n
from a full join b on a.q is not distinct from b.q and a.gold is not distinct from b.gold and a.ans is not distinct from b.ans group by 1""",
    "st_youden": f"""
with {_LABELS}, i as (select q, gold, ans, sum(wrong) as w, count(*) as k from lab group by 1, 2, 3 having count(*) > 1), j as (select judge, ceil(round((w - wrong) / (k - 1) * 100, 6)) as s, wrong from lab join i using (q, gold, ans)),
g as (select distinct judge, s as cut from j), r as (select g.judge, cut, round(sum(case when s >= cut then wrong else 0 end) / sum(wrong) - sum(case when s >= cut then 1 - wrong else 0 end) / sum(1 - wrong), 6) as y from g join j on j.judge = g.judge group by 1, 2)
select judge, cut / 100 as threshold, y as youden from (select *, row_number() over (partition by judge order by y desc, cut) as n from r) where n = 1""",
    "smp_by_size": """
with o as (select o_custkey, sum(round(o_totalprice * 100)::bigint)::bigint as size from orders group by 1), u as (select *, (sum(size) over (order by o_custkey))::bigint as upto, ((sum(size) over ()) // 20)::bigint as step from o)
select o_custkey, size, upto from u where upto // step > (upto - size) // step""",
    "etl_depths": """
with m as (select distinct run_id, query_id, rank, url_hash, changed from url_manifest), x as (select m.*, depth from m cross join (values (2), (5), (10)) v(depth) where rank <= depth),
q as (select run_id, depth, query_id, max(coalesce(changed, false)::int) as a, count(changed) as known from x group by 1, 2, 3)
select run_id, depth, count(*) as n, sum(a) as n_changed, sum(known) as known from q group by 1, 2""",
    "op_best_under_cost": """
with g as (select p_type, l_suppkey, sum(l_quantity) as volume, round(sum(l_extendedprice) / sum(l_quantity), 4) as unit_price from lineitem join part on l_partkey = p_partkey group by 1, 2),
n as (select *, max(volume) over (partition by p_type) as top from g), r as (select *, row_number() over (partition by p_type order by unit_price, volume desc, l_suppkey) as k from n where volume >= 0.95 * top)
select p_type, l_suppkey, volume, unit_price from r where k = 1""",
    "src_tsv_round_trip": "select lang, count(*) as n, count(distinct entity_id) as n_entities from entity_aliases group by 1",
    "etl_expired": "with l as (select max(fetched_at) as last from l3_cache) select run_id, sum((fetched_at >= last - 86400)::int) as kept, sum((fetched_at < last - 86400)::int) as deleted from l3_cache cross join l where fetched_at is not null group by 1",
    "win_prior_exposure": """
with e as (select event_type, row_number() over (partition by user_id, event_type order by ts, event_id) as k from events) select event_type, count(*) as n, sum((k > 1)::int) as n_exposed from e group by 1""",
    "win_recent_exposure": """
with p as (select *, row_number() over (order by ts, event_id) as place from events), e as (select event_type, place - lag(place) over (partition by user_id, event_type order by place) as gap from p)
select event_type, count(*) as n, sum(coalesce(gap <= 5000, false)::int) as n_exposed from e group by 1""",
}
