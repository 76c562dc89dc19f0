"""Sources, pools, checks, orders, splits and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.functions.urls import canonical_url
from tidewell.operators.running import with_running
from tidewell.operators.similarity import neighbour_counts, neighbours
from tidewell.plans.etl import _PAGE
from tidewell.plans.joins import _SIM, _vectors
from tidewell.plans.stats import _LABELS, _int, _labels
from tidewell.session import scratch, table
from tidewell.sources.files import read_json_lines, write_once


def hash_share(key: str) -> Column:
    """A number in [0, 1) from the digits of a hash."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double") / 4294967296.0


_SHARE = "('0x' || substring(sha256({0}), 1, 8))::bigint / 4294967296.0"


def broken_lines(spark: SparkSession, d: str) -> DataFrame:
    """Questions as JSON lines, every tenth cut in the middle and some blank, read back: whole lines are kept, a missing path is empty."""
    q = table(spark, d, "queries").select("query_id", "query", "source")
    line = F.to_json(F.struct("query_id", F.coalesce("query", F.lit("")).alias("query"), "source"))
    cutted = F.when(hash_share("query_id") < 0.1, F.substring(line, 1, 12)).when(hash_share("query_id") < 0.15, F.lit("  ")).otherwise(line)
    path = scratch(spark, "lines")
    q.select(cutted.alias("value")).write.text(path)
    back = read_json_lines(spark, path, q.schema).unionByName(read_json_lines(spark, path + "-absent", q.schema))
    return back.groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("query_id").alias("n_ids"))


def round_folders(spark: SparkSession, d: str) -> DataFrame:
    """Page deliveries written as one JSON folder per round and read back with the round from the folder's name."""
    t = table(spark, d, "l3_cache").select("run_id", "row_id", "canonical_url", "status_code", F.length("extracted_text").alias("n_chars"))
    path = scratch(spark, "rounds")
    t.write.partitionBy("run_id").json(path)
    return read_json_lines(spark, path, t.select("row_id", "canonical_url", "status_code", "n_chars", "run_id").schema).groupBy("run_id").agg(F.count("*").alias("n"), F.count("status_code").alias("n_status"), F.sum("n_chars").alias("n_chars"))


def written_once(spark: SparkSession, d: str) -> DataFrame:
    """A sink that exists keeps its first content."""
    q, path = table(spark, d, "queries").where("query is not null").select("query_id", "source").distinct(), scratch(spark, "once")
    first, again = write_once(q.where("source is not null"), path), write_once(q, path)
    return spark.read.parquet(path).groupBy("source").agg(F.count("*").alias("n")).withColumns({"first": F.lit(first), "again": F.lit(again)})


def recent_pages(spark: SparkSession, d: str) -> DataFrame:
    """The 500 latest fetched rows, newest first (a top-k report)."""
    return table(spark, d, "l3_cache").where("fetched_at is not null").orderBy(F.desc("fetched_at"), F.desc("row_id")).limit(500).select("row_id", "run_id", "fetched_at")


def pooled(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts pooled from both files, the first file winning on items that both have."""
    pool = lambda name, p: table(spark, d, name).where("label is not null").select("sig", F.struct(F.lit(p).alias("p"), F.col("utc").isNull().alias("u"), "utc", "judge", "label").alias("x"))
    best = pool("judge_llama8b", 0).unionByName(pool("judge_qwen7b", 1)).groupBy("sig").agg(F.min("x").alias("x"))
    return best.groupBy(F.col("x.p").alias("pool"), F.col("x.judge").alias("judge")).agg(F.count("*").alias("n"))


def refetched(spark: SparkSession, d: str) -> DataFrame:
    """Each page fetched again: unchanged, changed, not available now, or without a stored hash to compare with."""
    last = lambda run, name: table(spark, d, "l3_cache").where(F.col("run_id") == run).select(canonical_url("canonical_url").alias("page"), F.struct(F.coalesce("fetched_at", F.lit(float("-inf"))).alias("t"), "row_id", F.lower("content_hash").alias("h")).alias("x")).groupBy("page").agg(F.max("x").alias("x")).select("page", F.col("x.h").alias(name), F.lit(True).alias(f"has_{name}"))
    j = last("run_00", "old").join(last("run_04", "new"), "page", "left")
    kind = F.when(F.col("new").isNull(), "UNAVAILABLE").when(F.col("old").isNull(), "NO_STORED_HASH").when(F.col("old") == F.col("new"), "UNCHANGED").otherwise("CHANGED")
    return j.groupBy(kind.alias("outcome")).agg(F.count("*").alias("n"))


def table_checks(spark: SparkSession, d: str) -> DataFrame:
    """Sizes and consistency of the tables: rows, distinct keys, null keys, keys without a question."""
    known = table(spark, d, "queries").select("query_id").distinct()

    def one(name: str) -> DataFrame:
        t = table(spark, d, name).select("query_id")
        g = t.agg(F.count("*").alias("n"), F.countDistinct("query_id").alias("n_keys"), F.sum(_int(F.col("query_id").isNull())).alias("n_null"))
        lost = t.distinct().join(known, "query_id", "left_anti").agg(F.count("query_id").alias("n_unknown"))
        return g.crossJoin(lost).select(F.lit(name).alias("name"), "*")

    names = ["queries", "url_manifest", "query_splits", "paraphrase_clusters"]
    out = one(names[0])
    for name in names[1:]:
        out = out.unionByName(one(name))
    return out


def looked_up(spark: SparkSession, d: str) -> DataFrame:
    """Result rows with the stored status of their page, or 0 where nothing is stored."""
    s = table(spark, d, "l3_cache").groupBy(canonical_url("canonical_url").alias("page")).agg(F.max("status_code").alias("status"))
    m = table(spark, d, "url_manifest").select("run_id", canonical_url("canonical_url").alias("page"))
    return m.join(s, "page", "left").groupBy("run_id", F.coalesce("status", F.lit(0)).alias("status")).agg(F.count("*").alias("n"))


def domain_sets(spark: SparkSession, d: str) -> DataFrame:
    """Domains of the first and the last round: in both, in either, in one alone; the parts add up."""
    m = table(spark, d, "url_manifest").where("domain is not null")
    a, b = (m.where(F.col("run_id") == r).select("domain") for r in ("run_00", "run_04"))
    parts = {"both": a.intersect(b), "either": a.union(b).distinct(), "first alone": a.subtract(b), "last alone": b.subtract(a)}
    out = None
    for name, part in parts.items():
        row = part.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def stable_order(spark: SparkSession, d: str) -> DataFrame:
    """Place of every rewording in the order (cluster, base first, id), numbered over ranged parts."""
    p = table(spark, d, "paraphrase_clusters").where("query_id is not null and cluster_id is not null").select("cluster_id", "is_paraphrase", "query_id").distinct()
    return with_running(p, [F.col("cluster_id"), F.col("is_paraphrase"), F.col("query_id")], {"place": F.lit(1)}).select("query_id", "cluster_id", "is_paraphrase", "place")


def favourite_type(spark: SparkSession, d: str) -> DataFrame:
    """Each user's event type by frequency, then sum of values, then the one met first: one maximum of an ordered tuple."""
    g = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.min("event_id").alias("first"))
    best = F.max_by("event_type", F.struct("n", "total", -F.col("first")))
    return g.groupBy("user_id").agg(best.alias("event_type"), F.max("n").alias("n"))


def two_phase(spark: SparkSession, d: str) -> DataFrame:
    """Simple random sample by hash (a fifth), then the same share again inside it."""
    q = table(spark, d, "queries").where("query is not null").select("query_id", "source").distinct()
    first = q.where(hash_share("query_id") < 0.2).withColumn("second", hash_share(F.concat("query_id", F.lit("#2"))) < 0.2)
    return first.select("query_id", "source", "second")


def cluster_split(spark: SparkSession, d: str) -> DataFrame:
    """30 / 70 split of clusters inside each class by hash order; clusters of several classes go by their smallest one and are counted."""
    c = table(spark, d, "paraphrase_clusters").where("cluster_id is not null").groupBy("cluster_id").agg(F.min("freshness_class").alias("c"), F.countDistinct("freshness_class").alias("k")).where("c is not null").withColumn("h", F.sha2("cluster_id", 256))
    r = with_running(c, [F.col("c"), F.col("h"), F.col("cluster_id")], {"place": F.lit(1)})
    size = c.groupBy("c").agg(F.count("*").alias("n"))
    start = r.groupBy("c").agg(F.min("place").alias("start"))
    rank = F.col("place") - F.col("start") + 1
    side = F.when(rank <= F.floor(0.3 * F.col("n") + 0.5), "validation").otherwise("heldout")
    return r.join(size, "c").join(start, "c").groupBy(F.col("c").alias("freshness_class"), side.alias("split")).agg(F.count("*").alias("n"), F.sum(_int(F.col("k") > 1)).alias("n_mixed"), F.min("cluster_id").alias("least"))


def split_after_times(spark: SparkSession, d: str) -> DataFrame:
    """Requests get their place in the whole stream first, then one split is kept: places do not close up."""
    m = table(spark, d, "url_manifest").where("rank = 1 and run_id = 'run_00'").groupBy("query_id").agg(F.min("retrieval_timestamp").alias("at"))
    r = with_running(m, [F.col("at"), F.col("query_id")], {"seq": F.lit(1)})
    held = table(spark, d, "query_splits").where("split = 'validation'").select("query_id").distinct()
    return r.join(held, "query_id", "left_semi").select("query_id", "seq")


def quotas(spark: SparkSession, d: str) -> DataFrame:
    """200 questions over the classes by largest remainders, and inside a class every (n / quota)-th by hash order."""
    q = table(spark, d, "queries").where("query is not null and freshness_class is not null").groupBy("query_id").agg(F.min("freshness_class").alias("c")).withColumn("h", F.sha2("query_id", 256))
    n = q.groupBy("c").agg(F.count("*").alias("n"))
    whole = n.agg(F.sum("n").alias("all"))
    share = n.crossJoin(whole).withColumn("exact", 200 * F.col("n") / F.col("all")).withColumn("base", F.floor("exact"))
    left = 200 - F.sum("base").over(Window.partitionBy())
    rank = F.row_number().over(Window.orderBy(F.desc(F.round(F.col("exact") - F.col("base"), 9)), "c"))  # one row per class
    quota = share.withColumn("left", left).withColumn("quota", F.col("base") + _int(rank <= F.col("left"))).select("c", "n", "quota")
    r = with_running(q, [F.col("c"), F.col("h"), F.col("query_id")], {"place": F.lit(1)})
    start = r.groupBy("c").agg(F.min("place").alias("start"))
    k = F.col("place") - F.col("start")
    taken = r.join(quota, "c").join(start, "c").where(F.floor((k + 1) * F.col("quota") / F.col("n")) > F.floor(k * F.col("quota") / F.col("n")))
    return taken.select(F.col("c").alias("freshness_class"), "query_id")


def quota_filter(spark: SparkSession, d: str) -> DataFrame:
    """Questions once per lower-cased text (the smallest id), up to 30 per class in order of ids."""
    q = table(spark, d, "queries").where("query is not null and freshness_class is not null").groupBy(F.lower("query").alias("t")).agg(F.min(F.struct("query_id", "freshness_class")).alias("x")).select("x.*").distinct()
    r = with_running(q, [F.col("freshness_class"), F.col("query_id")], {"place": F.lit(1)})
    start = r.groupBy("freshness_class").agg(F.min("place").alias("start"))
    return r.join(start, "freshness_class").where(F.col("place") - F.col("start") < 30).select("query_id", "freshness_class")


def windows_of(spark: SparkSession, d: str) -> DataFrame:
    """Contiguous windows of 512 events in time order: users, types and values in each."""
    e = with_running(table(spark, d, "events").select("ts", "event_id", "user_id", "event_type", "value"), [F.col("ts"), F.col("event_id")], {"place": F.lit(1)})
    return e.groupBy(F.floor((F.col("place") - 1) / 512).alias("window")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("n_users"), F.round(F.sum("value"), 4).alias("total"))


def topk_bound(spark: SparkSession, d: str) -> DataFrame:
    """The most rows that any query has above the threshold: from so many neighbours on, a top-k answer decides as all would."""
    v = _vectors(spark, d)
    n = neighbour_counts(v.where("id % 20 = 0"), v, least=0.3)
    return n.agg(F.count("*").alias("n_queries"), F.max("n").alias("bound"), F.sum(_int(F.col("n") > 10)).alias("n_beyond_ten"))


def similarity_bands(spark: SparkSession, d: str) -> DataFrame:
    """Best matches by bands of similarity with the weight population / sample of a sample of five per band."""
    v = _vectors(spark, d)
    band = F.floor(F.col("similarity") * 20).cast("int").alias("band")
    n = neighbours(v.where("id % 20 = 0"), v, k=1).select("query_id", band)
    r = F.row_number().over(Window.partitionBy("band").orderBy(F.sha2(F.col("query_id").cast("string"), 256)))
    g = n.withColumn("r", r).groupBy("band").agg(F.count("*").alias("n"), F.sum(_int(F.col("r") <= 5)).alias("n_sample"))
    return g.withColumn("weight", F.round(F.col("n") / F.col("n_sample"), 6))


def cache_match(spark: SparkSession, d: str) -> DataFrame:
    """Match of each query against what was stored before it, with the reason of a miss: nothing stored, nothing alike, or the best is too old."""
    v = _vectors(spark, d)
    asked = v.where("id % 20 = 0")
    b = neighbour_counts(asked, v, least=-1.0, prior_only=True)
    j = asked.select(F.col("id").alias("query_id")).join(b, "query_id", "left")
    kind = F.when(F.col("best").isNull(), "empty").when(F.col("best") < 0.3, "no_sim").when(F.col("query_id") - F.col("best_id") > 200, "temporal_reject").otherwise("match")
    return j.groupBy(kind.alias("outcome")).agg(F.count("*").alias("n"))


def savings(spark: SparkSession, d: str) -> DataFrame:
    """Repeats that the whole stream's repeat rate predicts for each class against those that there are."""
    m = table(spark, d, "url_manifest").where("freshness_class is not null").groupBy("freshness_class", "url_hash").agg(F.count("*").alias("n"))
    c = m.groupBy("freshness_class").agg(F.sum("n").alias("n"), F.sum(F.col("n") - 1).alias("repeats"))
    whole = c.agg((F.sum("repeats") / F.sum("n")).alias("rate"))
    return c.crossJoin(whole).select("freshness_class", "n", "repeats", F.round(F.col("n") * F.col("rate"), 4).alias("predicted"))


def judge_density(spark: SparkSession, d: str) -> DataFrame:
    """Items by how many judges saw them, with the share on which all agree."""
    g = _labels(spark, d).groupBy("q", "gold", "ans").agg(F.count("*").alias("judges"), F.countDistinct("wrong").alias("k"))
    return g.groupBy("judges").agg(F.count("*").alias("n"), F.round(F.avg(_int(F.col("k") == 1)), 6).alias("agree"))


QUERIES = {
    "src_broken_lines": broken_lines, "src_round_folders": round_folders, "src_written_once": written_once, "etl_recent_pages": recent_pages, "etl_pooled": pooled, "etl_refetched": refetched, "etl_table_checks": table_checks,
    "join_looked_up": looked_up, "set_domains": domain_sets, "win_stable_order": stable_order, "op_favourite_type": favourite_type, "smp_two_phase": two_phase, "smp_cluster_split": cluster_split, "win_split_after_times": split_after_times,
    "smp_quotas": quotas, "smp_quota_filter": quota_filter, "win_contiguous": windows_of, "knn_topk_bound": topk_bound, "knn_bands": similarity_bands, "knn_cache_match": cache_match, "st_savings": savings, "st_judge_density": judge_density,
}
_LAST = "(select page, h from (select {0} as page, lower(content_hash) as h, row_number() over (partition by {0} order by fetched_at desc nulls last, row_id desc) as n from l3_cache where run_id = '{1}') where n = 1)"
_CHECK = "select '{0}' as name, count(*) as n, count(distinct query_id) as n_keys, sum((query_id is null)::int) as n_null, (select count(*) from (select distinct query_id from {0} where query_id is not null and query_id not in (select query_id from queries where query_id is not null))) as n_unknown from {0}"
SQL = {
    "src_broken_lines": f"select source, count(*) as n, count(distinct query_id) as n_ids from queries where {_SHARE.format('query_id')} >= 0.15 group by 1",
    "src_round_folders": "select run_id, count(*) as n, count(status_code) as n_status, sum(length(extracted_text))::bigint as n_chars from l3_cache group by 1",
    "src_written_once": "select source, count(*) as n, true as first, false as again from (select distinct query_id, source from queries where query is not null and source is not null) group by 1",
    "etl_recent_pages": "select row_id, run_id, fetched_at from l3_cache where fetched_at is not null order by fetched_at desc, row_id desc limit 500",
    "etl_pooled": """
with p as (select sig, 0 as p, utc, judge, label from judge_llama8b where label is not null union all select sig, 1, utc, judge, label from judge_qwen7b where label is not null),
b as (select p, judge from (select *, row_number() over (partition by sig order by p, utc nulls last, judge, label) as n from p) where n = 1) select p as pool, judge, count(*) as n from b group by 1, 2""",
    "etl_refetched": f"""
select case when n.h is null then 'UNAVAILABLE' when o.h is null then 'NO_STORED_HASH' when o.h = n.h then 'UNCHANGED' else 'CHANGED' end as outcome, count(*) as n
from {_LAST.format(_PAGE, "run_00")} o left join {_LAST.format(_PAGE, "run_04")} n on o.page = n.page group by 1""",
    "etl_table_checks": " union all ".join(_CHECK.format(t) for t in ("queries", "url_manifest", "query_splits", "paraphrase_clusters")),
    "join_looked_up": f"with s as (select {_PAGE} as page, max(status_code) as status from l3_cache group by 1), m as (select run_id, {_PAGE} as page from url_manifest) select run_id, coalesce(status, 0) as status, count(*) as n from m left join s on s.page = m.page group by 1, 2",
    "set_domains": """
with a as (select distinct domain from url_manifest where domain is not null and run_id = 'run_00'), b as (select distinct domain from url_manifest where domain is not null and run_id = 'run_04')
select 'both' as part, count(*) as n from (select * from a intersect select * from b) union all select 'either', count(*) from (select * from a union select * from b)
union all select 'first alone', count(*) from (select * from a except select * from b) union all select 'last alone', count(*) from (select * from b except select * from a)""",
    "win_stable_order": """
select query_id, cluster_id, is_paraphrase, row_number() over (order by cluster_id, is_paraphrase nulls first, query_id) as place from (select distinct cluster_id, is_paraphrase, query_id from paraphrase_clusters where query_id is not null and cluster_id is not null)""",
    "op_favourite_type": """
with g as (select user_id, event_type, count(*) as n, round(sum(value), 4) as total, min(event_id) as first from events group by 1, 2)
select user_id, event_type, n from (select *, row_number() over (partition by user_id order by n desc, total desc, first) as k from g) where k = 1""",
    "smp_two_phase": f"select query_id, source, {_SHARE.format('query_id || ' + chr(39) + '#2' + chr(39))} < 0.2 as second from (select distinct query_id, source from queries where query is not null) where {_SHARE.format('query_id')} < 0.2",
    "smp_cluster_split": """
with c as (select cluster_id, min(freshness_class) as c, count(distinct freshness_class) as k from paraphrase_clusters where cluster_id is not null group by 1),
r as (select *, row_number() over (partition by c order by sha256(cluster_id), cluster_id) as r, count(*) over (partition by c) as n from c where c is not null)
select c as freshness_class, case when r <= floor(0.3 * n + 0.5) then 'validation' else 'heldout' end as split, count(*) as n, sum((k > 1)::int) as n_mixed, min(cluster_id) as least from r group by 1, 2""",
    "win_split_after_times": """
with m as (select query_id, min(retrieval_timestamp) as t from url_manifest where rank = 1 and run_id = 'run_00' group by 1), r as (select query_id, row_number() over (order by t, query_id) as seq from m)
select query_id, seq from r where query_id in (select query_id from query_splits where split = 'validation')""",
    "smp_quotas": """
with q as (select query_id, min(freshness_class) as c from queries where query is not null and freshness_class is not null group by 1), n as (select c, count(*) as n, 200 * count(*) / sum(count(*)) over () as exact from q group by 1),
k as (select c, n, floor(exact) + (row_number() over (order by round(exact - floor(exact), 9) desc, c) <= 200 - sum(floor(exact)) over ())::int as quota from n),
r as (select q.query_id, q.c, row_number() over (partition by q.c order by sha256(query_id), query_id) - 1 as k from q)
select r.c as freshness_class, query_id from r join k on k.c = r.c where floor((r.k + 1) * quota / n) > floor(r.k * quota / n)""",
    "smp_quota_filter": """
with x as (select query_id, freshness_class, row_number() over (partition by lower(query) order by query_id, freshness_class) as n from queries where query is not null and freshness_class is not null), d as (select distinct query_id, freshness_class from x where n = 1)
select query_id, freshness_class from (select *, row_number() over (partition by freshness_class order by query_id) as k from d) where k <= 30""",
    "win_contiguous": """
with p as (select *, row_number() over (order by ts, event_id) - 1 as place from events) select place // 512 as "window", count(*) as n, count(distinct user_id) as n_users, round(sum(value), 4) as total from p group by 1""",
    "knn_topk_bound": f"with {_SIM}, c as (select query_id, count(*) as n from s where similarity >= 0.3 group by 1) select count(*) as n_queries, max(n) as bound, sum((n > 10)::int) as n_beyond_ten from c",
    "knn_bands": f"""
with {_SIM}, b as (select query_id, floor(similarity * 20)::int as band from (select *, row_number() over (partition by query_id order by similarity desc, id) as n from s) where n = 1), g as (select band, count(*) as n, least(count(*), 5) as n_sample from b group by 1)
select band, n, n_sample, round(n / n_sample, 6) as weight from g""",
    "knn_cache_match": f"""
with {_SIM}, b as (select query_id, max(similarity) as best, arg_max(id, (similarity, -id)) as best_id from s where id < query_id group by 1), q as (select distinct vec_id as query_id from embeddings where vec_id % 20 = 0)
select case when best is null then 'empty' when best < 0.3 then 'no_sim' when query_id - best_id > 200 then 'temporal_reject' else 'match' end as outcome, count(*) as n from q left join b using (query_id) group by 1""",
    "st_savings": """
with m as (select freshness_class, url_hash, count(*) as n from url_manifest where freshness_class is not null group by 1, 2), c as (select freshness_class, sum(n) as n, sum(n - 1) as repeats from m group by 1)
select freshness_class, n::bigint as n, repeats::bigint as repeats, round(n * (select sum(repeats) / sum(n) from c), 4) as predicted from c""",
    "st_judge_density": f"with {_LABELS}, g as (select count(*) as judges, count(distinct wrong) as k from lab group by q, gold, ans) select judges, count(*) as n, round(avg((k = 1)::int), 6) as agree from g group by 1",
}
