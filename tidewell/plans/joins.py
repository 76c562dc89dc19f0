"""Joins over time and similarity, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.functions.urls import canonical_url
from tidewell.operators.asof import asof_last
from tidewell.operators.running import with_running
from tidewell.operators.similarity import CellIndex, neighbour_counts, neighbours
from tidewell.plans.etl import _PAGE
from tidewell.session import table

# Half-lives in seconds per class of freshness, and the age share k of the page tier.
HALF_LIFE = {"REAL_TIME": 30, "FAST": 449280, "MEDIUM": 457920, "SLOW": 993600, "TIMELESS": 2592000}
K_PAGE = 0.6214883


def _seconds(c: str) -> F.Column:
    return F.unix_timestamp(F.to_timestamp(c)).cast("double")


def asof_versions(spark: SparkSession, d: str) -> DataFrame:
    """The version of each result page that was last fetched at or before its retrieval."""
    req = table(spark, d, "url_manifest").select("run_id", "query_id", "rank", canonical_url("canonical_url").alias("page"), _seconds("retrieval_timestamp").alias("at")).distinct()
    ver = table(spark, d, "l3_cache").where("content_hash is not null and fetched_at is not null").select(canonical_url("canonical_url").alias("page"), F.col("fetched_at").alias("at"), F.lower("content_hash").alias("version"))
    return asof_last(req, ver, key="page", time="at", value="version").groupBy("run_id").agg(F.count("*").alias("n"), F.count("version").alias("n_known"), F.countDistinct("version").alias("n_versions"))


def round_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Share of pages that differ between every two rounds a < b in which both hashes are known."""
    m = table(spark, d, "url_manifest").where("content_hash is not null").groupBy("url_hash", "run_id").agg(F.max(F.lower("content_hash")).alias("h"))
    a, b = m.toDF("url_hash", "run_a", "ha"), m.toDF("url_hash", "run_b", "hb")
    return a.join(b, "url_hash").where("run_a < run_b").groupBy("run_a", "run_b").agg(F.count("*").alias("n"), F.sum((F.col("ha") != F.col("hb")).cast("int")).alias("n_changed"))


def outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Three-valued outcome of each question's first list in every later round: changed, unchanged, unobservable."""
    m = table(spark, d, "url_manifest").select("run_id", "query_id", "url_hash", F.lower("content_hash").alias("h"))
    first = m.where("run_id = 'run_00'").groupBy("query_id", "url_hash").agg(F.max("h").alias("h0"))
    later = m.where("run_id <> 'run_00'").groupBy("run_id", "query_id", "url_hash").agg(F.max("h").alias("h1"))
    each = F.when(F.col("h0").isNull() | F.col("h1").isNull(), None).otherwise((F.col("h0") != F.col("h1")).cast("int"))
    j = first.join(later, ["query_id", "url_hash"]).withColumn("o", each)
    q = j.groupBy("run_id", "query_id").agg(F.max("o").alias("any"), F.count("o").alias("known"), F.count("*").alias("n"))
    kind = F.when(F.col("any") == 1, "CHANGED").when(F.col("known") == F.col("n"), "UNCHANGED").otherwise("UNOBSERVABLE")
    return q.groupBy("run_id", kind.alias("outcome")).agg(F.count("*").alias("n"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def top_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Exact ten nearest of every row whose id is divisible by 20, against all rows."""
    v = _vectors(spark, d)
    return neighbours(v.where("id % 20 = 0"), v, k=10)


def prior_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Earlier rows at cosine 0.3 or more of every row whose id is divisible by 20."""
    v = _vectors(spark, d)
    return neighbour_counts(v.where("id % 20 = 0"), v, least=0.3, prior_only=True).select("query_id", F.col("n").alias("n_prior"), "best", "best_id")


def indexed_recall(spark: SparkSession, d: str) -> DataFrame:
    """Share of the exact ten nearest that the index of cells finds, over every row whose id is divisible by 20 against all rows."""
    v = _vectors(spark, d)
    asked = v.where("id % 20 = 0")
    exact = neighbours(asked, v, k=10).select("query_id", "id")
    found = CellIndex(v).search(asked, k=10).select("query_id", "id", F.lit(1).alias("hit"))
    return exact.join(found, ["query_id", "id"], "left").agg(F.count("*").alias("n"), F.count("hit").alias("n_found"), F.round(F.count("hit") / F.count("*"), 4).alias("recall"))


def indexed_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Ten nearest by the index of cells."""
    v = _vectors(spark, d)
    return CellIndex(v).search(v.where("id % 20 = 0"), k=10)


def neighbour_density(spark: SparkSession, d: str) -> DataFrame:
    """Rows at cosine 0.2 or more before a query: all, the last 200, those of its own label and of others, and whether any is at 0.4."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")
    n = neighbour_counts(v.where("id % 20 = 0"), v, least=0.2, prior_only=True, recent=200)
    return n.select("query_id", "n", "n_recent", "n_same", (F.col("n") - F.col("n_same")).alias("n_other"), (F.col("best") >= 0.4).alias("close"))


def neighbour_labels(spark: SparkSession, d: str) -> DataFrame:
    """How often the nearest neighbour has the same label."""
    labels = table(spark, d, "embeddings").select("vec_id", "label")
    v = _vectors(spark, d)
    n = neighbours(v.where("id % 20 = 0"), v, k=1).join(labels.toDF("query_id", "own"), "query_id").join(labels.toDF("id", "other"), "id")
    return n.groupBy("own").agg(F.count("*").alias("n"), F.sum((F.col("own") == F.col("other")).cast("int")).alias("n_same"))


def _sessions(r: DataFrame, keys: list[str]) -> DataFrame:
    """(session, n): rows of a key whose gap to the one before is within its time to live, cut by Spark's session windows."""
    return r.groupBy(F.session_window("at", F.col("ttl")).alias("w"), *keys).agg(F.count("*").alias("n"))


def page_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Runs of requests of a page in which none comes later after another than the class's time to live."""
    life = F.create_map(*[x for k, v in HALF_LIFE.items() for x in (F.lit(k), F.lit(f"{int(v * K_PAGE)} seconds"))])
    m = table(spark, d, "url_manifest").where("freshness_class is not null").select("url_hash", "freshness_class", "run_id", "query_id", "rank", F.to_timestamp("retrieval_timestamp").alias("at")).where("at is not null").distinct()
    return _sessions(m.withColumn("ttl", life[F.col("freshness_class")]), ["url_hash", "freshness_class"]).groupBy("freshness_class").agg(F.count("*").alias("n_sessions"), F.sum("n").alias("n"), F.max("n").alias("longest"))


def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of a user's events of one type with six hours between them at most."""
    e = table(spark, d, "events").select("user_id", "event_type", F.date_trunc("second", F.col("ts").cast("timestamp")).alias("at"), F.lit("21600 seconds").alias("ttl"))
    return _sessions(e, ["user_id", "event_type"]).groupBy("event_type").agg(F.count("*").alias("n_sessions"), F.sum("n").alias("n"), F.max("n").alias("longest"))


def repeats(spark: SparkSession, d: str) -> DataFrame:
    """First-seen and repeated URLs per round, in order of retrieval: a URL's first result is a minimum, no window."""
    m = table(spark, d, "url_manifest").select("run_id", "query_id", "rank", "url_hash", "retrieval_timestamp").distinct()
    first = m.groupBy("url_hash").agg(F.min(F.struct(F.col("retrieval_timestamp").isNull().alias("k"), "retrieval_timestamp", "run_id", "query_id", "rank")).alias("f")).groupBy(F.col("f.run_id").alias("run_id")).agg(F.count("*").alias("first_seen"))
    return m.groupBy("run_id").agg(F.count("*").alias("n")).join(first, "run_id", "left").select("run_id", F.coalesce("first_seen", F.lit(0)).alias("first_seen"), (F.col("n") - F.coalesce("first_seen", F.lit(0))).alias("repeated"))


def gaps(spark: SparkSession, d: str) -> DataFrame:
    """Gaps between a user's consecutive events: median, 95th percentile, mean."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", "ts", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t"))
    g = e.withColumn("gap", F.col("t") - F.lag("t").over(w)).where("gap is not null")
    return g.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.percentile("gap", F.lit(0.5)), 3).alias("median"), F.round(F.percentile("gap", F.lit(0.95)), 3).alias("p95"), F.round(F.avg("gap"), 3).alias("mean"))


def zipf_weights(spark: SparkSession, d: str) -> DataFrame:
    """Every question by how often its results are delivered, with the weight 1 / rank in its class.

    Ranks are running counts over ranged parts, so a class is no single task.
    """
    n = table(spark, d, "url_manifest").where("freshness_class is not null").groupBy("freshness_class", "query_id").agg(F.count("*").alias("n"))
    r = with_running(n, [F.col("freshness_class"), F.desc("n"), F.col("query_id")], {"place": F.lit(1)})
    start = r.groupBy("freshness_class").agg(F.min("place").alias("start"))
    rank = (F.col("place") - F.col("start") + 1).alias("rank")
    return r.join(start, "freshness_class").select("freshness_class", "query_id", "n", rank).withColumn("weight", F.round(1 / F.col("rank"), 6))


_V = "select vec_id as id, embedding::double[] as v from embeddings"
_SIM = f"e as ({_V}), s as (select q.id as query_id, r.id as id, round(list_cosine_similarity(q.v, r.v), 6) as similarity from e q join e r on q.id <> r.id where q.id % 20 = 0)"
_HASHED = "select {0} lower(content_hash) as h from url_manifest"
_EPOCH = "floor(epoch(retrieval_timestamp::timestamptz))::double"


_LIFE = "case freshness_class " + " ".join(f"when '{k}' then {int(v * K_PAGE)}" for k, v in HALF_LIFE.items()) + " end"


def _sessions_sql(source: str, keys: str, by: str) -> str:
    """A session begins where the gap to the row before reaches the time to live."""
    return f"""
with r as ({source}), g as (select *, coalesce(t - lag(t) over w >= ttl, true) as fresh from r window w as (partition by {keys} order by t)),
s as (select *, sum(fresh::int) over (partition by {keys} order by t rows between unbounded preceding and current row) as k from g),
c as (select {keys}, k, count(*) as n from s group by all)
select {by}, count(*) as n_sessions, sum(n)::bigint as n, max(n) as longest from c group by 1"""


QUERIES = {
    "join_asof_versions": asof_versions, "join_round_pairs": round_pairs, "join_outcomes": outcomes, "knn_exact": top_neighbours, "knn_prior": prior_neighbours, "knn_labels": neighbour_labels, "knn_density": neighbour_density,
    "knn_index": indexed_neighbours, "knn_index_recall": indexed_recall, "win_page_sessions": page_sessions, "win_event_sessions": event_sessions, "win_repeats": repeats, "win_gaps": gaps, "win_zipf": zipf_weights,
}
SQL = {
    "join_asof_versions": f"""
with req as (select distinct run_id, query_id, rank, {_PAGE} as page, {_EPOCH} as at from url_manifest),
ver as (select {_PAGE} as page, fetched_at as at, max(lower(content_hash)) as version from l3_cache where content_hash is not null and fetched_at is not null group by 1, 2)
select run_id, count(*) as n, count(version) as n_known, count(distinct version) as n_versions from req asof left join ver on req.page = ver.page and req.at >= ver.at group by 1""",
    "join_round_pairs": f"""
with m as (select url_hash, run_id, max(h) as h from ({_HASHED.format("url_hash, run_id,")}) where h is not null group by 1, 2)
select a.run_id as run_a, b.run_id as run_b, count(*) as n, sum((a.h <> b.h)::int) as n_changed from m a join m b on a.url_hash = b.url_hash and a.run_id < b.run_id group by 1, 2""",
    "join_outcomes": f"""
with m as ({_HASHED.format("run_id, query_id, url_hash,")}), f as (select query_id, url_hash, max(h) as h0 from m where run_id = 'run_00' group by 1, 2),
l as (select run_id, query_id, url_hash, max(h) as h1 from m where run_id <> 'run_00' group by 1, 2, 3),
q as (select run_id, query_id, max((h0 <> h1)::int) as c, count(h0 <> h1) as known, count(*) as n from f join l using (query_id, url_hash) group by 1, 2)
select run_id, case when c = 1 then 'CHANGED' when known = n then 'UNCHANGED' else 'UNOBSERVABLE' end as outcome, count(*) as n from q group by 1, 2""",
    "knn_exact": f"with {_SIM} select query_id, id, similarity from (select *, row_number() over (partition by query_id order by similarity desc, id) as n from s) where n <= 10",
    "knn_prior": f"with {_SIM} select query_id, count(*) as n_prior, max(similarity) as best, arg_max(id, (similarity, -id)) as best_id from s where id < query_id and similarity >= 0.3 group by 1",
    "knn_density": f"""
with {_SIM}, p as (select s.*, x.label = y.label as same from s join embeddings x on x.vec_id = s.query_id join embeddings y on y.vec_id = s.id where s.id < s.query_id and similarity >= 0.2)
select query_id, count(*) as n, sum((id >= query_id - 200)::int) as n_recent, sum(coalesce(same, false)::int) as n_same, sum((not coalesce(same, false))::int) as n_other, max(similarity) >= 0.4 as close from p group by 1""",
    "knn_labels": f"""
with {_SIM}, b as (select query_id, id from (select *, row_number() over (partition by query_id order by similarity desc, id) as n from s) where n = 1)
select x.label as own, count(*) as n, sum((x.label = y.label)::int) as n_same from b join embeddings x on x.vec_id = b.query_id join embeddings y on y.vec_id = b.id group by 1""",
    "win_page_sessions": _sessions_sql(f"select distinct url_hash, freshness_class, run_id, query_id, rank, epoch(retrieval_timestamp::timestamptz) as t, {_LIFE} as ttl from url_manifest where freshness_class is not null and retrieval_timestamp is not null", "url_hash, freshness_class", "freshness_class"),
    "win_event_sessions": _sessions_sql("select user_id, event_type, floor(epoch(ts)) as t, 21600 as ttl from events", "user_id, event_type", "event_type"),
    "win_repeats": """
with m as (select distinct run_id, query_id, rank, url_hash, retrieval_timestamp from url_manifest), n as (select run_id, row_number() over (partition by url_hash order by retrieval_timestamp, run_id, query_id, rank) as n from m)
select run_id, sum((n = 1)::int) as first_seen, sum((n > 1)::int) as repeated from n group by 1""",
    "win_gaps": """
with g as (select event_type, floor(epoch(ts)) - lag(floor(epoch(ts))) over (partition by user_id order by ts, event_id) as gap from events)
select event_type, count(*) as n, round(quantile_cont(gap, 0.5), 3) as median, round(quantile_cont(gap, 0.95), 3) as p95, round(avg(gap), 3) as mean from g where gap is not null group by 1""",
    "win_zipf": """
with n as (select freshness_class, query_id, count(*) as n from url_manifest where freshness_class is not null group by 1, 2), r as (select *, row_number() over (partition by freshness_class order by n desc, query_id) as rank from n)
select freshness_class, query_id, n, rank, round(1.0 / rank, 6) as weight from r""",
}
