"""Ingestion queries: request records, rounds of pages, labels, latest rows, set operations, scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.functions import text as T
from tidewell.functions.urls import canonical_url, domain
from tidewell.session import scratch, table

# Ages of the collection rounds in seconds.
AGES = {"run_00": 0, "run_01": 3600, "run_02": 43200, "run_03": 86400, "run_04": 604800}
BLOCKED = "access denied|forbidden|enable javascript|verify that you are human|too many requests|not found"


def baseline(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "url_manifest").where("run_id = 'run_00' and snapshot_available").select("query_id", "rank", "url_hash", "domain").distinct()


def request_records(spark: SparkSession, d: str) -> DataFrame:
    """Ranked URL list of every question; rewordings inherit the list of their base question."""
    lists = baseline(spark, d).groupBy("query_id").agg(F.sort_array(F.collect_set(F.struct("rank", "url_hash"))).alias("urls"))
    base = table(spark, d, "queries").where("query is not null").select("query_id").distinct().withColumn("is_paraphrase", F.lit(False)).withColumn("base", F.col("query_id"))
    more = table(spark, d, "paraphrase_clusters").where("is_paraphrase and query is not null").select("query_id", "is_paraphrase", F.col("base_query_id").alias("base")).distinct()
    joined = base.unionByName(more).join(lists.withColumnRenamed("query_id", "base"), "base")
    return joined.select("query_id", "is_paraphrase", F.size("urls").alias("n_urls"), F.array_join(F.transform("urls", lambda u: u["url_hash"]), ",").alias("url_list"))


def round_table(spark: SparkSession, d: str) -> DataFrame:
    """One row per page and round: its latest delivery (null times first, then the greater row id)."""
    rows = table(spark, d, "l3_cache").select("row_id", "fetched_at", canonical_url("canonical_url").alias("page"), "run_id", "status_code", "extracted_text", F.lower("content_hash").alias("content_hash"))
    text = F.coalesce("extracted_text", F.lit(""))
    substantive = (F.length(F.trim(text)) >= 400) & ~F.lower(F.substring(text, 1, 400)).rlike(BLOCKED)
    seen = F.struct(F.coalesce("fetched_at", F.lit(float("-inf"))).alias("t"), "row_id", "content_hash", F.length(text).alias("n_chars"), substantive.cast("int").alias("substantive"))
    return rows.select("page", "run_id", seen.alias("seen")).groupBy("page", "run_id").agg(F.max("seen").alias("b"), F.count("*").alias("n_rows")).select("page", "run_id", "b.row_id", "b.content_hash", "b.n_chars", "b.substantive", "n_rows")


def unobservable_reason(spark: SparkSession, d: str) -> DataFrame:
    text = F.coalesce("extracted_text", F.lit(""))
    reason = (F.when(F.coalesce("status_code", F.lit(0)) != 200, F.concat(F.lit("status_"), F.coalesce(F.col("status_code").cast("string"), F.lit("none")))).when(F.length(F.trim(text)) < 400, "body_too_short")
              .when(F.lower(F.substring(text, 1, 400)).rlike(BLOCKED), "block_page").otherwise("observable"))
    return table(spark, d, "l3_cache").groupBy("run_id", reason.alias("reason")).agg(F.count("*").alias("n"))


def stale_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages reported changed per round; the 12 h round stands in for the 24 h round as well."""
    m = table(spark, d, "url_manifest").where("changed").select("run_id", "url_hash")
    both = m.unionByName(m.where("run_id = 'run_02'").withColumn("run_id", F.lit("run_03")))
    return both.distinct().groupBy("run_id").agg(F.count("*").alias("n_pages"))


def latest_page(spark: SparkSession, d: str) -> DataFrame:
    """Upsert: the latest row of each page over all deliveries (null times first, then the greater row id)."""
    rows = table(spark, d, "l3_cache").select(canonical_url("canonical_url").alias("page"), "row_id", "fetched_at", "run_id")
    best = F.max(F.struct(F.coalesce("fetched_at", F.lit(float("-inf"))).alias("t"), "row_id", "run_id")).alias("b")
    return rows.where("page <> ''").groupBy("page").agg(best).select("page", "b.row_id", "b.run_id")


def first_answers(spark: SparkSession, d: str) -> DataFrame:
    """First row per key of a prioritised pool."""
    a = table(spark, d, "answers").select("key.*", "answer", "utc")
    pick = F.min(F.struct(F.col("utc").isNull().alias("u"), "utc", F.coalesce("answer", F.lit("")).alias("a"))).alias("m")
    return a.groupBy("role", "ctx_sha", "q_sha").agg(pick).select("role", "ctx_sha", "q_sha", "m.utc", F.col("m.a").alias("answer"))


def unanswered(spark: SparkSession, d: str) -> DataFrame:
    """Questions whose hash no answer has (resumable work list)."""
    done = table(spark, d, "answers").select(F.col("key.q_sha").alias("sha"))
    q = table(spark, d, "queries").where("query is not null").select("query_id", F.substring(F.sha2("query", 256), 1, 16).alias("sha")).distinct()
    return q.join(done, "sha", "left_anti").select("query_id", "sha")


def answered_on_pages(spark: SparkSession, d: str) -> DataFrame:
    """Answers whose context is a page that was delivered."""
    pages = table(spark, d, "l3_cache").where("content_hash is not null").select(F.substring(F.lower("content_hash"), 1, 16).alias("ctx_sha")).distinct()
    return table(spark, d, "answers").select("key.*").distinct().join(pages, "ctx_sha", "left_semi").groupBy("role").agg(F.count("*").alias("n_answers"))


def url_functions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "l3_cache").select("row_id", canonical_url("canonical_url").alias("canonical"), domain("canonical_url").alias("host"), T.short_hash(F.col("canonical_url"), 24).alias("url_hash"))


def query_functions(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "queries").where("query is not null").select("query_id", "query").distinct()
    return q.select("query_id", T.short_hash(F.col("query"), 16).alias("query_hash"), T.language(F.col("query")).alias("lang"), F.size(T.tokens(F.col("query"))).alias("n_tokens"), F.array_join(F.array_sort(T.content_tokens(F.col("query"))), " ").alias("content"))


def paraphrase_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """Content-word overlap of rewordings with their base question."""
    p = table(spark, d, "paraphrase_clusters").where("query is not null").select("query_id", "base_query_id", "query", "is_paraphrase").distinct()
    base = p.where("not is_paraphrase").select("base_query_id", F.col("query").alias("base_query"))
    joined = p.where("is_paraphrase").join(base, "base_query_id")
    sim = T.jaccard(T.content_tokens(F.col("query")), T.content_tokens(F.col("base_query")))
    return joined.select("query_id", "base_query_id", F.round(sim, 6).alias("jaccard")).distinct()


def ranked_lists_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Identical, overlapping and disjoint URL lists between consecutive rounds of a question."""
    m = table(spark, d, "url_manifest").select("run_id", "query_id", "url_hash").distinct().groupBy("run_id", "query_id").agg(F.collect_set("url_hash").alias("s"))
    runs = table(spark, d, "url_manifest").select("run_id").distinct().withColumn("to_run", F.lead("run_id").over(Window.orderBy("run_id")))  # one row per round
    j = m.join(F.broadcast(runs), "run_id").alias("a").join(m.select(F.col("run_id").alias("to_run"), "query_id", F.col("s").alias("t")), ["to_run", "query_id"])
    both, either = F.size(F.array_intersect("s", "t")), F.size(F.array_union("s", "t"))
    kind = F.when(both == either, "IDENTICAL").when(both > 0, "OVERLAPPING").otherwise("DISJOINT")
    return j.groupBy("to_run", kind.alias("kind")).agg(F.count("*").alias("n"), F.round(F.avg(both / either), 6).alias("mean_jaccard"))


def jsonl_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Questions written as JSON lines and read back with a schema; malformed lines are dropped on reading."""
    q = table(spark, d, "queries")
    path = scratch(spark, "jsonl")
    q.write.json(path)
    back = spark.read.schema(q.schema).option("mode", "DROPMALFORMED").json(path)
    return back.groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("query_id").alias("n_ids"))


def split_sets(spark: SparkSession, d: str) -> DataFrame:
    """Domains cited by validation questions and by no training question."""
    m = table(spark, d, "url_manifest").select("query_id", "domain").distinct().join(table(spark, d, "query_splits").distinct(), "query_id")
    return m.where("split = 'validation'").select("domain").subtract(m.where("split = 'train'").select("domain"))


def sampled(spark: SparkSession, d: str) -> DataFrame:
    """Stratified sample: up to 5 questions of each class and language by hash order."""
    q = table(spark, d, "queries").where("query is not null").select("query_id", "freshness_class", F.lower(F.coalesce("language", F.lit("none"))).alias("language")).distinct()
    order = Window.partitionBy("freshness_class", "language").orderBy(F.sha2("query_id", 256), "query_id")
    return q.withColumn("n", F.row_number().over(order)).where("n <= 5").select("freshness_class", "language", "query_id")


_PAGE = r"""regexp_replace(regexp_replace(
    regexp_replace(split_part(lower(trim(canonical_url)), '#', 1), '([?&])(?:(?:utm_|ref=|source=|fbclid=)[^&]*&?)+', '\1', 'g'),
    '[?&]+$', ''), '/+$', '')"""
_BASE = "select distinct query_id, rank, url_hash, domain from url_manifest where run_id = 'run_00' and snapshot_available"
_TEXT = "coalesce(extracted_text, '')"
_STOPS = "[" + ",".join(f"'{w}'" for w in T.STOP_WORDS) + "]"
_TOK = "regexp_extract_all(lower({0}), '[a-z0-9]+|[가-힣]+')"
_CONTENT = f"list_filter(list_distinct({_TOK}), lambda x: not list_contains({_STOPS}, x))"

QUERIES = {
    "etl_baseline": baseline, "etl_request_records": request_records, "etl_round_table": round_table, "etl_unobservable_reason": unobservable_reason, "etl_stale_pages": stale_pages,
    "etl_latest_page": latest_page, "etl_first_answers": first_answers, "etl_unanswered": unanswered, "etl_answered_on_pages": answered_on_pages, "fn_url": url_functions, "fn_query": query_functions,
    "fn_paraphrase_jaccard": paraphrase_jaccard, "etl_list_overlap": ranked_lists_overlap, "src_jsonl_round_trip": jsonl_round_trip, "set_split_domains": split_sets, "smp_stratified": sampled,
}
SQL = {
    "etl_baseline": _BASE,
    "etl_request_records": f"""
with b as ({_BASE}), s as (select distinct query_id, rank, url_hash from b), lists as (select query_id, count(*) as n_urls, string_agg(url_hash, ',' order by rank, url_hash) as url_list from s group by 1),
r as (select distinct query_id, false as is_paraphrase, query_id as base from queries where query is not null
  union all select distinct query_id, is_paraphrase, base_query_id from paraphrase_clusters where is_paraphrase and query is not null)
select r.query_id, r.is_paraphrase, l.n_urls, l.url_list from r join lists l on l.query_id = r.base""",
    "etl_round_table": f"""
select page, run_id, row_id, content_hash, n_chars, substantive, n_rows from (select {_PAGE} as page, run_id, row_id, lower(content_hash) as content_hash, length({_TEXT}) as n_chars,
  case when length(trim({_TEXT}, ' ')) >= 400 and not regexp_matches(lower(substring({_TEXT}, 1, 400)), '{BLOCKED}') then 1 else 0 end as substantive,
  count(*) over (partition by {_PAGE}, run_id) as n_rows, row_number() over (partition by {_PAGE}, run_id order by fetched_at desc nulls last, row_id desc) as n from l3_cache) where n = 1""",
    "etl_unobservable_reason": f"""
select run_id, case when coalesce(status_code, 0) <> 200 then 'status_' || coalesce(status_code::varchar, 'none') when length(trim({_TEXT}, ' ')) < 400 then 'body_too_short'
  when regexp_matches(lower(substring({_TEXT}, 1, 400)), '{BLOCKED}') then 'block_page' else 'observable' end as reason, count(*) as n from l3_cache group by 1, 2""",
    "etl_stale_pages": "select run_id, count(*) as n_pages from (select run_id, url_hash from url_manifest where changed union select 'run_03', url_hash from url_manifest where changed and run_id = 'run_02') group by 1",
    "etl_latest_page": f"""
select page, row_id, run_id from (select {_PAGE} as page, row_id, run_id, row_number() over (partition by {_PAGE} order by fetched_at desc nulls last, row_id desc) as n from l3_cache) where n = 1 and page <> ''""",
    "etl_first_answers": """
select role, ctx_sha, q_sha, utc, answer from (select key.role, key.ctx_sha, key.q_sha, utc, coalesce(answer, '') as answer,
  row_number() over (partition by key order by utc nulls last, coalesce(answer, '')) as n from answers) where n = 1""",
    "etl_unanswered": "select distinct query_id, substring(sha256(query), 1, 16) as sha from queries where query is not null and substring(sha256(query), 1, 16) not in (select key.q_sha from answers where key.q_sha is not null)",
    "etl_answered_on_pages": "select key.role as role, count(distinct key) as n_answers from answers where key.ctx_sha in (select substring(lower(content_hash), 1, 16) from l3_cache where content_hash is not null) group by 1",
    "fn_url": rf"select row_id, {_PAGE} as canonical, regexp_replace(lower(regexp_extract(canonical_url, '://([^/?#]*)', 1)), '^www\.', '') as host, substring(sha256(lower(trim(canonical_url))), 1, 24) as url_hash from l3_cache",
    "fn_query": f"""
select distinct query_id, substring(sha256(lower(trim(query, ' '))), 1, 16) as query_hash,
  case when length(regexp_replace(query, '[^가-힣]', '', 'g')) > 0.2 * length(regexp_replace(query, '[^A-Za-z가-힣]', '', 'g')) then 'ko' else 'en' end as lang,
  len({_TOK.format("query")}) as n_tokens, array_to_string(list_sort({_CONTENT.format("query")}), ' ') as content from queries where query is not null""",
    "fn_paraphrase_jaccard": f"""
with p as (select distinct query_id, base_query_id, query, is_paraphrase from paraphrase_clusters where query is not null),
j as (select p.query_id, p.base_query_id, {_CONTENT.format("p.query")} as a, {_CONTENT.format("b.query")} as b from p join p b on b.base_query_id = p.base_query_id and not b.is_paraphrase where p.is_paraphrase)
select distinct query_id, base_query_id, round(case when len(list_distinct(list_concat(a, b))) = 0 then 0.0 else len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) end, 6) as jaccard from j""",
    "etl_list_overlap": """
with m as (select run_id, query_id, list(distinct url_hash) as s from url_manifest group by 1, 2),
r as (select run_id, lead(run_id) over (order by run_id) as to_run from (select distinct run_id from url_manifest)),
j as (select b.run_id as to_run, len(list_intersect(a.s, b.s)) as n_both, len(list_distinct(list_concat(a.s, b.s))) as n_either from m a join r on r.run_id = a.run_id join m b on a.query_id = b.query_id and b.run_id = r.to_run)
select to_run, case when n_both = n_either then 'IDENTICAL' when n_both > 0 then 'OVERLAPPING' else 'DISJOINT' end as kind, count(*) as n, round(avg(n_both / n_either), 6) as mean_jaccard from j group by 1, 2""",
    "src_jsonl_round_trip": "select source, count(*) as n, count(distinct query_id) as n_ids from queries group by 1",
    "set_split_domains": """
with m as (select distinct u.query_id, domain, split from url_manifest u join query_splits s on s.query_id = u.query_id)
select domain from m where split = 'validation' except select domain from m where split = 'train'""",
    "smp_stratified": """
select freshness_class, language, query_id from (select *, row_number() over (partition by freshness_class, language order by sha256(query_id), query_id) as n
  from (select distinct query_id, freshness_class, lower(coalesce(language, 'none')) as language from queries where query is not null)) where n <= 5""",
}
