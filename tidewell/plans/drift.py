"""How pages and lists drift between rounds: as-of comparisons, rates on common supports, bounds, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.functions.stats import decay_rate, mcnemar_exact
from tidewell.plans.etl import _TEXT, AGES, BLOCKED, round_table
from tidewell.plans.etl import SQL as ETL_SQL
from tidewell.plans.stats import _AGE, _EXACT, _P, ORDER, _int
from tidewell.session import table

DEFAULT_VOLATILITY, STALE = 0.4, 0.35  # a domain never seen; the predicted change from which a result counts as stale
# Volatility from which a change is taken for noise, per class.
CEILING = {"REAL_TIME": 1.01, "FAST": 0.9, "MEDIUM": 0.7, "SLOW": 0.5, "TIMELESS": 0.3}
_RUNS = list(AGES)


def _age(c: Column | str) -> Column:
    return F.create_map(*[x for k, v in AGES.items() for x in (F.lit(k), F.lit(float(v)))])[F.col(c) if isinstance(c, str) else c]


def _lookup(values: dict) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v))])


def _versions(spark: SparkSession, d: str) -> DataFrame:
    """(page, at): per page one entry per round, the usable version delivered there and the last one up to it."""
    seen = round_table(spark, d).where("page <> ''").groupBy("page").agg(F.map_from_entries(F.collect_list(F.struct("run_id", F.when(F.col("substantive") == 1, F.col("content_hash")).alias("h")))).alias("m"))
    own = F.array(*[F.col("m")[r] for r in _RUNS])
    last = lambda i: F.coalesce(*[F.when(F.col("own")[j].isNotNull(), F.struct(F.col("own")[j].alias("h"), F.lit(j).alias("i"))) for j in range(i, -1, -1)])
    return seen.select("page", own.alias("own")).select("page", "own", F.array(*[last(i) for i in range(len(_RUNS))]).alias("asof"))


_VERSIONS_SQL = f"""rt as ({ETL_SQL["etl_round_table"]}), pages as (select distinct page from rt where page <> ''),
grid as (select page, r.run_id, r.i from pages cross join (values {", ".join(f"('{r}', {i})" for i, r in enumerate(_RUNS))}) r(run_id, i)),
own as (select g.page, g.run_id, g.i, case when rt.substantive = 1 then rt.content_hash end as h from grid g left join rt on rt.page = g.page and rt.run_id = g.run_id),
v as (select *, last_value(h ignore nulls) over w as ah, last_value(case when h is not null then i end ignore nulls) over w as ai, first_value(h ignore nulls) over (partition by page order by i rows between unbounded preceding and unbounded following) as eh
  from own window w as (partition by page order by i rows between unbounded preceding and current row))"""


def round_at(spark: SparkSession, d: str) -> DataFrame:
    """The last round whose age an event's time since the first event has reached, whatever was stored there."""
    first = table(spark, d, "events").agg(F.min(F.unix_timestamp(F.col("ts").cast("timestamp"))).alias("t0"))
    e = table(spark, d, "events").crossJoin(first).select("event_type", (F.unix_timestamp(F.col("ts").cast("timestamp")) - F.col("t0")).alias("t"))
    run = F.coalesce(*[F.when(F.col("t") >= AGES[r], r) for r in reversed(_RUNS)])
    return e.groupBy("event_type", run.alias("run_id")).agg(F.count("*").alias("n"))


def fallback_versions(spark: SparkSession, d: str) -> DataFrame:
    """Where the version used in each round comes from: delivered there, an earlier one, the first later one, or none."""
    v = _versions(spark, d).select("page", F.posexplode("own").alias("i", "h"), "asof", "own")
    kind = F.when(F.col("h").isNotNull(), "stored").when(F.col("asof")[F.col("i")].isNotNull(), "earlier").when(F.exists("own", lambda x: x.isNotNull()), "later").otherwise("missing")
    return v.groupBy(F.element_at(F.array(*[F.lit(r) for r in _RUNS]), F.col("i") + 1).alias("run_id"), kind.alias("kind")).agg(F.count("*").alias("n"))


def _compared(spark: SparkSession, d: str) -> DataFrame:
    """(page, a, b, outcome, moved): both as-of versions of every two rounds a < b of a page."""
    pairs = F.array(*[F.struct(F.lit(i).alias("a"), F.lit(j).alias("b")) for i in range(len(_RUNS)) for j in range(i + 1, len(_RUNS))])
    x = _versions(spark, d).select("page", "asof", F.explode(pairs).alias("p")).select("page", "p.*", F.col("asof")[F.col("p.a")].alias("x"), F.col("asof")[F.col("p.b")].alias("y"))
    outcome = F.when(F.col("x").isNull() | F.col("y").isNull(), "UNOBSERVABLE").when(F.col("x.h") == F.col("y.h"), "UNCHANGED").otherwise("CHANGED")
    return x.select("page", "a", "b", outcome.alias("outcome"), (F.col("x.i") != F.col("y.i")).alias("moved"))


_COMPARED_SQL = f"""{_VERSIONS_SQL}, c as (select x.page, x.i as a, y.i as b, case when x.ah is null or y.ah is null then 'UNOBSERVABLE' when x.ah = y.ah then 'UNCHANGED' else 'CHANGED' end as outcome, x.ai <> y.ai as moved from v x join v y on x.page = y.page and x.i < y.i)"""


def double_asof(spark: SparkSession, d: str) -> DataFrame:
    return _compared(spark, d).groupBy("a", "b", "outcome").agg(F.count("*").alias("n"))


def cross_round(spark: SparkSession, d: str) -> DataFrame:
    """Drift where the two versions compared were delivered in different rounds; the same version twice says nothing."""
    c = _compared(spark, d).where("moved and outcome <> 'UNOBSERVABLE'")
    return c.groupBy("a", "b").agg(F.count("*").alias("n"), F.sum(_int(F.col("outcome") == "CHANGED")).alias("n_changed"))


def age_bins(spark: SparkSession, d: str) -> DataFrame:
    """Drift by the age between two rounds, with a row of totals that must add up."""
    ages = F.array(*[F.lit(float(AGES[r])) for r in _RUNS])
    gap = ages[F.col("b")] - ages[F.col("a")]
    label = F.when(gap <= 3600, "1 up to 1 h").when(gap <= 86400, "2 up to 1 d").otherwise("3 beyond")
    c = _compared(spark, d).where("outcome <> 'UNOBSERVABLE'").select(label.alias("bin"), _int(F.col("outcome") == "CHANGED").alias("c"))
    g = c.rollup("bin").agg(F.count("*").alias("n"), F.sum("c").alias("n_changed"), F.grouping("bin").alias("g"))
    return g.where("g = 1 or bin is not null").select(F.when(F.col("g") == 1, "ALL").otherwise(F.col("bin")).alias("bin"), "n", "n_changed", F.round(F.col("n_changed") / F.col("n"), 6).alias("drift"))


def _questions(spark: SparkSession, d: str) -> DataFrame:
    """(run_id, query_id, freshness_class, outcome) of each question's first list in every later round."""
    m = table(spark, d, "url_manifest").select("run_id", "query_id", "freshness_class", "url_hash", F.lower("content_hash").alias("h"))
    first = m.where("run_id = 'run_00'").groupBy("query_id", "url_hash").agg(F.max("h").alias("h0"), F.min("freshness_class").alias("freshness_class"))
    later = m.where("run_id <> 'run_00'").groupBy("run_id", "query_id", "url_hash").agg(F.max("h").alias("h1"))
    j = first.join(later, ["query_id", "url_hash"]).withColumn("o", _int(F.col("h0") != F.col("h1")))
    q = j.groupBy("run_id", "query_id").agg(F.min("freshness_class").alias("freshness_class"), F.max("o").alias("any"), F.count("o").alias("known"), F.count("*").alias("n_urls"))
    return q.select("run_id", "query_id", "freshness_class", "n_urls", F.when(F.col("any") == 1, "CHANGED").when(F.col("known") == F.col("n_urls"), "UNCHANGED").otherwise("UNOBSERVABLE").alias("outcome"))


_QUESTIONS_SQL = """m as (select run_id, query_id, freshness_class, url_hash, lower(content_hash) as h from url_manifest),
f as (select query_id, url_hash, max(h) as h0, min(freshness_class) as freshness_class from m where run_id = 'run_00' group by 1, 2), l as (select run_id, query_id, url_hash, max(h) as h1 from m where run_id <> 'run_00' group by 1, 2, 3),
q0 as (select run_id, query_id, min(freshness_class) as freshness_class, max((h0 <> h1)::int) as c, count(h0 <> h1) as known, count(*) as n_urls from f join l using (query_id, url_hash) group by 1, 2),
q as (select run_id, query_id, freshness_class, n_urls, case when c = 1 then 'CHANGED' when known = n_urls then 'UNCHANGED' else 'UNOBSERVABLE' end as outcome from q0)"""


def common_support(spark: SparkSession, d: str) -> DataFrame:
    """Drift C / (C + U) and coverage (C + U) / all among questions met in both rounds."""
    c, u = F.sum(_int(F.col("outcome") == "CHANGED")), F.sum(_int(F.col("outcome") == "UNCHANGED"))
    return _questions(spark, d).groupBy("run_id", "freshness_class").agg(F.count("*").alias("n"), F.round(c / F.nullif(c + u, F.lit(0)), 6).alias("drift"), F.round((c + u) / F.count("*"), 6).alias("coverage"))


def strict_intersection(spark: SparkSession, d: str) -> DataFrame:
    """Drift of each later round on the questions that are determinate in all of them."""
    q = _questions(spark, d).where("outcome <> 'UNOBSERVABLE'")
    every = q.groupBy("query_id").agg(F.count("*").alias("k")).where(F.col("k") == len(_RUNS) - 1)
    return q.join(every, "query_id", "left_semi").groupBy("run_id").agg(F.count("*").alias("n"), F.sum(_int(F.col("outcome") == "CHANGED")).alias("n_changed"))


def drift_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Least and greatest drift if no or every unobservable question had changed."""
    c, x, n = F.sum(_int(F.col("outcome") == "CHANGED")), F.sum(_int(F.col("outcome") == "UNOBSERVABLE")), F.count("*")
    return _questions(spark, d).groupBy("run_id").agg(n.alias("n"), F.round(c / n, 6).alias("least"), F.round((c + x) / n, 6).alias("greatest"))


def by_depth(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes by the number of results that were compared."""
    depth = F.when(F.col("n_urls") <= 2, "1-2").when(F.col("n_urls") <= 5, "3-5").otherwise("6+")
    return _questions(spark, d).groupBy(depth.alias("depth"), "outcome").agg(F.count("*").alias("n"))


def depth_test(spark: SparkSession, d: str) -> DataFrame:
    """Exact test of changes seen in the first two results against all ten, on the same questions."""
    m = table(spark, d, "url_manifest").where("changed is not null and rank <= 10").groupBy("run_id", "query_id").agg(F.max(_int(F.col("changed") & (F.col("rank") <= 2))).alias("k2"), F.max(_int(F.col("changed"))).alias("k10"))
    g = m.groupBy("run_id").agg(F.count("*").alias("n"), F.sum(_int((F.col("k10") == 1) & (F.col("k2") == 0))).alias("b"), F.sum(_int((F.col("k2") == 1) & (F.col("k10") == 0))).alias("c"))
    return g.select("run_id", "n", "b", "c", F.round(mcnemar_exact(F.col("b"), F.col("c")), 9).alias("p"))


def observable_lift(spark: SparkSession, d: str) -> DataFrame:
    """Change rate over all results and over those with a known outcome, and the lift between them."""
    g = table(spark, d, "url_manifest").groupBy("run_id").agg(F.count("*").alias("n"), F.count("changed").alias("n_known"), F.coalesce(F.sum(_int(F.col("changed"))), F.lit(0)).alias("n_changed"))
    whole, known = F.col("n_changed") / F.col("n"), F.col("n_changed") / F.nullif(F.col("n_known"), F.lit(0))
    return g.select("run_id", "n", F.round(whole, 6).alias("rate_all"), F.round(known, 6).alias("rate_known"), F.round(known / F.nullif(whole, F.lit(0.0)), 6).alias("lift"))


def _predicted(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "url_manifest").where("changed is not null")
    p = m.where("run_id <> 'run_04'").groupBy("domain").agg(F.avg(F.col("changed").cast("double")).alias("p"))
    return m.where("run_id = 'run_04'").join(p, "domain")


def false_alarms(spark: SparkSession, d: str) -> DataFrame:
    """Shares of changed results predicted safe and of unchanged ones predicted stale."""
    j, stale = _predicted(spark, d), F.col("p") >= STALE
    safe, alarm = F.sum(_int(F.col("changed") & ~stale)), F.sum(_int(~F.col("changed") & stale))
    return j.agg(F.count("*").alias("n"), F.round(safe / F.sum(_int(F.col("changed"))), 6).alias("false_safe"), F.round(alarm / F.sum(_int(~F.col("changed"))), 6).alias("false_stale"))


def _rates(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "url_manifest").where("changed is not null and freshness_class is not null").groupBy("run_id", "freshness_class").agg(F.avg(F.col("changed").cast("double")).alias("p"), F.count("*").alias("n"))
    return g.withColumn("age", _age("run_id")).where("age > 0")


def clamped_half_lives(spark: SparkSession, d: str) -> DataFrame:
    """Half-lives made monotone: no slower class lives shorter than a faster one."""
    r = _rates(spark, d).where("p > 0 and p < 1").groupBy("freshness_class").agg((F.sum(decay_rate(F.col("p"), F.col("age")) * F.col("age")) / F.sum("age")).alias("rate"))
    place = _lookup({k: i for i, k in enumerate(ORDER)})[F.col("freshness_class")]
    up = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)  # one row per class
    h = r.select("freshness_class", place.alias("place"), (F.log(F.lit(2.0)) / F.col("rate")).alias("h")).where("place is not null")
    return h.select("freshness_class", F.round("h", 2).alias("half_life_s"), F.round(F.max("h").over(up), 2).alias("clamped_s"))


def calibration_cells(spark: SparkSession, d: str) -> DataFrame:
    """Per class and round of 30 results or more, the rate that the class's own decay predicts against what was seen; errors averaged in the row ALL."""
    r = _rates(spark, d).where("n >= 30")
    rate = r.groupBy("freshness_class").agg((F.sum(decay_rate(F.col("p"), F.col("age")) * F.col("age")) / F.sum("age")).alias("rate"))
    c = r.join(rate, "freshness_class").select("freshness_class", "run_id", "n", F.col("p").alias("seen"), (1 - F.exp(-F.col("rate") * F.col("age"))).alias("model")).withColumn("err", F.abs(F.col("seen") - F.col("model")))
    whole = c.agg(F.lit("ALL").alias("freshness_class"), F.lit("ALL").alias("run_id"), F.sum("n").alias("n"), F.round(F.avg("err"), 6).alias("err"), F.round(F.sum(F.col("err") * F.col("n")) / F.sum("n"), 6).alias("weighted_err"))
    return c.select("freshness_class", "run_id", "n", F.round("err", 6).alias("err"), F.round("err", 6).alias("weighted_err")).unionByName(whole)


def _volatility(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "url_manifest").where("run_id = 'run_04' and changed is not null").select("domain", "url_hash", "changed").distinct()
    return m.groupBy("domain").agg(F.count("*").alias("k"), F.avg(F.col("changed").cast("double")).alias("vol")).where("k >= 2").drop("k")


def _with_volatility(spark: SparkSession, d: str, rows: DataFrame) -> DataFrame:
    """``rows`` with ``volatility`` of their domain: its own, that of the domain above it, or the default."""
    v = _volatility(spark, d)
    above = F.regexp_replace("domain", r"^[^.]+\.", "")
    own, up = v.withColumnRenamed("vol", "own"), v.select(F.col("domain").alias("above"), F.col("vol").alias("up"))
    return rows.join(own, "domain", "left").withColumn("above", above).join(up, "above", "left").withColumn("volatility", F.coalesce("own", "up", F.lit(DEFAULT_VOLATILITY))).drop("above", "own", "up")


def noise(spark: SparkSession, d: str) -> DataFrame:
    """Changes taken for noise because their domain changes more than its class allows."""
    m = table(spark, d, "url_manifest").where("changed and freshness_class is not null and domain is not null").select("run_id", "freshness_class", "domain", "url_hash").distinct()
    ceiling = _lookup(CEILING)[F.col("freshness_class")]
    return _with_volatility(spark, d, m).groupBy("run_id", "freshness_class").agg(F.count("*").alias("n"), F.sum(_int(F.col("volatility") > ceiling)).alias("n_noise"))


def stale_sets(spark: SparkSession, d: str) -> DataFrame:
    """Pages with a change that is no noise, reported an hour or more after the first retrieval; the 12 h round stands in for the 24 h round as well."""
    m = table(spark, d, "url_manifest").where("freshness_class is not null and domain is not null")
    first = m.agg(F.min(F.to_timestamp("retrieval_timestamp")).alias("t0"))
    late = m.where("changed").crossJoin(first).where(F.to_timestamp("retrieval_timestamp") >= F.col("t0") + F.expr("interval 1 hour")).select("run_id", "freshness_class", "domain", "url_hash").distinct()
    kept = _with_volatility(spark, d, late).where(F.col("volatility") <= _lookup(CEILING)[F.col("freshness_class")]).select("run_id", "url_hash")
    return kept.unionByName(kept.where("run_id = 'run_02'").withColumn("run_id", F.lit("run_03"))).distinct().groupBy("run_id").agg(F.count("*").alias("n_pages"))


def volatility_bands(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "url_manifest").where("domain is not null").select("domain").distinct()
    band = F.when(F.col("volatility") < 0.1, "low").when(F.col("volatility") < 0.4, "middle").when(F.col("volatility") < 0.7, "high").otherwise("very high")
    return _with_volatility(spark, d, m).groupBy(band.alias("band")).agg(F.count("*").alias("n_domains"))


def recovered(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries that count as observable when the least length of a body that is no block page is lowered."""
    text = F.coalesce("extracted_text", F.lit(""))
    t = table(spark, d, "l3_cache").select("run_id", F.length(F.trim(text)).alias("k"), F.lower(F.substring(text, 1, 400)).rlike(BLOCKED).alias("blocked"))
    x = t.where("not blocked").select("run_id", "k", F.explode(F.array(*[F.lit(v) for v in (400, 200, 100, 50)])).alias("least"))
    return x.groupBy("run_id", "least").agg(F.sum(_int(F.col("k") >= F.col("least"))).alias("n"))


def identical_lists(spark: SparkSession, d: str) -> DataFrame:
    """Questions met again in a later round and the share whose list of URLs is the same, in whatever order."""
    m = table(spark, d, "url_manifest").groupBy("run_id", "query_id").agg(F.array_sort(F.collect_set("url_hash")).alias("s"))
    j = m.where("run_id <> 'run_00'").join(m.where("run_id = 'run_00'").select("query_id", F.col("s").alias("s0")), "query_id")
    return j.groupBy("run_id").agg(F.count("*").alias("n"), F.sum(_int(F.col("s") == F.col("s0"))).alias("n_same"), F.round(F.avg(_int(F.col("s") == F.col("s0"))), 6).alias("share"))


def reuse(spark: SparkSession, d: str) -> DataFrame:
    """Results of the first round whose URL was met before: by the same question, by another, or never; the parts add up to all."""
    m = table(spark, d, "url_manifest").where("run_id = 'run_00'").select("query_id", "rank", "url_hash").distinct()
    first = m.groupBy("url_hash").agg(F.min(F.struct("query_id", "rank")).alias("f"))
    kind = F.when((F.col("query_id") == F.col("f.query_id")) & (F.col("rank") == F.col("f.rank")), "first").when(F.col("query_id") == F.col("f.query_id"), "same question").otherwise("other question")
    g = m.join(first, "url_hash").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))
    return g.unionByName(g.agg(F.lit("ALL").alias("kind"), F.sum("n").alias("n")))


_VOL_SQL = "vol as (select domain, avg(changed::int) as vol from (select distinct domain, url_hash, changed from url_manifest where run_id = 'run_04' and changed is not null) group by 1 having count(*) >= 2)"
_VOLATILITY = "coalesce(o.vol, u.vol, 0.4) as volatility from {0} r left join vol o on o.domain = r.domain left join vol u on u.domain = regexp_replace(r.domain, '^[^.]+\\.', '')"
_CEILING = "case freshness_class " + " ".join(f"when '{k}' then {v}" for k, v in CEILING.items()) + " end"
_RATES_SQL = f"rates as (select * from (select run_id, freshness_class, {_AGE} as age, avg(changed::int) as p, count(*) as n from url_manifest where changed is not null and freshness_class is not null group by 1, 2, 3) where age > 0)"
_DECAY = "sum(-ln(1 - greatest(least(p, 0.99), 0.01))) / sum(age)"

QUERIES = {
    "join_round_at": round_at, "join_fallback_versions": fallback_versions, "join_double_asof": double_asof, "drift_cross_round": cross_round, "drift_age_bins": age_bins, "drift_common_support": common_support,
    "drift_strict_intersection": strict_intersection, "drift_bounds": drift_bounds, "drift_by_depth": by_depth, "drift_depth_test": depth_test, "drift_lift": observable_lift, "st_false_alarms": false_alarms,
    "st_clamped_half_lives": clamped_half_lives, "st_calibration_cells": calibration_cells, "etl_noise": noise, "etl_stale_sets": stale_sets, "fn_volatility_bands": volatility_bands, "etl_recovered": recovered,
    "drift_identical_lists": identical_lists, "st_reuse": reuse,
}
SQL = {
    "join_round_at": "with e as (select event_type, floor(epoch(ts)) - (select min(floor(epoch(ts))) from events) as t from events) select event_type, case " + " ".join(f"when t >= {AGES[r]} then '{r}'" for r in reversed(_RUNS)) + " end as run_id, count(*) as n from e group by 1, 2",
    "join_fallback_versions": f"with {_VERSIONS_SQL} select run_id, case when h is not null then 'stored' when ah is not null then 'earlier' when eh is not null then 'later' else 'missing' end as kind, count(*) as n from v group by 1, 2",
    "join_double_asof": f"with {_COMPARED_SQL} select a, b, outcome, count(*) as n from c group by 1, 2, 3",
    "drift_cross_round": f"with {_COMPARED_SQL} select a, b, count(*) as n, sum((outcome = 'CHANGED')::int) as n_changed from c where moved and outcome <> 'UNOBSERVABLE' group by 1, 2",
    "drift_age_bins": f"""
with {_COMPARED_SQL}, g as (select case b when 0 then 0 {" ".join(f"when {i} then {AGES[r]}" for i, r in enumerate(_RUNS) if i)} end - case a {" ".join(f"when {i} then {AGES[r]}" for i, r in enumerate(_RUNS))} end as gap, (outcome = 'CHANGED')::int as c from c where outcome <> 'UNOBSERVABLE'),
b as (select case when gap <= 3600 then '1 up to 1 h' when gap <= 86400 then '2 up to 1 d' else '3 beyond' end as bin, c from g)
select coalesce(bin, 'ALL') as bin, count(*) as n, sum(c) as n_changed, round(sum(c) / count(*), 6) as drift from b group by rollup (bin)""",
    "drift_common_support": f"""
with {_QUESTIONS_SQL}, g as (select run_id, freshness_class, count(*) as n, sum((outcome = 'CHANGED')::int) as c, sum((outcome = 'UNCHANGED')::int) as u from q group by 1, 2)
select run_id, freshness_class, n, round(c / nullif(c + u, 0), 6) as drift, round((c + u) / n, 6) as coverage from g""",
    "drift_strict_intersection": f"""
with {_QUESTIONS_SQL}, k as (select *, count(*) over (partition by query_id) as k from q where outcome <> 'UNOBSERVABLE')
select run_id, count(*) as n, sum((outcome = 'CHANGED')::int) as n_changed from k where k = {len(_RUNS) - 1} group by 1""",
    "drift_bounds": f"with {_QUESTIONS_SQL} select run_id, count(*) as n, round(avg((outcome = 'CHANGED')::int), 6) as least, round(avg((outcome <> 'UNCHANGED')::int), 6) as greatest from q group by 1",
    "drift_by_depth": f"with {_QUESTIONS_SQL} select case when n_urls <= 2 then '1-2' when n_urls <= 5 then '3-5' else '6+' end as depth, outcome, count(*) as n from q group by 1, 2",
    "drift_depth_test": f"""
with m as (select run_id, query_id, max((changed and rank <= 2)::int) as k2, max(changed::int) as k10 from url_manifest where changed is not null and rank <= 10 group by 1, 2),
g as (select run_id, count(*) as n, sum((k10 = 1 and k2 = 0)::int) as b, sum((k2 = 1 and k10 = 0)::int) as c from m group by 1) select run_id, n, b, c, round({_EXACT.format(b="b", c="c")}, 9) as p from g""",
    "drift_lift": """
with g as (select run_id, count(*) as n, count(changed) as k, coalesce(sum(changed::int), 0) as c from url_manifest group by 1)
select run_id, n, round(c / n, 6) as rate_all, round(c / nullif(k, 0), 6) as rate_known, round((c / nullif(k, 0)) / nullif(c / n, 0), 6) as lift from g""",
    "st_false_alarms": f"with {_P} select count(*) as n, round(sum((changed and p < {STALE})::int) / sum(changed::int), 6) as false_safe, round(sum((not changed and p >= {STALE})::int) / sum((not changed)::int), 6) as false_stale from j",
    "st_clamped_half_lives": f"""
with {_RATES_SQL}, h as (select freshness_class, case freshness_class {" ".join(f"when '{k}' then {i}" for i, k in enumerate(ORDER))} end as place, ln(2) / ({_DECAY}) as h from rates where p > 0 and p < 1 group by 1)
select freshness_class, round(h, 2) as half_life_s, round(max(h) over (order by place), 2) as clamped_s from h where place is not null""",
    "st_calibration_cells": f"""
with {_RATES_SQL}, k as (select * from rates where n >= 30), r as (select freshness_class, {_DECAY} as rate from k group by 1),
c as (select k.freshness_class, run_id, n, abs(p - (1 - exp(-rate * age))) as err from k join r using (freshness_class))
select freshness_class, run_id, n, round(err, 6) as err, round(err, 6) as weighted_err from c union all select 'ALL', 'ALL', sum(n)::bigint, round(avg(err), 6), round(sum(err * n) / sum(n), 6) from c""",
    "etl_noise": f"""
with {_VOL_SQL}, m as (select distinct run_id, freshness_class, domain, url_hash from url_manifest where changed and freshness_class is not null and domain is not null), x as (select r.*, {_VOLATILITY.format("m")})
select run_id, freshness_class, count(*) as n, sum((volatility > {_CEILING})::int) as n_noise from x group by 1, 2""",
    "etl_stale_sets": f"""
with {_VOL_SQL}, m as (select * from url_manifest where freshness_class is not null and domain is not null),
l as (select distinct run_id, freshness_class, domain, url_hash from m where changed and retrieval_timestamp::timestamptz >= (select min(retrieval_timestamp::timestamptz) from m) + interval 1 hour), x as (select r.*, {_VOLATILITY.format("l")}),
k as (select run_id, url_hash from x where volatility <= {_CEILING}) select run_id, count(*) as n_pages from (select * from k union select 'run_03', url_hash from k where run_id = 'run_02') group by 1""",
    "fn_volatility_bands": f"""
with {_VOL_SQL}, m as (select distinct domain from url_manifest where domain is not null), x as (select r.domain, {_VOLATILITY.format("m")})
select case when volatility < 0.1 then 'low' when volatility < 0.4 then 'middle' when volatility < 0.7 then 'high' else 'very high' end as band, count(*) as n_domains from x group by 1""",
    "etl_recovered": f"""
with t as (select run_id, length(trim({_TEXT}, ' ')) as k from l3_cache where not regexp_matches(lower(substring({_TEXT}, 1, 400)), '{BLOCKED}'))
select run_id, least_ as least, sum((k >= least_)::int) as n from t cross join (values (400), (200), (100), (50)) v(least_) group by 1, 2""",
    "drift_identical_lists": """
with m as (select run_id, query_id, list_sort(list(distinct url_hash)) as s from url_manifest group by 1, 2)
select a.run_id, count(*) as n, sum((a.s = b.s)::int) as n_same, round(avg((a.s = b.s)::int), 6) as share from m a join m b on a.query_id = b.query_id and b.run_id = 'run_00' where a.run_id <> 'run_00' group by 1""",
    "st_reuse": """
with m as (select distinct query_id, rank, url_hash from url_manifest where run_id = 'run_00'), f as (select *, first_value(query_id) over w as q0, row_number() over w as k from m window w as (partition by url_hash order by query_id, rank)),
g as (select case when k = 1 then 'first' when query_id = q0 then 'same question' else 'other question' end as kind, count(*) as n from f group by 1) select * from g union all select 'ALL', sum(n)::bigint from g""",
}
