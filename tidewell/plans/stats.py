"""Calibration, agreement and comparison statistics, skylines and profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.functions import text as T
from tidewell.functions.stats import decay_rate, mcnemar_exact, wilson
from tidewell.operators.running import with_running
from tidewell.plans.etl import AGES
from tidewell.session import table


def _int(c: Column) -> Column:
    return c.cast("int")


def change_rates(spark: SparkSession, d: str) -> DataFrame:
    """Change rate per round and class among known results, with Wilson bounds."""
    g = table(spark, d, "url_manifest").groupBy("run_id", "freshness_class").agg(F.count("changed").alias("n"), F.coalesce(F.sum(_int(F.col("changed"))), F.lit(0)).alias("n_changed"))
    low, high = wilson(F.col("n_changed"), F.col("n"))
    return g.select("run_id", "freshness_class", "n", "n_changed", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def half_lives(spark: SparkSession, d: str) -> DataFrame:
    """Half-life per class from the age-weighted mean of exponential rates over the later rounds."""
    age = F.create_map(*[x for k, v in AGES.items() for x in (F.lit(k), F.lit(float(v)))])[F.col("run_id")]
    g = table(spark, d, "url_manifest").where("changed is not null").groupBy("run_id", "freshness_class").agg(F.avg(F.col("changed").cast("double")).alias("p")).withColumn("age", age).where("age > 0 and p > 0 and p < 1")
    r = g.withColumn("rate", decay_rate(F.col("p"), F.col("age"))).groupBy("freshness_class").agg((F.sum(F.col("rate") * F.col("age")) / F.sum("age")).alias("rate"), F.count("*").alias("n_rounds"))
    return r.select("freshness_class", "n_rounds", F.round(F.log(F.lit(2.0)) / F.col("rate"), 2).alias("half_life_s"))


def domain_volatility(spark: SparkSession, d: str) -> DataFrame:
    """Mean change of domains with two known results or more in the last round."""
    m = table(spark, d, "url_manifest").where("run_id = 'run_04' and changed is not null").select("domain", "url_hash", "changed").distinct()
    return m.groupBy("domain").agg(F.count("*").alias("n"), F.round(F.avg(F.col("changed").cast("double")), 6).alias("volatility")).where("n >= 2")


def calibration(spark: SparkSession, d: str) -> DataFrame:
    """Expected calibration error (the row without bin) and its ten equal bins of a predicted change probability (the domain's share in the earlier rounds) against what happened."""
    m = table(spark, d, "url_manifest").where("changed is not null")
    p = m.where("run_id <> 'run_04'").groupBy("domain").agg(F.avg(F.col("changed").cast("double")).alias("p"))
    j = m.where("run_id = 'run_04'").join(p, "domain").withColumn("bin", F.least(F.floor(F.col("p") * 10), F.lit(9)).cast("int"))
    actual = F.avg(F.col("changed").cast("double"))
    bins = j.groupBy("bin").agg(F.count("*").alias("n"), F.round(actual, 6).alias("actual"), F.round(F.abs(actual - (F.col("bin") + 0.5) / 10), 6).alias("gap"))
    whole = bins.agg(F.lit(None).cast("int").alias("bin"), F.sum("n").alias("n"), F.lit(None).cast("double").alias("actual"), F.round(F.sum(F.col("n") * F.col("gap")) / F.sum("n"), 5).alias("gap"))
    return bins.unionByName(whole)


def auc(spark: SparkSession, d: str) -> DataFrame:
    """Area under the curve of that prediction by average ranks (ties count half)."""
    m = table(spark, d, "url_manifest").where("changed is not null")
    p = m.where("run_id <> 'run_04'").groupBy("domain").agg(F.avg(F.col("changed").cast("double")).alias("p"))
    j = m.where("run_id = 'run_04'").join(p, "domain").groupBy(F.round("p", 9).alias("p")).agg(F.sum(_int(F.col("changed"))).alias("pos"), F.sum(_int(~F.col("changed"))).alias("neg"))
    s = with_running(j, [F.col("p")], {"upto": F.col("neg")}).withColumn("under", F.col("upto") - F.col("neg"))
    return s.agg(F.round(F.sum(F.col("pos") * (F.col("under") + F.col("neg") / 2.0)) / (F.sum("pos") * F.sum("neg")), 6).alias("auc"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))


def _labels(spark: SparkSession, d: str) -> DataFrame:
    """One usable label per judge and item, the earliest."""
    both = table(spark, d, "judge_llama8b").unionByName(table(spark, d, "judge_qwen7b"))
    clean = F.regexp_replace(F.upper(F.trim(F.regexp_replace("label", r"\s+", " "))), r"[.\s]+$", "")
    r = both.select(F.to_json("sig").alias("item"), "sig", "judge", "utc", _int(clean == "INCORRECT").alias("wrong")).where(clean.isin("CORRECT", "INCORRECT"))
    return r.groupBy("sig.q", "sig.gold", "sig.ans", "judge").agg(F.min(F.struct(F.col("utc").isNull().alias("u"), "utc", "wrong")).alias("m")).select("q", "gold", "ans", "judge", "m.wrong")


def majority(spark: SparkSession, d: str) -> DataFrame:
    """Majority of the judges per item; ties are TIE."""
    g = _labels(spark, d).groupBy("q", "gold", "ans").agg(F.sum("wrong").alias("w"), F.count("*").alias("n"))
    kind = F.when(2 * F.col("w") > F.col("n"), "INCORRECT").when(2 * F.col("w") < F.col("n"), "CORRECT").otherwise("TIE")
    return g.groupBy(kind.alias("verdict"), "n").agg(F.count("*").alias("n_items"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    a = _labels(spark, d)
    keys = ["q", "gold", "ans"]
    same = reduce(lambda x, y: x & y, [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in keys])
    j = a.alias("x").join(a.alias("y"), same).where("x.judge < y.judge")
    c = lambda u, v: F.sum(_int((F.col("x.wrong") == u) & (F.col("y.wrong") == v)))
    return j.groupBy(F.col("x.judge").alias("judge_a"), F.col("y.judge").alias("judge_b")).agg(c(0, 0).alias("n00"), c(0, 1).alias("n01"), c(1, 0).alias("n10"), c(1, 1).alias("n11"))


def kappa(spark: SparkSession, d: str) -> DataFrame:
    """Cohen's kappa of every two judges, the exact McNemar test and its p by Holm's step-down."""
    p = _pairs(spark, d)
    n = F.col("n00") + F.col("n01") + F.col("n10") + F.col("n11")
    seen = (F.col("n00") + F.col("n11")) / n
    chance = ((F.col("n00") + F.col("n01")) * (F.col("n00") + F.col("n10")) + (F.col("n11") + F.col("n01")) * (F.col("n11") + F.col("n10"))) / (n * n)
    test = p.select("judge_a", "judge_b", n.alias("n"), F.round((seen - chance) / (1 - chance), 6).alias("kappa"), mcnemar_exact(F.col("n01"), F.col("n10")).alias("p"))
    w = Window.orderBy("p", "judge_a", "judge_b")  # one row per pair of judges
    m = F.count("*").over(Window.partitionBy())
    step = test.withColumn("step", F.least(F.lit(1.0), (m - F.row_number().over(w) + 1) * F.col("p")))
    return step.select("judge_a", "judge_b", "n", "kappa", F.round("p", 9).alias("p"), F.round(F.max("step").over(w.rowsBetween(Window.unboundedPreceding, 0)), 9).alias("p_holm"))


def fleiss(spark: SparkSession, d: str) -> DataFrame:
    """Fleiss' kappa over items with two labels or more."""
    g = _labels(spark, d).groupBy("q", "gold", "ans").agg(F.sum("wrong").alias("w"), F.count("*").alias("n")).where("n >= 2")
    agree = (F.col("w") * (F.col("w") - 1) + (F.col("n") - F.col("w")) * (F.col("n") - F.col("w") - 1)) / (F.col("n") * (F.col("n") - 1))
    s = g.agg(F.avg(agree).alias("p"), (F.sum("w") / F.sum("n")).alias("w"), F.count("*").alias("n_items"))
    chance = F.col("w") * F.col("w") + (1 - F.col("w")) * (1 - F.col("w"))
    return s.select("n_items", F.round((F.col("p") - chance) / (1 - chance), 6).alias("kappa"))


def cramer(spark: SparkSession, d: str) -> DataFrame:
    """Chi-squared and Cramer's V of source against class."""
    q = table(spark, d, "queries").where("source is not null and freshness_class is not null").select("query_id", "source", "freshness_class").distinct()
    o = q.groupBy("source", "freshness_class").agg(F.count("*").alias("o"))
    r, c = o.groupBy("source").agg(F.sum("o").alias("r")), o.groupBy("freshness_class").agg(F.sum("o").alias("c"))
    t = o.agg(F.sum("o").alias("t"))
    grid = r.crossJoin(c).crossJoin(t).join(o, ["source", "freshness_class"], "left")  # source x class cells
    e = F.col("r") * F.col("c") / F.col("t")
    chi = grid.agg(F.sum(F.pow(F.coalesce("o", F.lit(0)) - e, 2) / e).alias("chi2"), F.first("t").alias("t"), F.countDistinct("source").alias("k"), F.countDistinct("freshness_class").alias("m"))
    return chi.select(F.round("chi2", 4).alias("chi2"), F.round(F.sqrt(F.col("chi2") / F.col("t") / (F.least("k", "m") - 1)), 6).alias("v"))


def mean_difference(spark: SparkSession, d: str) -> DataFrame:
    """Standardised difference of text length between answers of two roles and the rest."""
    a = table(spark, d, "answers").where("answer is not null").select("key.role", F.length("answer").alias("n"))
    g = a.groupBy("role").agg(F.avg("n").alias("m"), F.var_pop("n").alias("v"))
    x, y = g.toDF("role_a", "ma", "va"), g.toDF("role_b", "mb", "vb")
    return x.crossJoin(y).where("role_a < role_b").select("role_a", "role_b", F.round((F.col("ma") - F.col("mb")) / F.sqrt((F.col("va") + F.col("vb")) / 2), 6).alias("smd"))


ORDER = ["REAL_TIME", "FAST", "MEDIUM", "SLOW", "TIMELESS"]  # fixed value: classes from fast to slow


def confusion(spark: SparkSession, d: str) -> DataFrame:
    """Class now against class before, with the share of its row (recall where they are the same) and the direction."""
    q = table(spark, d, "queries").where("original_freshness <> ''").select("query_id", "original_freshness", "freshness_class").distinct()
    g = q.groupBy("original_freshness", "freshness_class").agg(F.count("*").alias("n"))
    place = F.create_map(*[x for i, k in enumerate(ORDER) for x in (F.lit(k), F.lit(i))])
    now, was = place[F.col("freshness_class")], place[F.col("original_freshness")]
    side = F.when(now == was, "same").when(now > was, "slower").when(now < was, "faster").otherwise("unknown")  # slower keeps stale results longer
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("original_freshness")), 6)).withColumn("direction", side)


def percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Text length per source by four conventions: linear, the value at floor(p n), at round(p (n - 1)), and the median.

    Lengths are counted first; places are found among the running counts of distinct lengths, so no group is one buffer of its rows.
    """
    x = table(spark, d, "documents").where("text is not null").groupBy(F.lower(F.trim(F.coalesce("source", F.lit("")))).alias("source"), F.length("text").alias("v")).agg(F.count("*").alias("m"))
    up = x.withColumn("upto", F.sum("m").over(Window.partitionBy("source").orderBy("v")))  # one row per source and length
    n = x.groupBy("source").agg(F.sum("m").alias("n"), F.max("v").alias("longest"))
    at = {"low": F.floor(F.lit(0.9) * (F.col("n") - 1)), "high": F.ceil(F.lit(0.9) * (F.col("n") - 1)), "floor": F.floor(F.lit(0.9) * F.col("n")), "round": F.floor(F.lit(0.9) * (F.col("n") - 1) + 0.5), "m1": F.floor((F.col("n") - 1) / 2), "m2": F.ceil((F.col("n") - 1) / 2)}
    held = lambda k: (F.col("upto") > k) & (F.col("upto") - F.col("m") <= k)
    g = up.join(n, "source").groupBy("source", "n", "longest").agg(*[F.max(F.when(held(k), F.col("v"))).alias(name) for name, k in at.items()])
    part = F.lit(0.9) * (F.col("n") - 1) - F.floor(F.lit(0.9) * (F.col("n") - 1))
    return g.select("source", F.col("n").alias("n_texts"), F.round(F.col("low") + part * (F.col("high") - F.col("low")), 4).alias("p90_linear"), F.col("floor").alias("p90_floor"), F.col("round").alias("p90_round"), ((F.col("m1") + F.col("m2")) / 2).alias("median"), "longest")


def profile(spark: SparkSession, d: str) -> DataFrame:
    """Questions by class and language with totals."""
    q = table(spark, d, "queries").where("query is not null").select("query_id", "query", "freshness_class").distinct()
    x = q.withColumn("lang", T.language(F.col("query")))
    named = lambda c: F.when(F.grouping(c) == 1, F.lit("ALL")).otherwise(F.coalesce(c, F.lit("NONE")))
    repeats = (F.count("*") - F.countDistinct("query")) / F.count("*")
    return x.rollup("freshness_class", "lang").agg(named("freshness_class").alias("class"), named("lang").alias("language"), F.count("*").alias("n"), F.countDistinct("query").alias("n_texts"), F.round(repeats, 6).alias("repeat_rate")).drop("freshness_class", "lang")


def storage(spark: SparkSession, d: str) -> DataFrame:
    """Bytes of page text per round, all rows and distinct texts."""
    t = table(spark, d, "l3_cache").where("extracted_text <> ''").select("run_id", "extracted_text")
    one = t.groupBy("run_id", F.md5("extracted_text").alias("h")).agg(F.first(F.octet_length("extracted_text")).alias("b"), F.count("*").alias("n"))
    return one.groupBy("run_id").agg(F.sum(F.col("b") * F.col("n")).alias("bytes"), F.sum("b").alias("distinct_bytes"))


def skyline(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers whom none beats in both balance and revenue; a running maximum over ranges, not pairs."""
    rev = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
    s = table(spark, d, "supplier").select("s_suppkey", "s_acctbal").join(rev, F.col("s_suppkey") == F.col("l_suppkey")).select("s_suppkey", "s_acctbal", "revenue")
    cell = s.withColumn("cell", F.floor(F.col("s_acctbal") / 50))
    tops = cell.groupBy("cell").agg(F.max("revenue").alias("top"))
    above = tops.select("cell", F.max("top").over(Window.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, -1)).alias("above"))  # one row per range of balances
    inside = Window.partitionBy("cell").orderBy(F.desc("s_acctbal"))
    r = cell.join(above, "cell").withColumn("higher", F.max("revenue").over(inside.rangeBetween(Window.unboundedPreceding, -1)))
    r = r.withColumn("same", F.max("revenue").over(Window.partitionBy("cell", "s_acctbal")))
    return r.where("(above is null or revenue > above) and (higher is null or revenue > higher) and revenue = same").select("s_suppkey", "s_acctbal", "revenue")


def quantifiers(spark: SparkSession, d: str) -> DataFrame:
    """Questions all of whose results, or any of whose results, have a stored snapshot, per round."""
    m = table(spark, d, "url_manifest").groupBy("run_id", "query_id").agg(F.collect_set("snapshot_available").alias("s"))
    return m.groupBy("run_id").agg(F.sum(_int(F.forall("s", lambda x: x))).alias("n_all"), F.sum(_int(F.exists("s", lambda x: x))).alias("n_any"), F.count("*").alias("n"))


def transitions(spark: SparkSession, d: str) -> DataFrame:
    """Status classes of a page from one delivery to the next."""
    t = table(spark, d, "l3_cache").select("run_id", "canonical_url", F.coalesce((F.col("status_code") / 100).cast("int"), F.lit(0)).alias("s")).groupBy("canonical_url", "run_id").agg(F.max("s").alias("s"))
    w = Window.partitionBy("canonical_url").orderBy("run_id")
    return t.withColumn("before", F.lag("s").over(w)).where("before is not null").groupBy("before", F.col("s").alias("after")).agg(F.count("*").alias("n"))


def bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Paired cluster bootstrap: change rates of the last and the first later round on domains drawn anew 200 times.

    Weights are Poisson, from the digits of a hash of domain and draw; sums per draw are partial, so nothing is replicated through a shuffle.
    """
    k = lambda run, v: F.sum(F.when(F.col("run_id") == run, v).otherwise(0))
    changed = _int(F.col("changed"))
    m = table(spark, d, "url_manifest").where("changed is not null").groupBy("domain").agg(k("run_01", changed).alias("c1"), k("run_01", 1).alias("n1"), k("run_04", changed).alias("c4"), k("run_04", 1).alias("n4"))
    u = F.conv(F.substring(F.sha2(F.concat_ws("|", "domain", "rep"), 256), 1, 8), 16, 10).cast("double") / 4294967296.0
    weight = F.when(u < 0.367879, 0).when(u < 0.735759, 1).when(u < 0.919699, 2).when(u < 0.981012, 3).when(u < 0.996340, 4).otherwise(5)
    drawn = m.select("*", F.explode(F.sequence(F.lit(1), F.lit(200))).alias("rep")).withColumn("w", weight)
    rate = lambda i: F.sum(F.col(f"c{i}") * F.col("w")) / F.nullif(F.sum(F.col(f"n{i}") * F.col("w")), F.lit(0))
    r = drawn.groupBy("rep").agg((rate(4) - rate(1)).alias("gain"))
    return r.agg(F.count("gain").alias("n_draws"), F.round(F.percentile("gain", F.lit(0.025)), 6).alias("low"), F.round(F.percentile("gain", F.lit(0.975)), 6).alias("high"))


_LABELS = r"""lab as (select sig.q as q, sig.gold as gold, sig.ans as ans, judge, wrong from (
  select *, row_number() over (partition by sig, judge order by utc nulls last, wrong) as n from (
    select sig, judge, utc, (c = 'INCORRECT')::int as wrong from (
      select *, regexp_replace(upper(trim(regexp_replace(label, '\s+', ' ', 'g'))), '[.\s]+$', '') as c from (select * from judge_llama8b union all select * from judge_qwen7b)) where c in ('CORRECT', 'INCORRECT'))) where n = 1)"""
_EXACT = "case when {b} + {c} = 0 then 1.0 else least(1, 2 * list_sum(list_transform(range(0, (least({b}, {c}) + 1)::bigint), lambda i: exp(lgamma({b} + {c} + 1) - lgamma(i + 1) - lgamma({b} + {c} - i + 1) - ({b} + {c}) * ln(2))))) end"
_P = "p as (select domain, avg(changed::int) as p from url_manifest where changed is not null and run_id <> 'run_04' group by 1), j as (select m.changed, p.p from url_manifest m join p using (domain) where m.changed is not null and m.run_id = 'run_04')"
_AGE = "case run_id " + " ".join(f"when '{k}' then {v}" for k, v in AGES.items()) + " end"
_PLACE = "case {0} " + " ".join(f"when '{k}' then {i}" for i, k in enumerate(ORDER)) + " end"
_LANG = "case when length(regexp_replace(query, '[^가-힣]', '', 'g')) > 0.2 * length(regexp_replace(query, '[^A-Za-z가-힣]', '', 'g')) then 'ko' else 'en' end"

QUERIES = {
    "st_change_rates": change_rates, "st_half_lives": half_lives, "st_domain_volatility": domain_volatility, "st_calibration": calibration, "st_auc": auc, "st_majority": majority, "st_kappa": kappa,
    "st_fleiss": fleiss, "st_cramer": cramer, "st_mean_difference": mean_difference, "st_confusion": confusion, "st_percentiles": percentiles, "st_profile": profile, "st_storage": storage,
    "op_skyline": skyline, "st_quantifiers": quantifiers, "st_transitions": transitions, "st_bootstrap": bootstrap,
}
SQL = {
    "st_change_rates": """
with g as (select run_id, freshness_class, count(changed) as n, coalesce(sum(changed::int), 0) as n_changed from url_manifest group by 1, 2)
select run_id, freshness_class, n, n_changed,
  case when n > 0 then round(((n_changed / n + 3.8416 / (2.0 * n)) - 1.96 * sqrt((n_changed / n) * (1 - n_changed / n) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n), 6) end as low,
  case when n > 0 then round(((n_changed / n + 3.8416 / (2.0 * n)) + 1.96 * sqrt((n_changed / n) * (1 - n_changed / n) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n), 6) end as high from g""",
    "st_half_lives": f"""
with g as (select run_id, freshness_class, {_AGE} as age, avg(changed::int) as p from url_manifest where changed is not null group by 1, 2, 3),
r as (select freshness_class, count(*) as n_rounds, sum(-ln(1 - greatest(least(p, 0.99), 0.01))) / sum(age) as rate from g where age > 0 and p > 0 and p < 1 group by 1)
select freshness_class, n_rounds, round(ln(2) / rate, 2) as half_life_s from r""",
    "st_domain_volatility": "select domain, count(*) as n, round(avg(changed::int), 6) as volatility from (select distinct domain, url_hash, changed from url_manifest where run_id = 'run_04' and changed is not null) group by 1 having count(*) >= 2",
    "st_calibration": f"""
with {_P}, b as (select least(floor(p * 10), 9)::int as bin, count(*) as n, round(avg(changed::int), 6) as actual, round(abs(avg(changed::int) - (least(floor(p * 10), 9) + 0.5) / 10), 6) as gap from j group by least(floor(p * 10), 9))
select * from b union all select null, sum(n)::bigint, null, round(sum(n * gap) / sum(n), 5) from b""",
    "st_auc": f"""
with {_P}, r as (select changed, rank() over (order by round(p, 9)) + (count(*) over (partition by round(p, 9)) - 1) / 2.0 as k from j),
s as (select sum(case when changed then k end) as k, count(*) filter (changed) as pos, count(*) filter (not changed) as neg from r)
select round((k - pos * (pos + 1) / 2.0) / (pos * neg), 6) as auc, pos as n_pos, neg as n_neg from s""",
    "st_majority": f"with {_LABELS}, g as (select q, gold, ans, sum(wrong) as w, count(*) as n from lab group by 1, 2, 3) select case when 2 * w > n then 'INCORRECT' when 2 * w < n then 'CORRECT' else 'TIE' end as verdict, n, count(*) as n_items from g group by 1, 2",
    "st_kappa": f"""
with {_LABELS}, p as (select a.judge as judge_a, b.judge as judge_b, sum((a.wrong = 0 and b.wrong = 0)::int) as n00, sum((a.wrong = 0 and b.wrong = 1)::int) as n01, sum((a.wrong = 1 and b.wrong = 0)::int) as n10, sum((a.wrong = 1 and b.wrong = 1)::int) as n11
  from lab a join lab b on a.q is not distinct from b.q and a.gold is not distinct from b.gold and a.ans is not distinct from b.ans and a.judge < b.judge group by 1, 2),
k as (select judge_a, judge_b, n00 + n01 + n10 + n11 as n, (n00 + n11) / (n00 + n01 + n10 + n11) as s,
  ((n00 + n01) * (n00 + n10) + (n11 + n01) * (n11 + n10)) / ((n00 + n01 + n10 + n11) * (n00 + n01 + n10 + n11)) as c,
  {_EXACT.format(b="n01", c="n10")} as p from p),
h as (select *, least(1, (count(*) over () - row_number() over (order by p, judge_a, judge_b) + 1) * p) as step from k)
select judge_a, judge_b, n, round((s - c) / (1 - c), 6) as kappa, round(p, 9) as p, round(max(step) over (order by p, judge_a, judge_b), 9) as p_holm from h""",
    "st_fleiss": f"""
with {_LABELS}, g as (select sum(wrong) as w, count(*) as n from lab group by q, gold, ans having count(*) >= 2),
s as (select avg((w * (w - 1) + (n - w) * (n - w - 1)) / (n * (n - 1))) as p, sum(w) / sum(n) as w, count(*) as n_items from g)
select n_items, round((p - (w * w + (1 - w) * (1 - w))) / (1 - (w * w + (1 - w) * (1 - w))), 6) as kappa from s""",
    "st_cramer": """
with q as (select distinct query_id, source, freshness_class from queries where source is not null and freshness_class is not null), o as (select source, freshness_class, count(*) as o from q group by 1, 2),
r as (select source, sum(o) as r from o group by 1), c as (select freshness_class, sum(o) as c from o group by 1), t as (select sum(o) as t from o),
e as (select coalesce(o.o, 0) as o, r.r * c.c / t.t as e, t.t as t from r cross join c cross join t left join o on o.source = r.source and o.freshness_class = c.freshness_class),
x as (select sum(pow(o - e, 2) / e) as chi2, any_value(t) as t from e)
select round(chi2, 4) as chi2, round(sqrt(chi2 / t / (least((select count(*) from r), (select count(*) from c)) - 1)), 6) as v from x""",
    "st_mean_difference": """
with g as (select key.role as role, avg(length(answer)) as m, var_pop(length(answer)) as v from answers where answer is not null group by 1)
select a.role as role_a, b.role as role_b, round((a.m - b.m) / sqrt((a.v + b.v) / 2), 6) as smd from g a join g b on a.role < b.role""",
    "st_confusion": f"""
with g as (select original_freshness, freshness_class, count(*) as n from (select distinct query_id, original_freshness, freshness_class from queries where original_freshness <> '') group by 1, 2)
select original_freshness, freshness_class, n, round(n / sum(n) over (partition by original_freshness), 6) as share,
  case when a is null or b is null then 'unknown' when a = b then 'same' when a > b then 'slower' else 'faster' end as direction from (select *, {_PLACE.format("freshness_class")} as a, {_PLACE.format("original_freshness")} as b from g) x""",
    "st_percentiles": """
with x as (select lower(trim(coalesce(source, ''))) as source, length(text) as v from documents where text is not null), l as (select source, list_sort(list(v)) as l, count(*) as n from x group by 1)
select source, n as n_texts, round(list_aggregate(l, 'quantile_cont', 0.9), 4) as p90_linear, l[floor(0.9 * n)::bigint + 1] as p90_floor, l[floor(0.9 * (n - 1) + 0.5)::bigint + 1] as p90_round, list_aggregate(l, 'quantile_cont', 0.5) as median, l[n] as longest from l""",
    "st_profile": f"""
with x as (select distinct query_id, query, freshness_class, {_LANG} as lang from queries where query is not null)
select case when grouping(freshness_class) = 1 then 'ALL' else coalesce(freshness_class, 'NONE') end as class, case when grouping(lang) = 1 then 'ALL' else coalesce(lang, 'NONE') end as language,
  count(*) as n, count(distinct query) as n_texts, round((count(*) - count(distinct query)) / count(*), 6) as repeat_rate from x group by rollup (freshness_class, lang)""",
    "st_storage": """
with t as (select run_id, extracted_text as x, count(*) as n from l3_cache where extracted_text <> '' group by 1, 2)
select run_id, sum(octet_length(encode(x)) * n) as bytes, sum(octet_length(encode(x))) as distinct_bytes from t group by 1""",
    "st_bootstrap": """
with m as (select domain, sum(case when run_id = 'run_01' then changed::int else 0 end) as c1, sum((run_id = 'run_01')::int) as n1, sum(case when run_id = 'run_04' then changed::int else 0 end) as c4, sum((run_id = 'run_04')::int) as n4 from url_manifest where changed is not null group by 1),
u as (select m.*, rep, ('0x' || substring(sha256(concat_ws('|', domain, rep::varchar)), 1, 8))::bigint / 4294967296.0 as u from m cross join range(1, 201) t(rep)),
w as (select *, case when u < 0.367879 then 0 when u < 0.735759 then 1 when u < 0.919699 then 2 when u < 0.981012 then 3 when u < 0.996340 then 4 else 5 end as w from u),
g as (select sum(c4 * w) / nullif(sum(n4 * w), 0) - sum(c1 * w) / nullif(sum(n1 * w), 0) as gain from w group by rep)
select count(gain) as n_draws, round(quantile_cont(gain, 0.025), 6) as low, round(quantile_cont(gain, 0.975), 6) as high from g""",
    "op_skyline": """
with r as (select l_suppkey, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem group by 1), s as (select s_suppkey, s_acctbal, revenue from supplier join r on l_suppkey = s_suppkey)
select * from s a where not exists (select 1 from s b where b.s_acctbal >= a.s_acctbal and b.revenue >= a.revenue and (b.s_acctbal > a.s_acctbal or b.revenue > a.revenue))""",
    "st_quantifiers": """
with m as (select run_id, query_id, bool_and(snapshot_available) as a, bool_or(snapshot_available) as o from url_manifest group by 1, 2)
select run_id, sum(a::int) as n_all, sum(o::int) as n_any, count(*) as n from m group by 1""",
    "st_transitions": """
with t as (select canonical_url, run_id, max(coalesce(trunc(status_code / 100)::int, 0)) as s from l3_cache group by 1, 2), w as (select s, lag(s) over (partition by canonical_url order by run_id) as before from t)
select before, s as after, count(*) as n from w where before is not null group by 1, 2""",
}
