"""Agreement, intervals and comparisons over judges' labels, answers and change rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.functions.stats import binomial_upper
from tidewell.plans.stats import _LABELS, _int, _labels, _pairs
from tidewell.session import table

ITEM = ["q", "gold", "ans"]


def changed_labels(spark: SparkSession, d: str) -> DataFrame:
    """Items on which two judges of one family differ, by the transition between their labels (a missing label is one, too)."""
    lab = _labels(spark, d).where(F.col("judge").isin("llama8b", "llama8b_p2"))
    side = lambda j: F.max(F.when(F.col("judge") == j, F.when(F.col("wrong") == 1, "INCORRECT").otherwise("CORRECT")))
    g = lab.groupBy(*ITEM).agg(side("llama8b").alias("a"), side("llama8b_p2").alias("b"))
    return g.where(~F.col("a").eqNullSafe(F.col("b"))).groupBy("a", "b").agg(F.count("*").alias("n"))


def audit(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts of two arms on the items that both saw, abstentions included: counts, and the share of what the first arm called right."""
    both = table(spark, d, "judge_llama8b").where("judge = 'llama8b'").select("sig", "label", "utc").withColumn("arm", F.lit("a")).unionByName(table(spark, d, "judge_qwen7b").where("judge = 'qwen7b'").select("sig", "label", "utc").withColumn("arm", F.lit("b")))
    clean = F.regexp_replace(F.upper(F.trim(F.regexp_replace("label", r"\s+", " "))), r"[.\s]+$", "")
    said = F.when(clean.isin("CORRECT", "INCORRECT"), clean).otherwise("ABSTAIN")
    first = both.select("sig", "arm", said.alias("said"), "utc").groupBy("sig", "arm").agg(F.min(F.struct(F.col("utc").isNull().alias("u"), "utc", "said")).alias("m")).select("sig", "arm", "m.said")
    g = first.groupBy("sig").agg(F.max(F.when(F.col("arm") == "a", F.col("said"))).alias("a"), F.max(F.when(F.col("arm") == "b", F.col("said"))).alias("b")).where("a is not null and b is not null").groupBy("a", "b").agg(F.count("*").alias("n"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("a")), 6))


def paired_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Difference between two judges' rates of INCORRECT on common items, with the Wald interval of the discordant pairs."""
    p = _pairs(spark, d)
    n, b, c = F.col("n00") + F.col("n01") + F.col("n10") + F.col("n11"), F.col("n01"), F.col("n10")
    half = 1.96 * F.sqrt(b + c - F.pow(b - c, 2) / n) / n
    return p.select("judge_a", "judge_b", n.alias("n"), F.round((b - c) / n, 6).alias("difference"), F.round((b - c) / n - half, 6).alias("low"), F.round((b - c) / n + half, 6).alias("high"))


def clustered_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Change rate per class with the interval of independent results and the one robust to clusters (domains)."""
    m = table(spark, d, "url_manifest").where("changed is not null and freshness_class is not null").groupBy("freshness_class", "domain").agg(F.sum(_int(F.col("changed"))).cast("double").alias("c"), F.count("*").cast("double").alias("n"))
    whole = m.groupBy("freshness_class").agg((F.sum("c") / F.sum("n")).alias("p"), F.sum("n").alias("all_n"), F.count("*").alias("g"))
    # Residuals of the clusters around the whole rate, expanded so that one pass over the clusters does.
    sums = m.groupBy("freshness_class").agg(F.sum(F.col("c") * F.col("c")).alias("cc"), F.sum(F.col("c") * F.col("n")).alias("cn"), F.sum(F.col("n") * F.col("n")).alias("nn"))
    j = whole.join(sums, "freshness_class")
    p, n, g = F.col("p"), F.col("all_n"), F.col("g")
    robust = F.sqrt(F.greatest(F.col("cc") - 2 * p * F.col("cn") + p * p * F.col("nn"), F.lit(0.0)) * g / (g - 1)) / n
    return j.where("g > 1").select("freshness_class", n.cast("long").alias("n"), F.col("g").alias("n_clusters"), F.round(p, 6).alias("rate"), F.round(1.96 * F.sqrt(p * (1 - p) / n), 6).alias("half_simple"), F.round(1.96 * robust, 6).alias("half_clustered"))


def sampled_interval(spark: SparkSession, d: str) -> DataFrame:
    """A tenth of the questions drawn by hash: share of a class with the Wald interval corrected for the finite population."""
    q = table(spark, d, "queries").where("query is not null and freshness_class is not null").select("query_id", "freshness_class").distinct()
    drawn = F.conv(F.substring(F.sha2("query_id", 256), 1, 4), 16, 10).cast("int") < 6554
    g = q.agg(F.count("*").alias("big"), F.sum(_int(drawn)).alias("n"))
    c = q.where(drawn).groupBy("freshness_class").agg(F.count("*").alias("k")).crossJoin(g)
    p = F.col("k") / F.col("n")
    return c.select("freshness_class", "k", "n", F.round(p, 6).alias("share"), F.round(1.96 * F.sqrt(p * (1 - p) / F.col("n") * (1 - F.col("n") / F.col("big"))), 6).alias("half"))


def rare_upper(spark: SparkSession, d: str) -> DataFrame:
    """Clopper-Pearson upper bound (95 %, one-sided) of the share of refused fetches per round."""
    g = table(spark, d, "l3_cache").where("status_code is not null").groupBy("run_id").agg(F.sum(_int(F.col("status_code") == 403)).alias("k"), F.count("*").alias("n"))
    return g.select("run_id", "k", "n", F.round(binomial_upper(F.col("k"), F.col("n")), 6).alias("upper"))


def leave_one_out(spark: SparkSession, d: str) -> DataFrame:
    """Change rate of the last round without each domain, against the whole."""
    m = table(spark, d, "url_manifest").where("run_id = 'run_04' and changed is not null").groupBy("domain").agg(F.sum(_int(F.col("changed"))).alias("c"), F.count("*").alias("n"))
    whole = m.agg(F.sum("c").alias("all_c"), F.sum("n").alias("all_n"))
    rate, rest = F.col("all_c") / F.col("all_n"), (F.col("all_c") - F.col("c")) / (F.col("all_n") - F.col("n"))
    return m.crossJoin(whole).where("all_n > n").select("domain", "n", F.round(rest, 9).alias("rate_without"), F.round(rest - rate, 9).alias("contrast"))


def seed_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Mean over ten hashed replicates of the questions, plus or minus 1.96 deviations over the root of ten."""
    m = table(spark, d, "url_manifest").where("changed is not null")
    seed = F.conv(F.substring(F.sha2("query_id", 256), 1, 4), 16, 10).cast("int") % 10
    r = m.groupBy("freshness_class", seed.alias("seed")).agg(F.avg(F.col("changed").cast("double")).alias("p"))
    half = 1.96 * F.stddev_samp("p") / F.sqrt(F.count("*"))
    return r.groupBy("freshness_class").agg(F.count("*").alias("n_seeds"), F.round(F.avg("p"), 6).alias("mean"), F.round(half, 6).alias("half"))


def length_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Mean length of answers per role with a bootstrap over answers: Poisson weights by hash, summed per draw."""
    a = table(spark, d, "answers").where("answer is not null").select("key.role", F.concat_ws("|", "key.role", "key.ctx_sha", "key.q_sha", "answer", "utc").alias("id"), F.length("answer").alias("len"))
    x = a.select("role", "len", "id", F.explode(F.sequence(F.lit(1), F.lit(50))).alias("rep"))
    u = F.conv(F.substring(F.md5(F.concat_ws("|", "id", "rep")), 1, 8), 16, 10).cast("double") / 4294967296.0
    w = F.when(u < 0.367879, 0).when(u < 0.735759, 1).when(u < 0.919699, 2).when(u < 0.981012, 3).when(u < 0.996340, 4).otherwise(5)
    r = x.withColumn("w", w).groupBy("role", "rep").agg((F.sum(F.col("len") * F.col("w")) / F.sum("w")).alias("m"))
    return r.groupBy("role").agg(F.round(F.percentile("m", F.lit(0.025)), 4).alias("low"), F.round(F.percentile("m", F.lit(0.5)), 4).alias("mid"), F.round(F.percentile("m", F.lit(0.975)), 4).alias("high"))


def parsed(reply: Column) -> Column:
    """Verdict of a free-text reply: the token that stands first, INCORRECT being looked for before CORRECT at one place."""
    token = F.regexp_extract(F.upper(reply), r"\b(INCORRECT|CORRECT)\b", 1)
    return F.when(token == "", "UNPARSED").otherwise(token)


def parsed_replies(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts read from the replies against the labels that were stored."""
    both = table(spark, d, "judge_llama8b").unionByName(table(spark, d, "judge_qwen7b"))
    clean = F.regexp_replace(F.upper(F.trim(F.regexp_replace(F.coalesce("label", F.lit("")), r"\s+", " "))), r"[.\s]+$", "")
    return both.groupBy("judge", parsed(F.coalesce("raw", F.lit(""))).alias("parsed"), F.when(clean.isin("CORRECT", "INCORRECT"), clean).otherwise("UNPARSED").alias("stored")).agg(F.count("*").alias("n"))


def reply_kappa(spark: SparkSession, d: str) -> DataFrame:
    """Cohen's kappa of the two leading judges' parsed replies by kind of reference."""
    arm = lambda name, judge: table(spark, d, name).where(F.col("judge") == judge).select("sig", parsed(F.coalesce("raw", F.lit(""))).alias("p"), "utc").where("p <> 'UNPARSED'").groupBy("sig").agg(F.min(F.struct(F.col("utc").isNull().alias("u"), "utc", "p")).alias("m")).select("sig", F.col("m.p").alias(judge))
    j = arm("judge_llama8b", "llama8b").join(arm("judge_qwen7b", "qwen7b"), "sig")
    x, y = _int(F.col("llama8b") == "INCORRECT"), _int(F.col("qwen7b") == "INCORRECT")
    g = j.groupBy(F.when(F.col("sig.gold").rlike("[0-9]"), "number").otherwise("text").alias("kind")).agg(F.count("*").alias("n"), F.avg(_int(x == y)).alias("s"), F.avg(x).alias("a"), F.avg(y).alias("b"))
    chance = F.col("a") * F.col("b") + (1 - F.col("a")) * (1 - F.col("b"))
    return g.select("kind", "n", F.round((F.col("s") - chance) / (1 - chance), 6).alias("kappa"))


def plain_answer(text: Column) -> Column:
    """Lower case, letters, digits and Hangul alone, spaces single."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9가-힣 ]", ""), " +", " "))


def answer_match(spark: SparkSession, d: str) -> DataFrame:
    """Items whose answer is the reference or holds it (references of 40 characters at most), per judge and verdict."""
    lab = _labels(spark, d)
    g, a = plain_answer(F.col("gold")), plain_answer(F.col("ans"))
    match = (g != "") & ((g == a) | (F.length(g) <= 40) & a.contains(g))
    return lab.groupBy("judge", "wrong").agg(F.count("*").alias("n"), F.sum(_int(match)).alias("n_match"))


# Kinds of reference, the first that fits counts.
KINDS = (("date", "^(19|20)[0-9]{2}([-년/].*)?$|january|february|march|april|may [0-9]|june|july|august|september|october|november|december"), ("percentage", "%|percent|퍼센트"), ("price", "crown|크라운|[$€₩]"), ("score", "^[0-9]+ ?- ?[0-9]+$"), ("number", "^[0-9][0-9,. ]*( .*)?$"))


def reference_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of references and how many answers hold the same numbers, the deterministic grade of the kinds with numbers."""
    i = _labels(spark, d).select(*ITEM).distinct()
    gold = F.trim(F.lower(F.coalesce("gold", F.lit(""))))
    kind = F.coalesce(*[F.when(gold.rlike(p), k) for k, p in KINDS], F.when(F.length(gold) <= 40, "short_entity"), F.lit("other"))
    numbers = lambda c: F.array_sort(F.array_distinct(F.regexp_extract_all(F.regexp_replace(F.coalesce(c, F.lit("")), "(?<=[0-9]),(?=[0-9])", ""), F.lit("[0-9]+"), 0)))
    held = F.size(F.array_except(numbers(F.col("gold")), numbers(F.col("ans")))) == 0
    return i.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.sum(_int(held & (F.size(numbers(F.col("gold"))) > 0))).alias("n_held"))


def exact_forms(spark: SparkSession, d: str) -> DataFrame:
    """Distinct questions, and distinct ones after case, white space and final punctuation are made even."""
    q = table(spark, d, "queries").where("query is not null").select("source", "query").distinct()
    form = F.regexp_replace(F.trim(F.regexp_replace(F.lower("query"), r"\s+", " ")), r"[?!.,;: ]+$", "")
    return q.groupBy("source").agg(F.count("*").alias("n"), F.countDistinct(form).alias("n_forms"))


def answer_sets(spark: SparkSession, d: str) -> DataFrame:
    """Questions answered in two roles or more: whether the sets of their answers agree whatever the order."""
    a = table(spark, d, "answers").where("answer is not null").select("key.role", "key.q_sha", plain_answer(F.col("answer")).alias("a")).where("a <> ''")
    s = a.groupBy("q_sha", "role").agg(F.array_sort(F.collect_set("a")).alias("s"))
    g = s.groupBy("q_sha").agg(F.count("*").alias("roles"), F.countDistinct("s").alias("sets")).where("roles >= 2")
    return g.groupBy("roles").agg(F.count("*").alias("n"), F.sum(_int(F.col("sets") == 1)).alias("n_same"))


def class_from_answers(spark: SparkSession, d: str) -> DataFrame:
    """Questions asked for several years: the share of distinct answers tells how fast they change."""
    q = table(spark, d, "queries").where("query is not null").select("query").distinct()
    y = q.select(F.regexp_replace("query", "20[0-9]{2}", "#").alias("form"), F.regexp_extract("query", "(20[0-9]{2})", 1).alias("year"), F.substring(F.sha2("query", 256), 1, 16).alias("sha")).where("year <> ''")
    a = table(spark, d, "answers").where("answer is not null").select(F.col("key.q_sha").alias("sha"), plain_answer(F.col("answer")).alias("a")).groupBy("sha").agg(F.min("a").alias("a"))
    g = y.join(a, "sha").groupBy("form").agg(F.countDistinct("year").alias("years"), F.countDistinct("a").alias("answers")).where("years >= 2")
    ratio = F.col("answers") / F.col("years")
    kind = F.when(ratio >= 0.75, "FAST").when(ratio >= 0.40, "MEDIUM").when(ratio >= 0.10, "SLOW").otherwise("TIMELESS")
    return g.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.sum("years").alias("n_years"))


def coverage(spark: SparkSession, d: str) -> DataFrame:
    """Questions with an answer, per class and in all."""
    q = table(spark, d, "queries").where("query is not null").select("query_id", "freshness_class", F.substring(F.sha2("query", 256), 1, 16).alias("sha")).distinct()
    done = table(spark, d, "answers").where("answer is not null").select(F.col("key.q_sha").alias("sha")).distinct().withColumn("ok", F.lit(1))
    x = q.join(done, "sha", "left").select(F.coalesce("freshness_class", F.lit("NONE")).alias("c"), F.coalesce("ok", F.lit(0)).alias("ok"))
    return x.rollup("c").agg(F.count("*").alias("n"), F.sum("ok").alias("n_answered"), F.round(F.avg("ok"), 6).alias("share")).select(F.coalesce("c", F.lit("ALL")).alias("freshness_class"), "n", "n_answered", "share")


_U = "('0x' || substring({0}, 1, 8))::bigint / 4294967296.0"
_W = "case when u < 0.367879 then 0 when u < 0.735759 then 1 when u < 0.919699 then 2 when u < 0.981012 then 3 when u < 0.996340 then 4 else 5 end"
_SEED = "('0x' || substring(sha256(query_id), 1, 4))::int"
_CLEAN = r"regexp_replace(upper(trim(regexp_replace(coalesce(label, ''), '\s+', ' ', 'g'))), '[.\s]+$', '')"
_TOKEN = r"coalesce(nullif(regexp_extract(upper(coalesce(raw, '')), '\b(INCORRECT|CORRECT)\b', 1), ''), 'UNPARSED')"
_PLAIN = "trim(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9가-힣 ]', '', 'g'), ' +', ' ', 'g'))"
_NUMS = r"list_sort(list_distinct(regexp_extract_all(regexp_replace(coalesce({0}, ''), '([0-9]),([0-9])', '\1\2', 'g'), '[0-9]+')))"
_GOLD = "trim(lower(coalesce(gold, '')))"
_PAIR = """p as (select a.judge as judge_a, b.judge as judge_b, count(*) as n, sum((a.wrong = 0 and b.wrong = 1)::int) as b, sum((a.wrong = 1 and b.wrong = 0)::int) as c
  from lab a join lab b on a.q is not distinct from b.q and a.gold is not distinct from b.gold and a.ans is not distinct from b.ans and a.judge < b.judge group by 1, 2)"""

QUERIES = {
    "st_changed_labels": changed_labels, "st_audit": audit, "st_paired_intervals": paired_intervals, "st_clustered_intervals": clustered_intervals, "st_sampled_interval": sampled_interval, "st_rare_upper": rare_upper,
    "st_leave_one_out": leave_one_out, "st_seed_intervals": seed_intervals, "st_length_bootstrap": length_bootstrap, "fn_parsed_replies": parsed_replies, "st_reply_kappa": reply_kappa, "fn_answer_match": answer_match,
    "fn_reference_kinds": reference_kinds, "fn_exact_forms": exact_forms, "st_answer_sets": answer_sets, "fn_class_from_answers": class_from_answers, "st_coverage": coverage,
}
SQL = {
    "st_changed_labels": f"""
with {_LABELS}, g as (select q, gold, ans, max(case when judge = 'llama8b' then case wrong when 1 then 'INCORRECT' else 'CORRECT' end end) as a, max(case when judge = 'llama8b_p2' then case wrong when 1 then 'INCORRECT' else 'CORRECT' end end) as b
  from lab where judge in ('llama8b', 'llama8b_p2') group by 1, 2, 3) select a, b, count(*) as n from g where a is distinct from b group by 1, 2""",
    "st_audit": f"""
with r as (select sig, 'a' as arm, label, utc from judge_llama8b where judge = 'llama8b' union all select sig, 'b', label, utc from judge_qwen7b where judge = 'qwen7b'),
s as (select sig, arm, utc, case when {_CLEAN} in ('CORRECT', 'INCORRECT') then {_CLEAN} else 'ABSTAIN' end as said from r),
f as (select sig, arm, said from (select *, row_number() over (partition by sig, arm order by utc nulls last, said) as n from s) where n = 1),
g as (select a.said as a, b.said as b, count(*) as n from f a join f b on a.sig = b.sig and a.arm = 'a' and b.arm = 'b' group by 1, 2) select a, b, n, round(n / sum(n) over (partition by a), 6) as share from g""",
    "st_paired_intervals": f"with {_LABELS}, {_PAIR}, h as (select *, 1.96 * sqrt(b + c - pow(b - c, 2) / n) / n as half from p) select judge_a, judge_b, n, round((b - c) / n, 6) as difference, round((b - c) / n - half, 6) as low, round((b - c) / n + half, 6) as high from h",
    "st_clustered_intervals": """
with m as (select freshness_class, domain, sum(changed::int)::double as c, count(*)::double as n from url_manifest where changed is not null and freshness_class is not null group by 1, 2),
w as (select freshness_class, sum(c) / sum(n) as p, sum(n) as n, count(*) as g from m group by 1), r as (select w.freshness_class, sum(pow(m.c - w.p * m.n, 2)) as s from m join w using (freshness_class) group by 1)
select w.freshness_class, n::bigint as n, g as n_clusters, round(p, 6) as rate, round(1.96 * sqrt(p * (1 - p) / n), 6) as half_simple, round(1.96 * sqrt(s * g / (g - 1)) / n, 6) as half_clustered from w join r using (freshness_class) where g > 1""",
    "st_sampled_interval": f"""
with q as (select distinct query_id, freshness_class from queries where query is not null and freshness_class is not null), g as (select count(*) as big, sum(({_SEED} < 6554)::int) as n from q),
c as (select freshness_class, count(*) as k from q where {_SEED} < 6554 group by 1)
select freshness_class, k, n, round(k / n, 6) as share, round(1.96 * sqrt((k / n) * (1 - k / n) / n * (1 - n / big)), 6) as half from c cross join g""",
    "st_rare_upper": """
with recursive g as (select run_id, sum((status_code = 403)::int)::bigint as k, count(*) as n from l3_cache where status_code is not null group by 1),
b as (select run_id, k, n, 0.0::double as lo, 1.0::double as hi, 0 as step from g
  union all select run_id, k, n, case when t > 0.05 then mid else lo end, case when t > 0.05 then hi else mid end, step + 1 from (
    select *, (lo + hi) / 2 as mid, list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln((lo + hi) / 2) + (n - i) * ln(1 - (lo + hi) / 2)))) as t from b where step < 40))
select run_id, k, n, round(case when k >= n then 1 else (lo + hi) / 2 end, 6) as upper from b where step = 40""",
    "st_leave_one_out": """
with m as (select domain, sum(changed::int) as c, count(*) as n from url_manifest where run_id = 'run_04' and changed is not null group by 1), w as (select *, sum(c) over () as ac, sum(n) over () as an from m)
select domain, n, round((ac - c) / (an - n), 9) as rate_without, round((ac - c) / (an - n) - ac / an, 9) as contrast from w where an > n""",
    "st_seed_intervals": f"""
with r as (select freshness_class, {_SEED} % 10 as seed, avg(changed::int) as p from url_manifest where changed is not null group by 1, 2)
select freshness_class, count(*) as n_seeds, round(avg(p), 6) as mean, round(1.96 * stddev_samp(p) / sqrt(count(*)), 6) as half from r group by 1""",
    "st_length_bootstrap": f"""
with a as (select key.role as role, concat_ws('|', key.role, key.ctx_sha, key.q_sha, answer, utc) as id, length(answer) as len from answers where answer is not null),
x as (select role, len, rep, {_U.format("md5(concat_ws('|', id, rep::varchar))")} as u from a cross join range(1, 51) t(rep)), r as (select role, rep, sum(len * w) / sum(w) as m from (select *, {_W} as w from x) group by 1, 2)
select role, round(quantile_cont(m, 0.025), 4) as low, round(quantile_cont(m, 0.5), 4) as mid, round(quantile_cont(m, 0.975), 4) as high from r group by 1""",
    "fn_parsed_replies": f"select judge, {_TOKEN} as parsed, case when {_CLEAN} in ('CORRECT', 'INCORRECT') then {_CLEAN} else 'UNPARSED' end as stored, count(*) as n from (select * from judge_llama8b union all select * from judge_qwen7b) group by 1, 2, 3",
    "st_reply_kappa": f"""
with r as (select sig, judge, {_TOKEN} as p, utc from (select * from judge_llama8b union all select * from judge_qwen7b) where judge in ('llama8b', 'qwen7b')),
f as (select sig, judge, p from (select *, row_number() over (partition by sig, judge order by utc nulls last, p) as n from r where p <> 'UNPARSED') where n = 1),
j as (select case when regexp_matches(a.sig.gold, '[0-9]') then 'number' else 'text' end as kind, (a.p = 'INCORRECT')::int as x, (b.p = 'INCORRECT')::int as y from f a join f b on a.sig = b.sig and a.judge = 'llama8b' and b.judge = 'qwen7b'),
g as (select kind, count(*) as n, avg((x = y)::int) as s, avg(x) * avg(y) + (1 - avg(x)) * (1 - avg(y)) as c from j group by 1) select kind, n, round((s - c) / (1 - c), 6) as kappa from g""",
    "fn_answer_match": f"""
with {_LABELS}, x as (select judge, wrong, {_PLAIN.format("gold")} as g, {_PLAIN.format("ans")} as a from lab)
select judge, wrong, count(*) as n, sum((g <> '' and (g = a or length(g) <= 40 and contains(a, g)))::int) as n_match from x group by 1, 2""",
    "fn_reference_kinds": f"""
with {_LABELS}, i as (select distinct q, gold, ans from lab)
select case {" ".join(f"when regexp_matches({_GOLD}, '{p}') then '{k}'" for k, p in KINDS)} when length({_GOLD}) <= 40 then 'short_entity' else 'other' end as kind, count(*) as n,
  sum((len({_NUMS.format("gold")}) > 0 and len(list_filter({_NUMS.format("gold")}, lambda v: not list_contains({_NUMS.format("ans")}, v))) = 0)::int) as n_held from i group by 1""",
    "fn_exact_forms": r"select source, count(*) as n, count(distinct regexp_replace(trim(regexp_replace(lower(query), '\s+', ' ', 'g'), ' '), '[?!.,;: ]+$', '')) as n_forms from (select distinct source, query from queries where query is not null) group by 1",
    "st_answer_sets": f"""
with a as (select key.role as role, key.q_sha as q, {_PLAIN.format("answer")} as a from answers where answer is not null), s as (select q, role, list_sort(list(distinct a)) as s from a where a <> '' group by 1, 2),
g as (select q, count(*) as roles, count(distinct s) as sets from s group by 1 having count(*) >= 2) select roles, count(*) as n, sum((sets = 1)::int) as n_same from g group by 1""",
    "fn_class_from_answers": f"""
with y as (select regexp_replace(query, '20[0-9]{{2}}', '#', 'g') as form, regexp_extract(query, '(20[0-9]{{2}})', 1) as year, substring(sha256(query), 1, 16) as sha from (select distinct query from queries where query is not null)),
a as (select key.q_sha as sha, min({_PLAIN.format("answer")}) as a from answers where answer is not null group by 1), g as (select form, count(distinct year) as years, count(distinct a) as answers from y join a using (sha) where year <> '' group by 1 having count(distinct year) >= 2)
select case when answers / years >= 0.75 then 'FAST' when answers / years >= 0.40 then 'MEDIUM' when answers / years >= 0.10 then 'SLOW' else 'TIMELESS' end as kind, count(*) as n, sum(years)::bigint as n_years from g group by 1""",
    "st_coverage": """
with q as (select distinct query_id, coalesce(freshness_class, 'NONE') as c, substring(sha256(query), 1, 16) as sha from queries where query is not null), x as (select c, (sha in (select key.q_sha from answers where answer is not null and key.q_sha is not null))::int as ok from q)
select coalesce(c, 'ALL') as freshness_class, count(*) as n, sum(ok) as n_answered, round(avg(ok), 6) as share from x group by rollup (c)""",
}
