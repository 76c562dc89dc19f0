"""Text functions on questions, pages and answers: normal forms, similarity, guards, contexts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.functions import stats as S
from tidewell.functions import text as T
from tidewell.functions.stats import normal_quantile
from tidewell.functions.urls import canonical_url
from tidewell.plans.etl import _CONTENT, _PAGE, _TOK
from tidewell.plans.more import KINDS, _NEG
from tidewell.plans.stats import _int
from tidewell.session import table

# Words of time, families of comparing words, endings of Korean questions.
NOW, SOON = r"\b(now|live|currently)\b|right now|지금|현재", r"\b(today|this week|latest|season|month)\b|오늘|이번 주"
FAMILIES = {"more": r"\b(more|greater|higher|larger)\b", "less": r"\b(less|fewer|lower|smaller)\b", "first": r"\b(first|earliest|opening)\b", "last": r"\b(last|latest|closing|final)\b", "most": r"\b(most|largest|highest|biggest)\b", "least": r"\b(least|smallest|lowest)\b", "before": r"\bbefore\b", "after": r"\bafter\b"}
YEAR = "(^|[^0-9])(19|20)[0-9][0-9]([^0-9]|$)"
KO_FORMS = (("인가요\\?$", "입니까?"), ("였나요\\?$", "였습니까?"), ("나요\\?$", "습니까?"))
MONEY, DATE, PERCENT = r"[$€₩] ?[0-9][0-9,.]*|[0-9][0-9,.]*(?= ?(?:thousand )?(?:crowns|크라운|dollars|won\b))", r"\b(?:19|20)[0-9]{2}\b", r"[0-9][0-9,.]*(?= ?(?:%|percent|퍼센트))"
BUDGET, LEAST = 2800, 200  # characters of a context; shorter parts are left out


def normal_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Distinct page texts per round, as they are and without their volatile parts."""
    t = table(spark, d, "l3_cache").where("extracted_text <> ''").select("run_id", "extracted_text")
    return t.groupBy("run_id").agg(F.countDistinct(F.md5("extracted_text")).alias("n_texts"), F.countDistinct(F.md5(T.normal_text(F.col("extracted_text")))).alias("n_normal"))


def page_texts(spark: SparkSession, d: str) -> DataFrame:
    """Answers and documents freed from markup: how many change and the characters left."""
    x = table(spark, d, "documents").select(F.lit("documents").alias("kind"), "text").unionByName(table(spark, d, "answers").select(F.lit("answers").alias("kind"), F.col("answer").alias("text")))
    x = x.where("text is not null").withColumn("plain", T.page_text(F.col("text")))
    return x.groupBy("kind").agg(F.count("*").alias("n"), F.sum(_int(F.col("text").rlike("</?[a-zA-Z][^<>]*>"))).alias("n_tags"), F.sum(F.length("plain")).alias("n_chars"), F.countDistinct(F.md5("plain")).alias("n_distinct"))


def _rewordings(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "paraphrase_clusters").where("query is not null").select("query_id", "base_query_id", "query", "is_paraphrase", "freshness_class").distinct()
    b = p.where("not is_paraphrase").select("base_query_id", F.col("query").alias("base")).distinct()
    return p.where("is_paraphrase").join(b, "base_query_id")


_REWORDINGS = """p as (select distinct query_id, base_query_id, query, is_paraphrase, freshness_class from paraphrase_clusters where query is not null),
j as (select p.query_id, p.freshness_class, p.query, b.base from p join (select distinct base_query_id, query as base from p where not is_paraphrase) b on b.base_query_id = p.base_query_id where p.is_paraphrase)"""


def term_cosine(spark: SparkSession, d: str) -> DataFrame:
    """Cosine of term frequencies between a rewording and its base question."""
    j = _rewordings(spark, d).select("query_id", "query", "base").distinct()
    sides = j.select("query_id", "base", "query", F.explode(F.array(F.struct(F.lit(0).alias("side"), T.tokens(F.col("query")).alias("t")), F.struct(F.lit(1).alias("side"), T.tokens(F.col("base")).alias("t")))).alias("s"))
    tf = sides.select("query_id", "query", "base", "s.side", F.explode("s.t").alias("w")).groupBy("query_id", "query", "base", "w").agg(F.sum(1 - F.col("side")).alias("a"), F.sum("side").alias("b"))
    g = tf.groupBy("query_id", "query", "base").agg(F.sum(F.col("a") * F.col("b")).alias("dot"), F.sum(F.col("a") * F.col("a")).alias("aa"), F.sum(F.col("b") * F.col("b")).alias("bb"))
    return g.select("query_id", "base", F.round(F.when(F.col("aa") * F.col("bb") > 0, F.col("dot") / F.sqrt(F.col("aa") * F.col("bb"))).otherwise(0.0), 6).alias("cosine"))


def _kind(c: Column) -> Column:
    return F.coalesce(*[F.when(F.lower(c).rlike(k), n) for n, k in KINDS], F.lit("other"))


def equivalence(spark: SparkSession, d: str) -> DataFrame:
    """Rewordings that count as the same question: enough common words, the same kind of answer, and neither asks for strictly more; the first test that fails is the reason."""
    j = _rewordings(spark, d)
    a, b = T.content_tokens(F.col("query")), T.content_tokens(F.col("base"))
    subset = (F.size(F.array_except(a, b)) == 0) != (F.size(F.array_except(b, a)) == 0)
    reason = F.when(T.jaccard(a, b) < 0.5, "words").when(_kind(F.col("query")) != _kind(F.col("base")), "kind").when(subset, "subset").otherwise("same")
    return j.groupBy("freshness_class", reason.alias("reason")).agg(F.count("*").alias("n"))


def number_guards(spark: SparkSession, d: str) -> DataFrame:
    """Rewordings whose dates, sums of money or percentages are not those of the base question."""
    sets = lambda c, p: F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(p), 0)))
    j = _rewordings(spark, d)
    differ = lambda p: F.sum(_int(sets(F.col("query"), p) != sets(F.col("base"), p)))
    return j.groupBy("freshness_class").agg(F.count("*").alias("n"), differ(DATE).alias("dates"), differ(MONEY).alias("money"), differ(PERCENT).alias("percent"))


def comparing_guards(spark: SparkSession, d: str) -> DataFrame:
    """Rewordings that compare another way than the base question or turn its negation."""
    families = lambda c: F.array_compact(F.array(*[F.when(F.lower(c).rlike(p), name) for name, p in FAMILIES.items()]))
    neg = lambda c: F.lower(c).rlike(r"\b(not|no|never|without|except)\b|n't\b")
    j = _rewordings(spark, d)
    return j.groupBy("freshness_class").agg(F.count("*").alias("n"), F.sum(_int(families(F.col("query")) != families(F.col("base")))).alias("n_comparing"), F.sum(_int(neg(F.col("query")) != neg(F.col("base")))).alias("n_negation"))


def time_words(spark: SparkSession, d: str) -> DataFrame:
    """Class that words of time give against the class that is stored."""
    q = table(spark, d, "queries").where("query is not null").select("query_id", "query", "freshness_class").distinct()
    rule = F.when(F.lower("query").rlike(NOW), "REAL_TIME").when(F.lower("query").rlike(SOON), "FAST").when(F.col("query").rlike(YEAR), "SLOW").otherwise("UNKNOWN")
    return q.groupBy(rule.alias("rule"), "freshness_class").agg(F.count("*").alias("n"))


def korean_forms(spark: SparkSession, d: str) -> DataFrame:
    """Korean questions put into their formal ending."""
    s, q = F.col("query"), table(spark, d, "queries").where("query rlike '[가-힣]'").select("query").distinct()
    for pattern, formal in KO_FORMS:
        s = F.regexp_replace(s, pattern, formal)
    return q.select("query", s.alias("formal")).where("query <> formal")


def contexts(spark: SparkSession, d: str) -> DataFrame:
    """Context of each question: texts of its first results in rank order, long enough ones, up to a budget; the last is cut to what is left."""
    pages = table(spark, d, "l3_cache").where("run_id = 'run_00' and extracted_text is not null").select(canonical_url("canonical_url").alias("page"), F.struct(F.coalesce("fetched_at", F.lit(float("-inf"))).alias("t"), "row_id", "extracted_text").alias("x")).groupBy("page").agg(F.max("x").alias("x")).select("page", F.col("x.extracted_text").alias("body")).where(F.length("body") >= LEAST)
    m = table(spark, d, "url_manifest").where("run_id = 'run_00'").groupBy("query_id", canonical_url("canonical_url").alias("page")).agg(F.min("rank").alias("rank"))
    up = Window.partitionBy("query_id").orderBy("rank", "page")  # a question has a list of bounded length
    j = m.join(pages, "page").withColumn("before", F.coalesce(F.sum(F.length("body")).over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where(F.col("before") < BUDGET)
    part = F.expr(f"substring(body, 1, cast({BUDGET} - before as int))")
    g = j.select("query_id", "rank", "page", part.alias("part")).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "page", "part"))).alias("p"))
    text = F.array_join(F.transform("p", lambda x: x["part"]), "\n\n")
    return g.select("query_id", F.size("p").alias("n_parts"), F.length(text).alias("n_chars"), F.md5(text).alias("md5"))


def evidence(spark: SparkSession, d: str) -> DataFrame:
    """Evidence block of each question of the first round: one line per result, in rank order."""
    m = table(spark, d, "url_manifest").where("run_id = 'run_00'").select("query_id", "rank", "url_hash", "title", "snippet").distinct()
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.coalesce("title", F.lit("")), F.lit(" | "), F.coalesce("snippet", F.lit("")))
    g = m.select("query_id", "rank", "url_hash", line.alias("line")).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "url_hash", "line"))).alias("l"))
    return g.select("query_id", F.size("l").alias("n"), F.md5(F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("md5"))


def headers(spark: SparkSession, d: str) -> DataFrame:
    """Header names of fetched pages, read from JSON; what is no JSON object counts as having none."""
    t = table(spark, d, "l3_cache").select("run_id", F.coalesce(F.from_json("raw_headers", "map<string,string>"), F.expr("cast(map() as map<string,string>)")).alias("h"))
    x = t.select("run_id", F.explode_outer(F.map_keys("h")).alias("name"))
    return x.groupBy("run_id", F.coalesce(F.lower("name"), F.lit("(none)")).alias("name")).agg(F.count("*").alias("n"))


def token_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Features of a question and its first result: shares of the question's content words and numbers that title and snippet hold."""
    m = table(spark, d, "url_manifest").where("run_id = 'run_00' and rank = 1 and query is not null").select("query_id", "freshness_class", "query", F.concat_ws(" ", "title", "snippet").alias("text")).distinct()
    q, t = T.content_tokens(F.col("query")), F.array_distinct(T.tokens(F.col("text")))
    n = F.filter(q, lambda w: w.rlike("^[0-9]+$"))
    share = lambda a: F.when(F.size(a) > 0, F.size(F.array_intersect(a, t)) / F.size(a)).otherwise(0.0)
    return m.groupBy("freshness_class").agg(F.count("*").alias("n"), F.round(F.avg(share(q)), 6).alias("words"), F.round(F.avg(share(n)), 6).alias("numbers"))


def quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Normal quantile of each domain's change rate."""
    m = table(spark, d, "url_manifest").where("changed is not null").groupBy("domain").agg(F.count("*").alias("n"), F.avg(F.col("changed").cast("double")).alias("p"))
    return m.select("domain", "n", F.round("p", 9).alias("p"), F.round(normal_quantile(F.col("p")), 6).alias("z"))


def logistic(spark: SparkSession, d: str) -> DataFrame:
    """Logistic regression of a change on rank and age by Newton's steps: every step sums a 3 x 3 system over all rows; distinct values are counted first."""
    age = F.create_map(*[x for k, v in {"run_01": 1.0, "run_02": 12.0, "run_03": 24.0, "run_04": 168.0}.items() for x in (F.lit(k), F.lit(v))])[F.col("run_id")]
    m = table(spark, d, "url_manifest").where("changed is not null and rank is not null").select(_int(F.col("changed")).alias("y"), (F.col("rank") / 10.0).alias("x1"), F.log(1 + age).alias("x2")).where("x2 is not null").groupBy("y", "x1", "x2").agg(F.count("*").alias("n"))
    w, x = np.zeros(3), [F.lit(1.0), F.col("x1"), F.col("x2")]
    for _ in range(8):
        p = 1 / (1 + F.exp(-sum((float(v) * c for v, c in zip(w, x)), F.lit(0.0))))
        sums = m.agg(*[F.sum(F.col("n") * (F.col("y") - p) * c) for c in x], *[F.sum(F.col("n") * p * (1 - p) * a * b) for a in x for b in x]).first()
        if sums[0] is None:
            break
        w = w + np.linalg.lstsq(np.array(sums[3:]).reshape(3, 3) + 1e-9 * np.eye(3), np.array(sums[:3]), rcond=None)[0]
    return m.agg(F.sum("n").alias("n"), *[F.lit(round(float(v), 6)).alias(k) for k, v in zip(("intercept", "rank", "age"), w)])


_MONTH_RULE = "case when regexp_matches(lower(query), '{0}') then 'REAL_TIME' when regexp_matches(lower(query), '{1}') then 'FAST' when regexp_matches(lower(query), '{2}') then 'SLOW' else 'UNKNOWN' end"
_KIND = "case " + " ".join(f"when regexp_matches(lower({{0}}), '{k}') then '{n}'" for n, k in KINDS) + " else 'other' end"
_SETS = "list_sort(list_distinct(regexp_extract_all(lower({0}), '{1}')))"


def _sql_sets(pattern: str) -> str:
    """The patterns with what follows a number taken into the match: both sides lose or keep it alike."""
    return f"{_SETS.format('query', pattern)} <> {_SETS.format('base', pattern)}"


def _normal_sql(c: str) -> str:
    s = f"lower({c})"
    for p in T.VOLATILE:
        s = f"regexp_replace({s}, '{p}', ' ', 'g')"
    return rf"trim(regexp_replace({s}, '\s+', ' ', 'g'))"


def _page_sql(c: str) -> str:
    s = c
    for p in ("(?s)<!--.*?-->", *(rf"(?is)<{tag}(\s[^<>]*)?>.*?</{tag}\s*>" for tag in T.DROPPED), "(?s)</?[a-zA-Z][^<>]*>"):
        s = f"regexp_replace({s}, '{p}', ' ', 'g')"
    for name, sign in T.ENTITIES:
        s = f"replace({s}, '{name}', '{sign.replace(chr(39), chr(39) * 2)}')"
    return rf"trim(regexp_replace({s}, '\s+', ' ', 'g'), ' ')"


def _quantile_sql(p: str) -> str:
    poly = lambda cs, x: "(" * (len(cs) - 1) + repr(cs[0]) + "".join(f" * {x} + {c!r})" for c in cs[1:])
    tail = lambda x: f"({poly(S._C, x)} / ({poly(S._D, x)} * {x} + 1))"
    r = f"(({p} - 0.5) * ({p} - 0.5))"
    return f"case when {p} > 0 and {p} < 0.02425 then {tail(f'sqrt(-2 * ln({p}))')} when {p} > 0.97575 and {p} < 1 then -{tail(f'sqrt(-2 * ln(1 - {p}))')} when {p} > 0 and {p} < 1 then {poly(S._A, r)} * ({p} - 0.5) / ({poly(S._B, r)} * {r} + 1) end"


QUERIES = {
    "fn_normal_hashes": normal_hashes, "fn_page_texts": page_texts, "fn_term_cosine": term_cosine, "fn_equivalence": equivalence, "fn_number_guards": number_guards, "fn_comparing_guards": comparing_guards,
    "fn_time_words": time_words, "fn_korean_forms": korean_forms, "etl_contexts": contexts, "etl_evidence": evidence, "etl_headers": headers, "fn_token_coverage": token_coverage, "fn_quantiles": quantiles, "st_logistic": logistic,
}
_FAM = "list_filter([" + ", ".join(f"case when regexp_matches(lower({{0}}), '{p}') then '{n}' end" for n, p in FAMILIES.items()) + "], lambda x: x is not null)"
SQL = {
    "fn_quantiles": f"with m as (select domain, count(*) as n, avg(changed::int)::double as p from url_manifest where changed is not null group by 1) select domain, n, round(p, 9) as p, round({_quantile_sql('p')}, 6) as z from m",
    "fn_page_texts": f"""
with x as (select 'documents' as kind, text from documents where text is not null union all select 'answers', answer from answers where answer is not null), y as (select kind, text, {_page_sql("text")} as plain from x)
select kind, count(*) as n, sum(regexp_matches(text, '</?[a-zA-Z][^<>]*>')::int) as n_tags, sum(length(plain))::bigint as n_chars, count(distinct md5(plain)) as n_distinct from y group by 1""",
    "fn_normal_hashes": f"select run_id, count(distinct md5(extracted_text)) as n_texts, count(distinct md5({_normal_sql('extracted_text')})) as n_normal from l3_cache where extracted_text <> '' group by 1",
    "fn_term_cosine": f"""
with {_REWORDINGS}, k as (select distinct query_id, query, base from j), t as (select query_id, query, base, unnest({_TOK.format("query")}) as w, 1 as a, 0 as b from k union all select query_id, query, base, unnest({_TOK.format("base")}), 0, 1 from k),
f as (select query_id, query, base, w, sum(a) as a, sum(b) as b from t group by 1, 2, 3, 4), g as (select query_id, query, base, sum(a * b) as dot, sum(a * a) as aa, sum(b * b) as bb from f group by 1, 2, 3)
select query_id, base, round(case when aa * bb > 0 then dot / sqrt(aa * bb) else 0.0 end, 6) as cosine from g""",
    "fn_equivalence": f"""
with {_REWORDINGS}, s as (select *, {_CONTENT.format("query")} as a, {_CONTENT.format("base")} as b from j),
x as (select *, len(list_filter(a, lambda w: not list_contains(b, w))) as ab, len(list_filter(b, lambda w: not list_contains(a, w))) as ba, len(list_distinct(list_concat(a, b))) as u from s)
select freshness_class, case when (case when u = 0 then 0.0 else (len(a) - ab) / u end) < 0.5 then 'words' when {_KIND.format("query")} <> {_KIND.format("base")} then 'kind' when (ab = 0) <> (ba = 0) then 'subset' else 'same' end as reason, count(*) as n from x group by 1, 2""",
    "fn_number_guards": rf"""
with {_REWORDINGS} select freshness_class, count(*) as n, sum(({_sql_sets(r'\b(?:19|20)[0-9]{2}\b')})::int) as dates,
  sum(({_sql_sets(r'[$€₩] ?[0-9][0-9,.]*|[0-9][0-9,.]* ?(?:thousand )?(?:crowns|크라운|dollars|won\b)')})::int) as money, sum(({_sql_sets(r'[0-9][0-9,.]* ?(?:%|percent|퍼센트)')})::int) as percent from j group by 1""",
    "fn_comparing_guards": f"""
with {_REWORDINGS} select freshness_class, count(*) as n, sum(({_FAM.format("query")} <> {_FAM.format("base")})::int) as n_comparing, sum(({_NEG.format("query")} <> {_NEG.format("base")})::int) as n_negation from j group by 1""",
    "fn_time_words": f"select {_MONTH_RULE.format(NOW, SOON, YEAR)} as rule, freshness_class, count(*) as n from (select distinct query_id, query, freshness_class from queries where query is not null) group by 1, 2",
    "fn_korean_forms": r"with f as (select distinct query, regexp_replace(regexp_replace(regexp_replace(query, '인가요\?$', '입니까?'), '였나요\?$', '였습니까?'), '나요\?$', '습니까?') as formal from queries where regexp_matches(query, '[가-힣]')) select * from f where query <> formal",
    "etl_contexts": f"""
with p as (select page, body from (select {_PAGE} as page, extracted_text as body, row_number() over (partition by {_PAGE} order by fetched_at desc nulls last, row_id desc) as n from l3_cache where run_id = 'run_00' and extracted_text is not null) where n = 1 and length(body) >= {LEAST}),
m as (select query_id, {_PAGE} as page, min(rank) as rank from url_manifest where run_id = 'run_00' group by 1, 2),
j as (select query_id, rank, page, body, coalesce(sum(length(body)) over (partition by query_id order by rank, page rows between unbounded preceding and 1 preceding), 0)::bigint as before from m join p using (page)),
g as (select query_id, count(*) as n_parts, string_agg(substring(body, 1, {BUDGET} - before), e'\\n\\n' order by rank, page) as text from j where before < {BUDGET} group by 1)
select query_id, n_parts, length(text) as n_chars, md5(text) as md5 from g""",
    "etl_evidence": r"""
with m as (select distinct query_id, rank, url_hash, '[' || rank || '] ' || coalesce(title, '') || ' | ' || coalesce(snippet, '') as line from url_manifest where run_id = 'run_00')
select query_id, count(*) as n, md5(string_agg(line, e'\n' order by rank, url_hash, line)) as md5 from m group by 1""",
    "etl_headers": """
with t as (select run_id, case when json_valid(raw_headers) and json_type(raw_headers) = 'OBJECT' and len(json_keys(raw_headers)) > 0 then json_keys(raw_headers) else ['(none)'] end as k from l3_cache)
select run_id, lower(name) as name, count(*) as n from (select run_id, unnest(k) as name from t) group by 1, 2""",
    "fn_token_coverage": f"""
with m as (select distinct query_id, freshness_class, query, concat_ws(' ', title, snippet) as text from url_manifest where run_id = 'run_00' and rank = 1 and query is not null),
s as (select freshness_class, {_CONTENT.format("query")} as q, list_distinct({_TOK.format("text")}) as t from m), x as (select *, list_filter(q, lambda w: regexp_matches(w, '^[0-9]+$')) as k from s)
select freshness_class, count(*) as n, round(avg(case when len(q) > 0 then len(list_filter(q, lambda w: list_contains(t, w))) / len(q) else 0 end), 6) as words,
  round(avg(case when len(k) > 0 then len(list_filter(k, lambda w: list_contains(t, w))) / len(k) else 0 end), 6) as numbers from x group by 1""",
}
