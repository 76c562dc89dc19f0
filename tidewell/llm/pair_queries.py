"""Problem 4: answers that do not serve their question."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.pairs import defects
from tidewell.operators.skew import hot_keys, salted_join
from tidewell.session import cut, table


def _language(lang):
    return F.when(F.lower(F.trim(lang)).rlike("^(en|eng|english)"), "en").when(F.lower(F.trim(lang)).rlike("^(ko|kor|korean)"), "ko")


def answer_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = table(spark, sf_dir, "queries")
    asked = queries.where(F.col("query").isNotNull()).groupBy(F.substring(F.sha2("query", 256), 1, 16).alias("sha")).agg(F.min("query").alias("prompt"))
    answers = table(spark, sf_dir, "answers").select("key.role", "key.ctx_sha", "key.q_sha", F.col("answer").alias("response"))
    docs = table(spark, sf_dir, "documents").select(_language(F.col("lang")).alias("lang"), "text")
    labelled = docs.unionByName(queries.select(_language(F.col("language")).alias("lang"), F.col("query").alias("text"))).where("lang is not null and text is not null")
    asked = asked.withColumnRenamed("sha", "q_sha")
    return defects(cut(salted_join(answers, asked, "q_sha", hot_keys(answers, "q_sha"), F.col("ctx_sha"), how="left"), "asked"), labelled)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer_defects(spark, sf_dir).where("defect is not null").select("role", "ctx_sha", "q_sha", "defect").distinct()


QUERIES = {"p4_found": p4_found}
SQL: dict[str, str] = {}
