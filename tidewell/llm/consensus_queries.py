"""Problem 2: consensus of the judges' verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.consensus import Consensus, usable_labels
from tidewell.session import table

CLASSES = ["CORRECT", "INCORRECT"]
CHECK = "=answer-holds-reference"


def _tokens(text: Column) -> Column:
    """Lower-cased numbers (without separators), words and runs of Hangul, each between spaces."""
    even = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?<=\d),(?=\d)", ""), r"(\d+|[가-힣]+|[\p{L}&&[^가-힣]]+)", " $1 ")
    return F.trim(F.regexp_replace(even, r"[^\p{L}\p{M}\d]+", " "))


def holds_reference(gold: Column, answer: Column) -> Column:
    """Whether the answer holds the reference as whole words; in Korean an ending may follow the last word."""
    g, a = _tokens(gold), F.concat(F.lit(" "), _tokens(answer), F.lit(" "))
    ending = F.when(g.rlike("[가-힣]$"), F.lit("")).otherwise(F.lit(" "))
    return (g != "") & a.contains(F.concat(F.lit(" "), g, ending))


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judges' labels and, as one more annotator whose reliability is learned like a judge's, a check of the item's own fields."""
    both = table(spark, sf_dir, "judge_llama8b").unionByName(table(spark, sf_dir, "judge_qwen7b"))
    flat = both.select("sig.q", "sig.gold", "sig.ans", "judge", "label", "utc")
    judged = usable_labels(flat, ["q", "gold", "ans"], "judge", F.col("label"), F.col("utc"), CLASSES)
    wrong = (~holds_reference(F.col("item.gold"), F.col("item.ans"))).cast("int")
    return judged.unionByName(judged.where("item.gold is not null").select("item").distinct().select("item", F.lit(CHECK).alias("annotator"), wrong.alias("label")))


def fit(spark: SparkSession, sf_dir: str) -> Consensus:
    return Consensus(verdicts(spark, sf_dir), CLASSES, checks=(CHECK,))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit(spark, sf_dir).items.where("consensus = 'INCORRECT'").select("q", "gold", "ans")


def p2_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit(spark, sf_dir).items


def p2_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit(spark, sf_dir).annotators.where(F.col("annotator") != CHECK).withColumnRenamed("annotator", "judge")


QUERIES = {"p2_found": p2_found, "p2_consensus": p2_consensus, "p2_reliability": p2_reliability}
SQL: dict[str, str] = {}
