"""Problem 5: splits of the questions that keep questions on one entity together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.groups import assign_splits, record_groups
from tidewell.operators.skew import hot_keys, salted_join
from tidewell.session import cut, table


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "queries").select(F.col("query_id").alias("rid"), F.col("query").alias("text")).distinct()
    return cut(record_groups(records, table(spark, sf_dir, "entity_aliases")), "groups")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = _groups(spark, sf_dir).where("root is not null")
    first = groups.groupBy("root").agg(F.min("rid").alias("query_id_a"))
    return salted_join(groups, first, "root", hot_keys(groups, "root"), F.col("rid")).where("rid <> query_id_a").select("query_id_a", F.col("rid").alias("query_id_b"))


def p5_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = [(r["split"], r["target_share"]) for r in table(spark, sf_dir, "split_targets").orderBy("split").collect()]  # a fixed small table
    return assign_splits(_groups(spark, sf_dir), targets).withColumnRenamed("rid", "query_id")


def p5_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions per split and share beside the target."""
    counts = p5_splits(spark, sf_dir).groupBy("split").agg(F.count("*").alias("n_questions"))
    whole = counts.agg(F.sum("n_questions").alias("n_all"))
    return counts.crossJoin(whole).join(table(spark, sf_dir, "split_targets"), "split", "right").select("split", F.coalesce("n_questions", F.lit(0)).alias("n_questions"), (F.coalesce("n_questions", F.lit(0)) / F.col("n_all")).alias("share"), "target_share")


QUERIES = {"p5_found": p5_found, "p5_splits": p5_splits, "p5_shares": p5_shares}
SQL: dict[str, str] = {}
