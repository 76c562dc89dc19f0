"""Problem 7: questions of the evaluation splits that also stand in the training split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.crosssplit import cross_split_pairs
from tidewell.session import table


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    splits = table(spark, sf_dir, "query_splits").groupBy("query_id").agg(F.max((F.col("split") == "train")).alias("in_train"), F.max(F.col("split").isin("validation", "heldout")).alias("in_eval"))
    records = table(spark, sf_dir, "queries").select("query_id", "query").join(splits, "query_id").select(F.col("query_id").alias("rid"), F.col("query").alias("text"), F.coalesce("in_train", F.lit(False)).alias("in_train"), F.coalesce("in_eval", F.lit(False)).alias("in_eval"))
    return cross_split_pairs(records)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select(F.least("rid_train", "rid_eval").alias("query_id_a"), F.greatest("rid_train", "rid_eval").alias("query_id_b")).distinct()


def p7_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs and evaluation questions concerned, per evaluation split and source of the evaluation question."""
    split = table(spark, sf_dir, "query_splits").where(F.col("split").isin("validation", "heldout")).select(F.col("query_id").alias("rid_eval"), "split").distinct()
    source = table(spark, sf_dir, "queries").groupBy(F.col("query_id").alias("rid_eval")).agg(F.min("source").alias("source"))
    return _pairs(spark, sf_dir).join(split, "rid_eval").join(source, "rid_eval").groupBy("split", "source").agg(F.count("*").alias("n_pairs"), F.countDistinct("rid_eval").alias("n_questions"))


QUERIES = {"p7_found": p7_found, "p7_overlap": p7_overlap}
SQL: dict[str, str] = {}
