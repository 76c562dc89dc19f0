"""Problem 10: documents cut off before their end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.truncation import truncated
from tidewell.session import table


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncated(table(spark, sf_dir, "documents")).where("cut").select("doc_id")


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = truncated(table(spark, sf_dir, "documents"))
    return found.groupBy("source").agg(F.count("*").alias("n_texts"), F.sum(F.col("cut").cast("long")).alias("n_truncated"), F.avg(F.col("cut").cast("double")).alias("rate"), *[F.sum((F.coalesce("stage", F.lit("")) == x).cast("long")).alias(f"n_{x}") for x in ("field_limit", "mid_transfer")])


QUERIES = {"p10_found": p10_found, "p10_rates": p10_rates}
SQL: dict[str, str] = {}
