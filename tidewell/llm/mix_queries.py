"""Problems 8 and 9: containers filled with documents, and a training mix of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.mixing import mix
from tidewell.llm.packing import pack
from tidewell.llm.tokens import with_tokens
from tidewell.session import table


def sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_tokens(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("text")


def p8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of each document or piece, for every container size."""
    limits = table(spark, sf_dir, "pack_limits").select("packing", F.col("capacity_tokens").alias("capacity"))
    items = sized(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("tokens").alias("size"))
    return pack(items, limits).withColumnsRenamed({"id": "doc_id", "size": "tokens"})


def p8_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers used and the least number that the tokens need."""
    limits = table(spark, sf_dir, "pack_limits")
    packed = p8_packing(spark, sf_dir).where("container is not null").groupBy("packing", "container").agg(F.sum("tokens").alias("fill"), F.count("*").alias("n"))
    sums = packed.groupBy("packing").agg(F.count("*").alias("n_containers"), F.sum("fill").alias("tokens"), F.sum("n").alias("n_pieces"))
    return sums.join(limits, "packing").select("packing", "n_containers", "n_pieces", "tokens", F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least_containers"), (F.col("tokens") / (F.col("n_containers") * F.col("capacity_tokens"))).alias("filled"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is used."""
    items = sized(spark, sf_dir).select(F.col("doc_id").alias("id"), "source", "tokens")
    return mix(items, table(spark, sf_dir, "mix_targets")).withColumnRenamed("id", "doc_id")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actual share of each target source beside its target."""
    used = p9_mix(spark, sf_dir).groupBy("source").agg(F.sum(F.col("tokens").cast("long") * F.col("uses")).alias("tokens_used"), F.max("uses").alias("most_uses"))
    whole = used.agg(F.sum("tokens_used").alias("all_used"))
    joined = table(spark, sf_dir, "mix_targets").join(used, "source", "left").crossJoin(whole)
    return joined.select("source", "target_share", "max_repeats", F.coalesce("tokens_used", F.lit(0)).alias("tokens_used"), (F.coalesce("tokens_used", F.lit(0)) / F.col("all_used")).alias("actual_share"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"))


QUERIES = {"p8_packing": p8_packing, "p8_summary": p8_summary, "p9_mix": p9_mix, "p9_shares": p9_shares}
SQL: dict[str, str] = {}
