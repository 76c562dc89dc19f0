"""Joins in which one key may hold a large part of the rows.

A key with more than one ``parts``-th of the rows is hot, so there are fewer than ``parts`` hot keys. Rows of a hot key
are dealt to ``copies`` salts and the other side's rows of these keys are repeated for every salt; all other rows keep
one. Results are those of the plain join.

Defined results: null keys meet nothing; without hot keys the join is a plain one; an empty side gives what a plain join gives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hot_keys(df: DataFrame, key: str, parts: int = 256) -> list:
    """The keys that hold more than one ``parts``-th of the rows (fewer than ``parts``); counts are combined before the shuffle."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    whole = counts.agg(F.sum("_n").alias("_all"))
    return [r[0] for r in counts.crossJoin(whole).where(F.col("_n") * parts > F.col("_all")).where("_n > 1").select(key).collect()]


def salted_join(big: DataFrame, small: DataFrame, key: str, hot: list, by: Column, *, how: str = "inner", copies: int = 32) -> DataFrame:
    """``big`` join ``small`` on ``key`` (inner or left); ``by`` is what deals the rows of a hot key to salts."""
    if not hot:
        return big.join(small, key, how)
    is_hot = F.col(key).isin(hot)
    left = big.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(by), F.lit(copies))).otherwise(F.lit(0)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(copies - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, [key, "_salt"], how).drop("_salt")
