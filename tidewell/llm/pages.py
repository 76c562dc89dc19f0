"""Delivered page rows and their distinct texts, shared by the operators on page text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.urls import canonical_url, domain
from tidewell.session import cut

DOC = ["doc", "size"]  # a text on a host: 64-bit hash and length


def page_rows(cache: DataFrame) -> DataFrame:
    """(row_id, doc, size, host, page, status, text) of the rows with some text. Null or blank texts are no rows here."""
    url = F.coalesce(F.col("canonical_url"), F.lit(""))
    host, text = domain(url), F.col("extracted_text")
    rows = cache.where(text.rlike(r"[^\s ​]"))
    return rows.select("row_id", F.xxhash64(host, text).alias("doc"), F.length(text).alias("size"), host.alias("host"), F.xxhash64(canonical_url(url)).alias("page"), F.coalesce("status_code", F.lit(0)).alias("status"), text.alias("text"))


def distinct_texts(rows: DataFrame) -> DataFrame:
    """One row per text and host, written once: snapshots repeat most texts, so all later work runs on these.

    ``text`` has every number as 0 and every odd white space but line feeds as a space; lines keep their places.
    """
    one = rows.groupBy(*DOC, "host").agg(F.first("text").alias("text"), F.max("status").alias("status"), F.min("page").alias("page"))
    flat = F.regexp_replace(F.translate("text", "\r\t\u00a0", "   "), r"[0-9]+(?:[.,][0-9]+)*", "0")
    return cut(one.withColumn("text", flat), "texts")
