"""Problems 3 and 6: page furniture, and error or template texts, in ``l3_cache``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewell.llm.boilerplate import content_lines
from tidewell.llm.pages import DOC, distinct_texts, page_rows
from tidewell.llm.residue import residue_docs
from tidewell.session import cut, table


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = page_rows(table(spark, sf_dir, "l3_cache"))
    found = cut(residue_docs(distinct_texts(rows)), "residue")
    return rows.select("row_id", *DOC).join(found, DOC, "left_semi").select("row_id")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each delivered row that is no case of problem 6."""
    rows = page_rows(table(spark, sf_dir, "l3_cache"))
    texts = distinct_texts(rows)
    good = cut(texts.join(residue_docs(texts), DOC, "left_anti"), "articles")
    return rows.select("row_id", *DOC).join(content_lines(good), DOC)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).where("not main").select("row_id", "line_no")


QUERIES = {"p3_found": p3_found, "p6_found": p6_found}
SQL: dict[str, str] = {}
