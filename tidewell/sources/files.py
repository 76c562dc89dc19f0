"""Tolerant readers and a write-once sink.

Defined results: a path that does not exist is an empty table; blank and malformed lines are left out; a folder of
rounds (``run_id=...``) gives the round as a column; a sink that exists already is never written again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def read_json_lines(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Rows of a file or folder of JSON lines; partition folders become columns."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    marked = StructType([*schema.fields]).add("_bad", "string")
    # A malformed line is one whose text Spark keeps; blank lines give nothing at all.
    rows = spark.read.schema(marked).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.where(F.col("_bad").isNull()).drop("_bad")


def write_once(df: DataFrame, path: str) -> bool:
    """Writes parquet unless the path is there; whether it was written."""
    if exists(df.sparkSession, path):
        return False
    df.write.mode("errorifexists").parquet(path)
    return True
