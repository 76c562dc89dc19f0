"""Helpers every operator shares: reading tables, cutting lineage, shared storage."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a local session without one gets its own folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = getattr(spark, "_tidewell_dir", None)
        if path is None:
            path = "file://" + tempfile.mkdtemp(prefix="tidewell-")
            spark._tidewell_dir = path
    return path.rstrip("/")


def scratch(spark: SparkSession, label: str = "cut") -> str:
    return f"{shared_dir(spark)}/tidewell/{label}-{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> None:
    """Give the executors' Python this package, once a session, through the shared folder."""
    sc = spark.sparkContext
    if getattr(sc, "_tidewell_shipped", False):
        return
    here, held = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f"{here.name}/{f.relative_to(here)}")
    path = scratch(spark, "code") + ".zip"
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(sc._jsc.hadoopConfiguration()).create(where)
    out.write(bytearray(held.getvalue()))
    out.close()
    sc.addPyFile(path)
    sc._tidewell_shipped = True


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later stages survive lost executors."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def drop(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files behind a frame made by ``cut`` once nothing reads them any more."""
    for f in df.inputFiles()[:1]:
        if "/tidewell/" in f:
            delete(spark, f.rpartition("/")[0])
