"""Steps that several branches read, written once."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; a temporary one only where that is unset (local tests)."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="attestry-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes the rows as Parquet and reads them back; the files go when the session ends."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    passing(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def passing(spark: SparkSession, path: str) -> None:
    """What stands at the path goes when the session ends."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
