"""Folders for tables that queries store on the way: in the folder that driver and executors
share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def folder(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir, in a folder of this application. Without that
    setting a temporary folder stands in for it in local mode; elsewhere that is an error."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="siltstone-"))
            atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
        path = "file://" + _LOCAL[0]
    return f"{path}/siltstone/{sc.applicationId}/{name}-{uuid.uuid4().hex}"


def stored(rows: DataFrame, name: str) -> DataFrame:
    """rows, written now: what reads them more than once does not work them out again."""
    spark = rows.sparkSession
    path = folder(spark, name)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
