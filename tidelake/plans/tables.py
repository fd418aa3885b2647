"""Reading the driver's tables, and a folder for what queries write."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder; the path may be of any file system that Spark reads."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder in spark.checkpoint.dir, which driver and executors share; on one machine that setting may be missing."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tidelake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/engine/{uuid4().hex}"


def kept(rows: DataFrame) -> DataFrame:
    """Rows written once to a folder of ``scratch`` and read from there, for what would else be made anew by each of its readers."""
    path = scratch(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
