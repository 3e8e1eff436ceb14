"""Cutting the lineage of iterative queries in the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder only where that is unset, as in local tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = f"file://{tempfile.mkdtemp(prefix='graphloom-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder, so that plans of loops stay short and survive lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def is_empty(df: DataFrame) -> bool:
    return not df.limit(1).count()


def digest(df: DataFrame) -> tuple:
    """Number of rows and sum of their hashes: equal for equal tables, in one pass and without a shuffle of rows."""
    row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("h")).first()
    return row.n, row.h
