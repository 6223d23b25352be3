"""Reading tables and cutting lineage, the same way on a laptop and on a cluster."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``base``."""
    return spark.read.parquet(f"{base}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` once to the shared checkpoint folder and reads it from there.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Only a
    session in local mode that names none (tests) gets a temporary folder.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            shared = os.path.join(tempfile.gettempdir(), f"massloom-checkpoint-{os.getpid()}")
        sc.setCheckpointDir(shared)
    return df.checkpoint(eager=True)


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df``, which has been cut, to be broadcast if its count is at most ``rows``; else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
