"""Parquet tables by name: ``{sf_dir}/{name}.parquet``, a file or a directory of part files."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept(rows: DataFrame) -> DataFrame:
    """rows in the folder that executors share, for a plan that reads them twice; as they are where there is none."""
    return rows.checkpoint() if rows.sparkSession.conf.get("spark.checkpoint.dir", None) else rows
