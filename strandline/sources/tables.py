"""Reading the tables of one data folder."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """``<sf_dir>/<name>.parquet``, a file or a folder of files; column pruning and
    filters reach the scan."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def has_table(sf_dir: str, name: str) -> bool:
    return os.path.exists(f"{sf_dir.rstrip('/')}/{name}.parquet")
