"""Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evolvent.session import ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """``<sf_dir>/<name>.parquet``, a file or a folder of files."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
