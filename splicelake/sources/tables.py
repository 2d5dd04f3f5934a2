"""Parquet table directories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table ``name`` of the directory ``root`` (a file or a folder)."""
    return spark.read.parquet(f"{root}/{name}.parquet")
