"""The tables of a data folder, one Parquet file or folder each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glyphmill.session import ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """``name`` of the folder; the schema is the file's own."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
