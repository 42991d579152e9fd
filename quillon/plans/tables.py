"""Reading the Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.plans.shipping import ensure_importable


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ensure_importable(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")
