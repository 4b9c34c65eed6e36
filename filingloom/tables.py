"""Loaders for the engine's input tables (one Parquet file or folder per table)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read table ``name`` below ``sf_dir``; projection and filters are pushed by Catalyst."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
