"""Parquet table access for the driver's star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import SPREAD


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table; Catalyst prunes columns and pushes filters."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows hash-partitioned on ``keys`` if the session asks for it
    (``session.SPREAD``, an explicit choice of tests and benches whose files
    cannot be split); otherwise the scan as it is, at every size."""
    parts = df.sparkSession.conf.get(SPREAD, None)
    return df.repartition(int(parts), *keys) if parts else df
