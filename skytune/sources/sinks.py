"""Sinks (S8-S10): results are written by executors, never via the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType

from ..session import cut_lineage


def iso_dates(df: DataFrame) -> DataFrame:
    """DATE columns as 'yyyy-MM-dd' text for CSV consumers."""
    return df.select([F.date_format(F.col(f.name), "yyyy-MM-dd").alias(f.name) if isinstance(f.dataType, DateType)
                      else F.col(f.name) for f in df.schema.fields])


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    """One result to Parquet (default) or CSV with header."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        # text as it is: the writer would strip blanks, and escape quotes by a backslash
        iso_dates(df).write.mode(mode).options(header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
                                               escape='"').csv(path)
    else:
        w.format(fmt).save(path)


def write_many(df: DataFrame, targets: list[tuple[str, str]], mode: str = "overwrite") -> None:
    """One result to several destinations; computed once (one table in the
    shared folder), then written per target."""
    done = cut_lineage(df)
    for fmt, path in targets:
        write_table(done, path, fmt, mode)


def write_result_set(results: dict[str, DataFrame], root: str, fmt: str = "parquet") -> list[str]:
    """A named result set (name -> DataFrame) under one folder."""
    paths = []
    for name, df in results.items():
        p = f"{root.rstrip('/')}/{name}"
        write_table(df, p, fmt)
        paths.append(p)
    return paths
