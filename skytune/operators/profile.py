"""Profiles and data-quality tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import quantiles as Q


def key_values(row: DataFrame, entries: list[tuple[str, Column | None, Column | None]]) -> DataFrame:
    """One aggregate row -> (metric, value, label) rows; numbers in
    ``value`` (DOUBLE), text in ``label``."""
    structs = [F.struct(F.lit(k).alias("metric"),
                        (v if v is not None else F.lit(None)).cast("double").alias("value"),
                        (t if t is not None else F.lit(None)).cast("string").alias("label"))
               for k, v, t in entries]
    return row.select(F.inline(F.array(*structs)))


def null_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, null_count, non_null_count) for every column."""
    cols = columns or df.columns
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"n_{i}") for i, c in enumerate(cols)],
                 F.count(F.lit(1)).alias("_rows"))
    structs = [F.struct(F.lit(c).alias("column"), F.col(f"n_{i}").alias("null_count"),
                        (F.col("_rows") - F.col(f"n_{i}")).alias("non_null_count")) for i, c in enumerate(cols)]
    return row.select(F.inline(F.array(*structs)))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, NULL included."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


QUARTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, sample sd, min, quartiles (linear), max per column.

    One aggregate over all columns side by side (moments and quantile
    sketches), then one pass for the quartiles that the sketches leave open."""
    values = [F.col(c).cast("double") for c in columns]
    parts = [F.struct(F.lit(c).alias("column"), F.count(v).alias("n_values"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
                      F.min(v).alias("min"), F.max(v).alias("max"), *Q.sketch(v, QUARTILES)) for c, v in zip(columns, values)]
    wide = df.agg(*[p.alias(f"_c{i}") for i, p in enumerate(parts)])
    first = cut_lineage(wide.select(F.inline(F.array(*[f"_c{i}" for i in range(len(columns))]))))
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), v.alias("v")) for c, v in zip(columns, values)])))
    return Q.with_quantiles(first, long, ["column"], "v", QUARTILES)


def off_size_days(df: DataFrame, expected: int = 200) -> DataFrame:
    """Days whose row count differs from ``expected``."""
    return df.groupBy("date").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") != expected)
