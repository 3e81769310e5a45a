"""A bounded sample that does not depend on how rows are laid out (ST4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GROUPS = 64


def bottom_k(df: DataFrame, keys: list[str], k: int, order: list[str] | None = None) -> DataFrame:
    """``k`` rows: those with the smallest MD5 of their ``keys`` (a random
    sample, the same ones for any partitioning and on any engine), or the first
    in ``order`` (file order: a head).  Rows with equal keys follow their other
    columns.

    Mergeable: every task keeps the k first of each of ``GROUPS`` groups before
    the shuffle, each group keeps k of those, and the last step sees GROUPS * k
    rows, whatever the input.  NULL keys sort as empty text."""
    mark = F.md5(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in keys]))
    by = ([F.col(c) for c in order] if order else [F.col("_mark")]) + [F.col(c) for c in df.columns if c not in (order or [])]
    marked = df.withColumn("_mark", mark).withColumn("_group", F.pmod(F.xxhash64("_mark"), F.lit(GROUPS)))
    few = marked.withColumn("_n", F.row_number().over(Window.partitionBy("_group").orderBy(*by))).where(F.col("_n") <= k)
    return few.withColumn("_n", F.row_number().over(Window.partitionBy().orderBy(*by))).where(F.col("_n") <= k).select(*df.columns)
