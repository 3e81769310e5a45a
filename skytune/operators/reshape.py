"""Reshaping and report helpers (P10, P11, WN1, ST3, G26)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def long_of(df: DataFrame, ids: list[str], items: list[dict]) -> DataFrame:
    """P10: wide -> long.  Each item maps output column -> literal or Column;
    one output row per input row and item (``inline`` of an array of structs)."""
    structs = []
    for item in items:
        fields = [(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in item.items()]
        structs.append(F.struct(*fields))
    return df.select(*ids, F.inline(F.array(*structs)))


def trailing_mean(df: DataFrame, keys: list[str], order: str, value: str, rows: int = 14,
                  min_periods: int = 4, out: str = "rolling_14") -> DataFrame:
    """WN1: mean of the last ``rows`` non-null values, NULL below ``min_periods``.

    Partitioned by ``keys`` (a metric's day series: calendar-bounded)."""
    d = df.where(F.col(value).isNotNull())
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(rows - 1), 0)
    return d.withColumn(out, F.when(F.count(value).over(w) >= min_periods, F.avg(value).over(w)))


def top_bottom_k(df: DataFrame, family: list[str], label: str, score: str, k: int = 6,
                 salts: int = 64) -> DataFrame:
    """ST3: k highest and k lowest ``score`` per family, de-duplicated by label;
    ``side`` is the sign of the score.

    Two phases so no task sorts a whole family: keep the top/bottom k inside
    each of ``salts`` hash groups of the label (the family's top k is always
    among them), then rank the <= salts * k survivors per family."""
    d = df.where(F.col(score).isNotNull()).withColumn("_salt", F.abs(F.hash(F.col(label))) % salts)
    hi = Window.partitionBy(*family, "_salt").orderBy(F.col(score).desc(), F.col(label))
    lo = Window.partitionBy(*family, "_salt").orderBy(F.col(score).asc(), F.col(label))
    d = d.withColumn("_h0", F.row_number().over(hi)).withColumn("_l0", F.row_number().over(lo))
    d = d.where((F.col("_h0") <= k) | (F.col("_l0") <= k)).drop("_salt", "_h0", "_l0")
    hi = Window.partitionBy(*family).orderBy(F.col(score).desc(), F.col(label))
    lo = Window.partitionBy(*family).orderBy(F.col(score).asc(), F.col(label))
    d = d.withColumn("_hi", F.row_number().over(hi)).withColumn("_lo", F.row_number().over(lo))
    return d.where((F.col("_hi") <= k) | (F.col("_lo") <= k)).withColumn(
        "side", F.when(F.col(score) < 0, "negative").otherwise("positive")).drop("_hi", "_lo")


def box_summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Five-number summary, mean and 1.5-IQR whiskers per keys."""
    d = df.where(F.col(value).isNotNull())
    q = d.groupBy(*keys).agg(
        F.count(value).alias("n"), F.min(value).alias("min_value"), F.max(value).alias("max_value"),
        F.avg(value).alias("mean_value"),
        F.percentile(F.col(value), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"))
    q = q.select(*keys, "n", "min_value", "max_value", "mean_value", F.col("_q")[0].alias("q1"),
                 F.col("_q")[1].alias("median_value"), F.col("_q")[2].alias("q3"))
    lo = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))
    hi = F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    wh = d.join(q.select(*keys, lo.alias("_lo"), hi.alias("_hi")), keys).groupBy(*keys).agg(
        F.min(F.when(F.col(value) >= F.col("_lo"), F.col(value))).alias("whisker_low"),
        F.max(F.when(F.col(value) <= F.col("_hi"), F.col(value))).alias("whisker_high"))
    return q.join(wh, keys, "left")
