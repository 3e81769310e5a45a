"""Null/NaN helpers that reproduce pandas semantics on Spark NULL under ANSI.

* bad text -> NULL (``try_cast``; a plain cast raises under ANSI),
* NaN -> NULL (Spark orders NaN above every number),
* a comparison with a missing value is False, not NULL,
* a ratio with a non-positive denominator is NULL (``/`` by zero raises).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_of(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: str | Column) -> Column:
    x = col_of(c)
    return F.when(~F.isnan(x), x)


def to_double(c: str | Column) -> Column:
    """Lenient numeric coercion (pandas ``to_numeric(errors='coerce')``)."""
    return nan_to_null(col_of(c).try_cast("double"))


def flag(cond: Column) -> Column:
    """Two-state boolean: a condition on a missing value is False."""
    return F.coalesce(cond, F.lit(False))


def safe_ratio(num: str | Column, den: str | Column) -> Column:
    """num / den, NULL unless den > 0."""
    n, d = col_of(num), col_of(den)
    return F.when(d > 0, F.try_divide(n, d))


SIG_DIGITS = 10


def round_sig(c: str | Column, digits: int = SIG_DIGITS) -> Column:
    """Round to ``digits`` significant digits with plain IEEE arithmetic
    (``floor(x * 10^k + 0.5001) / 10^k``, powers of ten kept exact), so Spark and
    the SQL oracle round identical doubles identically; means of few decimals
    end in an exact half, which a last bit either way must not decide."""
    x = col_of(c)
    k = F.lit(digits - 1) - F.floor(F.log10(F.abs(x)))
    up = F.pow(F.lit(10.0), k)
    down = F.pow(F.lit(10.0), -k)
    r = F.when(k >= 0, F.floor(x * up + 0.5001) / up).otherwise(F.floor(x / down + 0.5001) * down)
    return F.when(x.isNull() | (x == 0) | F.isnan(x) | (F.abs(x) == float("inf")), x).otherwise(r.cast("double"))


def round_sig_sql(c: str, digits: int = SIG_DIGITS) -> str:
    """The same rounding as DuckDB SQL text."""
    k = f"({digits - 1} - floor(log10(abs({c}))))"
    r = (f"CASE WHEN {k} >= 0 THEN floor({c} * pow(10.0, {k}) + 0.5001) / pow(10.0, {k}) "
         f"ELSE floor({c} / pow(10.0, -{k}) + 0.5001) * pow(10.0, -{k}) END")
    return f"CASE WHEN {c} IS NULL OR {c} = 0 OR isnan({c}) OR isinf({c}) THEN {c} ELSE CAST({r} AS DOUBLE) END"


def round_abs(c: str | Column, decimals: int = 10) -> Column:
    """``floor(x * 10^d + 0.5) / 10^d``: absolute rounding for differences of
    near-equal quantities (cancellation), identical arithmetic in SQL."""
    s = float(10 ** decimals)
    return F.floor(col_of(c) * s + 0.5).cast("double") / s


def round_abs_sql(c: str, decimals: int = 10) -> str:
    return f"(floor(({c}) * {float(10 ** decimals)} + 0.5) / {float(10 ** decimals)})"


def round_doubles(df, digits: int = SIG_DIGITS):
    """Round every DOUBLE column (report edge; keeps oracle hashes stable):
    ``round_sig`` in three projections.  The places of a number and their power of
    ten are found once, and a row with many numbers stays within the size of code
    that the JVM compiles."""
    from pyspark.sql.types import DoubleType
    names = [f"`{c}`" for c in df.columns]
    doubles = [f"`{f.name}`" for f in df.schema.fields if isinstance(f.dataType, DoubleType)]
    if not doubles:
        return df
    kept = {c: f"_places_{i}" for i, c in enumerate(doubles)}

    def places(x: Column) -> Column:
        special = x.isNull() | (x == 0) | F.isnan(x) | (F.abs(x) == float("inf"))
        return F.when(~special, F.lit(digits - 1) - F.floor(F.log10(F.abs(x))))

    def power(k: Column) -> Column:
        """Below zero where the number is to be divided by it."""
        return F.pow(F.lit(10.0), F.abs(k)) * F.when(k < 0, F.lit(-1.0)).otherwise(F.lit(1.0))

    def rounded(x: Column, p: Column) -> Column:
        return F.when(p > 0, F.floor(x * p + 0.5001) / p).when(p < 0, F.floor(x / -p + 0.5001) * -p).otherwise(x)

    out = df.select(*names, *[places(F.col(c)).alias(k) for c, k in kept.items()])
    out = out.select(*names, *[power(F.col(k)).alias(k) for k in kept.values()])
    return out.select(*[rounded(F.col(c), F.col(kept[c])).cast("double").alias(c.strip("`")) if c in kept else F.col(c) for c in names])
