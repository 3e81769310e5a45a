"""Keep-first de-duplication (F12-F14, WN3).

``keep_first`` is a ``groupBy(keys)`` with ``min_by(struct(row), struct(order))``:
an aggregate with map-side partial combine, so a key holding a third of all
rows is reduced on every mapper before the shuffle (a ``row_number`` window
would pull that key into one task).  The order must be total (add
tie-breakers) for a deterministic winner.  The aggregate sorts, since its state
holds texts; a hash of the keys goes first, so that the sort compares numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.dropDuplicates(keys)
    picked = df.groupBy(F.xxhash64(*keys).alias("_hash"), *keys).agg(
        F.min_by(F.struct(*[F.col(c) for c in rest]), F.struct(*[F.col(c) for c in order])).alias("_first"))
    return picked.select(*keys, *[F.col("_first")[c].alias(c) for c in rest]).select(*df.columns)
