"""Exact quantiles by bracket refinement: a sketch, then one look inside it.

Pass 1 takes a mergeable quantile sketch per key beside whatever else is
aggregated.  Its rank error is at most ``n / accuracy`` rows, so the quantiles a
little below and above the wanted one are a bracket that holds it.  Pass 2 keeps
the values inside the bracket and only counts the rows between brackets; a value
that many rows share collapses to one row before the shuffle.  The wanted
positions are then read off the running counts.

Pass 2 reads rows of unsettled keys only.  A quantile is settled by its sketch
if both ends of the bracket are the same value, and a median also if the sketch
has left nothing out (``n < accuracy / 2``: it then holds every value).  Below
``2 * accuracy`` rows a bracket's margin is less than the two positions between
which a quantile lies, so it takes in all values, which are few.  Where no key
is left the broadcast side is empty and the rows are not read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10_000
_NEXT = 1e-9                      # the position after the middle one, for an even number of values


def sketch(value: Column, qs: dict[str, float], prefix: str = "_q", accuracy: int = ACCURACY) -> list[Column]:
    """Aggregates of pass 1: ``{prefix}_n`` values and ``{prefix}_s``, of each
    quantile its bracket's low end, itself, its successor, the high end."""
    margin = 3.0 / accuracy
    places = [p for q in qs.values() for p in (max(q - margin, 0.0), q, min(q + _NEXT, 1.0), min(q + margin, 1.0))]
    return [F.count(value).alias(f"{prefix}_n"),
            F.percentile_approx(value, F.array(*[F.lit(float(p)) for p in places]), accuracy).alias(f"{prefix}_s")]


def _of(prefix: str, j: int, part: int) -> Column:
    return F.get(F.col(f"{prefix}_s"), F.lit(4 * j + part))


def settled(qs: dict[str, float], prefix: str = "_q", accuracy: int = ACCURACY) -> dict[str, Column]:
    """The quantiles the sketch alone answers, NULL where it does not."""
    out = {}
    for j, (name, q) in enumerate(qs.items()):
        low, at, after, high = (_of(prefix, j, i) for i in range(4))
        n = F.col(f"{prefix}_n")
        found = F.when((low == high) & (n >= 2 * accuracy), low)
        if q == 0.5:
            found = found.when(n < accuracy // 2, (at + after) / 2)
        out[name] = found
    return out


def refined(first: DataFrame, rows: DataFrame, keys: list[str], value: str, qs: dict[str, float],
            prefix: str = "_q", accuracy: int = ACCURACY) -> DataFrame:
    """(keys, one column per quantile) of the keys that ``first``, a stored
    result of pass 1, leaves unsettled.  ``first`` is broadcast: keys must be
    bounded in number (days of a calendar, columns of a table)."""
    open_ = F.col(f"{prefix}_n") > 0
    unsettled = F.lit(False)
    for found in settled(qs, prefix, accuracy).values():
        unsettled = unsettled | found.isNull()
    need = first.where(open_ & unsettled).select(*keys, f"{prefix}_n", f"{prefix}_s")
    x, few = F.col(value), F.col(f"{prefix}_n") < 2 * accuracy
    inside, cell = few, F.lit(0)
    for j in range(len(qs)):
        low, high = F.when(~few, _of(prefix, j, 0)), F.when(~few, _of(prefix, j, 3))
        inside = inside | ((x >= low) & (x <= high))
        cell = cell + F.when(few, 0).otherwise((x >= low).cast("int") + (x > high).cast("int"))
    kept = rows.select(*keys, value).where(x.isNotNull())
    joined = kept.join(F.broadcast(need), keys) if keys else kept.crossJoin(F.broadcast(need))
    counts = joined.groupBy(*keys, F.col(f"{prefix}_n").alias("_n"), cell.alias("_cell"), F.when(inside, x).alias("_x")).agg(
        F.count(F.lit(1)).alias("_rows"))
    running = Window.partitionBy(*keys).orderBy("_cell", "_x").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumn("_end", F.sum("_rows").over(running))
    picks = []
    for j, q in enumerate(qs.values()):
        h = (F.col("_n") - 1) * q
        for which, at in (("0", F.floor(h)), ("1", F.ceil(h))):
            here = (F.col("_end") - F.col("_rows") <= at) & (at < F.col("_end"))
            picks.append(F.max(F.when(here, F.col("_x"))).alias(f"_v{which}_{j}"))
    got = placed.groupBy(*keys, "_n").agg(*picks)
    out = []
    for j, (name, q) in enumerate(qs.items()):
        h = (F.col("_n") - 1) * q
        low, high = F.col(f"_v0_{j}"), F.col(f"_v1_{j}")
        found = F.when(low == high, low).otherwise(low + (high - low) * (h - F.floor(h)))
        out.append(F.when(low.isNull() | high.isNull(), F.raise_error(F.lit("quantile outside its bracket")).cast("double"))
                   .otherwise(found).alias(name))
    return got.select(*keys, *out)


def with_quantiles(first: DataFrame, rows: DataFrame, keys: list[str], value: str, qs: dict[str, float],
                   prefix: str = "_q", accuracy: int = ACCURACY) -> DataFrame:
    """``first`` with its quantiles as columns, without the sketch."""
    more = refined(first, rows, keys, value, qs, prefix, accuracy)
    more = more.select(*keys, *[F.col(name).alias(f"{prefix}_r{j}") for j, name in enumerate(qs)])
    out = first.join(more, keys, "left")
    found = settled(qs, prefix, accuracy)
    return out.withColumns({name: F.coalesce(F.col(f"{prefix}_r{j}"), found[name]) for j, name in enumerate(qs)}).drop(
        f"{prefix}_n", f"{prefix}_s", *[f"{prefix}_r{j}" for j in range(len(qs))])


def exact_quantiles(df: DataFrame, keys: list[str], value: str, qs: dict[str, float], accuracy: int = ACCURACY) -> DataFrame:
    """Linear-interpolation quantiles (``percentile`` semantics) of every key
    with a value: two passes over ``df``."""
    from ..session import cut_lineage
    rows = df.select(*keys, value).where(F.col(value).isNotNull())
    first = cut_lineage(rows.groupBy(*keys).agg(*sketch(F.col(value), qs, accuracy=accuracy)))
    return with_quantiles(first, rows, keys, value, qs, accuracy=accuracy).select(*keys, *qs)
