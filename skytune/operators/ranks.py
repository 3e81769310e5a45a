"""Average ranks with ties (WN4), by window or by sample sort.

``average_rank`` partitions by the group keys: right when each group is
bounded (a series of days, an entity's days).  ``positions`` and
``average_rank_global`` are for row-grain data where one metric spans billions
of rows: no task ever holds a whole group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType


def average_rank(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """rank() + (ties - 1) / 2 over ``value`` within ``keys`` (NULLs excluded
    by the caller)."""
    w = Window.partitionBy(*keys).orderBy(F.col(value))
    ties = Window.partitionBy(*keys, value)
    return df.withColumn(out, F.rank().over(w) + (F.count(F.lit(1)).over(ties) - 1) / 2.0)


# ---- sample sort -------------------------------------------------------------------

def _changes(t: pa.Table, names: list[str]) -> np.ndarray:
    """Whether each row but the first differs from the one before in ``names``."""
    out = np.zeros(max(t.num_rows - 1, 0), bool)
    for n in names:
        column = t.column(n).combine_chunks()
        if pa.types.is_floating(column.type) and not column.null_count:        # -0.0 is 0.0
            x = column.to_numpy(zero_copy_only=False)
        else:
            codes = column.dictionary_encode()
            codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
            x = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        out |= x[1:] != x[:-1]
    return out


def _numbered(batches: Iterator[pa.RecordBatch], keys: list[str], value: str, weights: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by keys and value, with the partition's number and, for each
    weight (the first one counts rows), what the rows of the same keys in this
    partition that sort before the row's run of equal values weigh, and what the
    run weighs.  The last run of what was read is held back until it ends: at
    most this partition's rows."""
    part = TaskContext.get().partitionId()
    held: list[pa.Table] = []             # the open run
    start = size = np.zeros(len(weights) + 1, np.int64)       # what lies before it, and its own weight so far

    def out(t: pa.Table, begin: np.ndarray, weight: np.ndarray) -> list[pa.RecordBatch]:
        t = t.append_column("_part", pa.array(np.full(t.num_rows, part), pa.int32()))
        for name, v in (("_start", begin), ("_ties", weight)):
            for j in range(v.shape[1]):
                t = t.append_column(f"{name}{j}", pa.array(v[:, j]))
        return t.to_batches()

    def closed(t: pa.Table) -> list[pa.RecordBatch]:
        return out(t, np.tile(start, (t.num_rows, 1)), np.tile(size, (t.num_rows, 1)))

    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        w = np.stack([np.ones(t.num_rows, np.int64), *[t.column(c).to_numpy() for c in weights]], axis=1)
        seen = pa.concat_tables([held[-1].slice(held[-1].num_rows - 1), t]) if held else t
        new_key = _changes(seen, keys)
        new_run = new_key | _changes(seen, [value])
        if not held:
            new_key, new_run = np.r_[True, new_key], np.r_[True, new_run]
        first = np.flatnonzero(new_run)
        if not len(first):
            held.append(t)
            size = size + w.sum(axis=0)
            continue
        if held:
            held.append(t.slice(0, first[0]))
            size = size + w[:first[0]].sum(axis=0)
            for x in held:
                if x.num_rows:
                    yield from closed(x)
        runs = np.add.reduceat(w, first, axis=0)
        at = start + size + np.cumsum(runs, axis=0) - runs        # were the keys still those of the run before
        group = np.cumsum(new_key[first])
        begin = at - np.where(group[:, None] > 0, at[np.searchsorted(group, group)], 0)
        per = np.diff(first)
        if len(per):
            yield from out(t.slice(first[0], int(first[-1] - first[0])), np.repeat(begin[:-1], per, axis=0), np.repeat(runs[:-1], per, axis=0))
        held, start, size = [t.slice(first[-1])], begin[-1], runs[-1]
    for x in held:
        yield from closed(x)


def positions(df: DataFrame, keys: list[str], value: str, descending: bool = False, parts: int | None = None,
              weights: list[str] | None = None) -> DataFrame:
    """``df`` (stored anew) with ``_before``, the rows of the same keys that
    sort before this row's value, and ``_ties``, those with the same value; both
    exact, and NULL where the value is NULL.  ``_part`` numbers the ranges in order.
    For the j-th of ``weights`` (columns of whole numbers, not NULL), ``_before{j}``
    and ``_ties{j}`` add up that column in place of counting rows: a 0/1 column
    gives positions among some of the rows, all from one sort.

    A sample sort: rows are dealt to ranges of (keys, value, a row number), so
    that a value which a third of all rows share spans as many ranges as it
    needs; each range is sorted and numbered as a stream and written.  One row
    per (range, keys) then gives every range its offset, and completes the runs
    at its two ends, which may go on in other ranges.  These rows are broadcast:
    ranges times keys, whatever the number of rows."""
    from ..session import cut_lineage
    spark = df.sparkSession
    weights = weights or []
    count = range(len(weights) + 1)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last()
    salted = df.withColumn("_salt", F.monotonically_increasing_id())
    dealt = salted.repartitionByRange(parts, *keys, order, "_salt").drop("_salt").sortWithinPartitions(*keys, order)
    schema = StructType([*df.schema.fields, StructField("_part", IntegerType()),
                         *[StructField(f"{n}{j}", LongType()) for n in ("_start", "_ties") for j in count]])
    rows = cut_lineage(dealt.mapInArrow(lambda b: _numbered(b, keys, value, weights), schema))

    head, tail = (F.max, F.min) if descending else (F.min, F.max)
    pick_head, pick_tail = (F.max_by, F.min_by) if descending else (F.min_by, F.max_by)
    known = F.col(value).isNotNull()
    ends = rows.groupBy(*keys, "_part").agg(
        head(value).alias("_v0"), tail(value).alias("_v1"),
        *[F.sum(F.when(known, F.lit(1) if j == 0 else F.col(weights[j - 1]))).alias(f"_all{j}") for j in count],
        *[f("_ties" + str(j), value).alias(f"_t{e}{j}") for e, f in ((0, pick_head), (1, pick_tail)) for j in count])
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumns({f"_off{j}": F.coalesce(F.sum(f"_all{j}").over(before), F.lit(0)) for j in count})
    # a run at the end of one range goes on at the beginning of the next ones
    first = F.struct(F.lit(0).alias("end"), F.col("_v0").alias("v"), *[F.col(f"_t0{j}").alias(f"n{j}") for j in count],
                     *[F.col(f"_off{j}").alias(f"at{j}") for j in count])
    last = F.struct(F.lit(1).alias("end"), F.col("_v1").alias("v"),
                    *[F.when(F.col("_v0") != F.col("_v1"), F.col(f"_t1{j}")).otherwise(F.lit(0)).alias(f"n{j}") for j in count],
                    *[(F.col(f"_off{j}") + F.col(f"_all{j}") - F.col(f"_t1{j}")).alias(f"at{j}") for j in count])
    runs = ends.select(*keys, "_part", *[f"_off{j}" for j in count], F.explode(F.array(first, last)).alias("_r"))
    whole = Window.partitionBy(*keys, "_r.v")
    runs = runs.withColumns({f"_n{j}": F.sum(f"_r.n{j}").over(whole) for j in count} | {f"_f{j}": F.min(f"_r.at{j}").over(whole) for j in count})
    of = lambda end, c: F.max(F.when(F.col("_r.end") == end, F.col(c)))
    marks = runs.groupBy(*keys, "_part", *[f"_off{j}" for j in count]).agg(
        *[of(e, "_r.v").alias(f"_v{e}") for e in (0, 1)], *[of(e, f"_{c}{j}").alias(f"_{c}{e}{j}") for e in (0, 1) for c in "nf" for j in count])
    v = F.col(value)

    def ended(c: str, j: int, plain):
        return F.when(v == F.col("_v0"), F.col(f"_{c}0{j}")).when(v == F.col("_v1"), F.col(f"_{c}1{j}")).when(known, plain)

    name = lambda n, j: n if j == 0 else f"{n}{j - 1}"
    return beside(rows, marks, [*keys, "_part"]).select(
        *df.columns, "_part", *[ended("f", j, F.col(f"_off{j}") + F.col(f"_start{j}")).alias(name("_before", j)) for j in count],
        *[ended("n", j, F.col(f"_ties{j}")).alias(name("_ties", j)) for j in count])


def beside(rows: DataFrame, few: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` with the columns of ``few``, a table with a row per (keys,
    range) that is broadcast; NULL keys meet each other."""
    named = few.withColumnsRenamed({c: f"_of_{i}" for i, c in enumerate(on)})
    same = F.lit(True)
    for i, c in enumerate(on):
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{i}"))
    return rows.join(F.broadcast(named), same).drop(*[f"_of_{i}" for i in range(len(on))])


def average_rank_global(df: DataFrame, keys: list[str], value: str, out: str, buckets: int | None = None) -> DataFrame:
    """Exact average ranks for row-grain data (``positions`` in ``buckets``
    ranges); the rank stays on the row, nothing is joined back."""
    return positions(df, keys, value, parts=buckets).withColumn(
        out, F.col("_before") + (F.col("_ties") + 1) / 2.0).select(*df.columns, out)


def cumulative_counts(df: DataFrame, keys: list[str], value: str, buckets: int = 512,
                      keep_bucket: bool = False) -> DataFrame:
    """(keys, value, _n, _end): rows per distinct value and the 1-based
    position of its last row in value order, without a single-task window.

    1. collapse ties: ``groupBy(keys, value).count`` (map-side combined);
    2. bucket bounds per key are approximate quantiles of its distinct values
       (mergeable sketches), so buckets hold about equally many whatever the
       distribution - an outlier costs nothing;
    3. rows per bucket -> cumulative offset (<= ``buckets`` rows per key);
    4. running count inside each (key, bucket) window.
    A hot value collapses to one row in step 1, so skew cannot concentrate
    rows in one task.  Positions are exact: bounds only cut the work."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    cuts = F.percentile_approx(F.col(value), F.expr(f"array({', '.join(f'{i / buckets}D' for i in range(1, buckets))})"), 20 * buckets)
    bounds = counts.groupBy(*keys).agg(F.array_distinct(cuts).alias("_cuts"))
    place = F.size(F.filter("_cuts", lambda c: c < F.col(value))).cast("long")
    binned = counts.join(bounds, keys).withColumn("_b", F.coalesce(place, F.lit(0).cast("long"))).drop("_cuts")
    per_bucket = binned.groupBy(*keys, "_b").agg(F.sum("_n").alias("_bn"))
    offsets = per_bucket.withColumn(
        "_off", F.coalesce(F.sum("_bn").over(Window.partitionBy(*keys).orderBy("_b")
                                              .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    running = F.sum("_n").over(Window.partitionBy(*keys, "_b").orderBy(value)
                               .rowsBetween(Window.unboundedPreceding, 0))
    out = (binned.join(offsets.select(*keys, "_b", "_off"), keys + ["_b"])
           .withColumn("_end", F.col("_off") + running))
    return out.select(*keys, value, "_n", "_end", *(["_b"] if keep_bucket else []))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, qs: dict[str, float], buckets: int = 512) -> DataFrame:
    """``quantiles.exact_quantiles`` with a bracket of 6 / (20 * ``buckets``) of the rows."""
    from . import quantiles
    return quantiles.exact_quantiles(df, keys, value, qs, accuracy=20 * buckets)
