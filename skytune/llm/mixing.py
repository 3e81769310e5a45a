"""Interleaving sources at target weights by Pfair scheduling.

Rows of a source form blocks of ``BLOCK_ROWS`` in the order of a hash of
doc_id.  With integer shares q_i of a period Q = sum q_i, block j = 1, 2, ... of
source i is released at slot floor((j - 1) Q / q_i) and due by ceil(j Q / q_i).
Each slot takes, of the released blocks, the one with the earliest deadline
(ties: the source's name).  That meets every window, so at any slot t the
number of blocks of source i differs from t q_i / Q by less than one.

At each multiple of Q all deviations are zero, so the schedule repeats: one
period is worked out on the driver (Q slots), a row's slot follows from its
block number by arithmetic in Spark.  When a source runs out a new phase
starts: the same with the remaining sources.  Every row is kept, exactly once.

A row's number in its source comes from counts per (source, hash range) and a
window inside one range, so a source with a third of all rows is spread like
any other; ranges hold about ``RANGE_ROWS`` rows at every size.  Only one row
per source reaches the driver.

Defined results: null sources are one source of their own; a weight given for
a source that has no rows is ignored, a source without a given weight gets
share 1; rows with equal doc_id are ordered arbitrarily among themselves; an
empty table gives an empty table; texts are not looked at.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

BLOCK_ROWS = 16
RANGE_ROWS = 1024
PARTS = 1000                       # shares are whole parts of about this many
TEMPERATURE = 0.5
COLUMNS = ("mix_block", "mix_slot", "mix_phase", "mix_order")


def tempered_shares(rows: dict[str, int], temperature: float = TEMPERATURE, parts: int = PARTS) -> dict[str, int]:
    """Shares in proportion to rows ** temperature, at least 1 each."""
    total = sum(n ** temperature for n in rows.values())
    return {s: max(1, round(parts * n ** temperature / total)) for s, n in rows.items()}


def pfair_period(shares: dict[str, int]) -> dict[str, list[int]]:
    """Slots of one period for each source, by earliest deadline first."""
    period = sum(shares.values())
    slots: dict[str, list[int]] = {s: [] for s in shares}
    waiting = [(0, s) for s in sorted(shares)]
    heapq.heapify(waiting)
    ready: list[tuple[int, str]] = []
    for t in range(period):
        while waiting and waiting[0][0] <= t:
            _, s = heapq.heappop(waiting)
            j = len(slots[s]) + 1
            heapq.heappush(ready, (-(-j * period // shares[s]), s))
        _, s = heapq.heappop(ready)
        slots[s].append(t)
        j = len(slots[s]) + 1
        if j <= shares[s]:
            heapq.heappush(waiting, ((j - 1) * period // shares[s], s))
    return slots


def phases(blocks: dict[str, int], shares: dict[str, int]) -> dict[str, list[dict]]:
    """For each source its phases: first and last block (exclusive), share,
    period, first slot, and slots within a period."""
    left = {s: n for s, n in blocks.items() if n > 0}
    out: dict[str, list[dict]] = {s: [] for s in left}
    done = dict.fromkeys(left, 0)
    at = number = 0
    while left:
        common = math.gcd(*(shares[s] for s in left))
        now = {s: shares[s] // common for s in left}
        period, slots = sum(now.values()), pfair_period(now)
        length = min((n - 1) // now[s] * period + slots[s][(n - 1) % now[s]] + 1 for s, n in left.items())
        whole, rest = divmod(length, period)
        for s in list(left):
            used = whole * now[s] + sum(x < rest for x in slots[s])
            out[s].append({"phase": number, "first": done[s], "last": done[s] + used, "share": now[s],
                           "period": period, "slot": at, "slots": slots[s]})
            done[s] += used
            left[s] -= used
            if not left[s]:
                del left[s]
        at += length
        number += 1
    return out


def mix_sources(df: DataFrame, weights: dict[str | None, int] | None = None, source: str = "source", doc_id: str = "doc_id",
                block_rows: int = BLOCK_ROWS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``df`` with ``mix_block`` (number within the source), ``mix_slot``,
    ``mix_phase`` and ``mix_order``, by which the rows are to be read.
    ``weights``: whole shares by source; tempered by size if None."""
    spark = df.sparkSession
    df = df.drop(*COLUMNS)
    total = df.count()
    ranges = max(1, -(-total // range_rows))
    key = F.coalesce(F.concat(F.lit("="), F.col(f"`{source}`").cast("string")), F.lit("null"))
    hashed = F.xxhash64(F.col(f"`{doc_id}`"))
    keyed = df.withColumns({"__key": key, "__hash": hashed}).withColumn(
        "__range", F.floor(F.pmod(F.col("__hash"), F.lit(1 << 30)) * ranges / (1 << 30)).cast("int"))
    counts = stored(keyed.groupBy("__key", "__range").agg(F.count(F.lit(1)).alias("n")))
    rows = {r["__key"]: r["n"] for r in counts.groupBy("__key").agg(F.sum("n").alias("n")).collect()}
    if weights is None:
        shares = tempered_shares(rows)
    else:
        given = {"null" if s is None else f"={s}": w for s, w in weights.items()}
        shares = {s: max(1, int(given.get(s, 1))) for s in rows}
    plan = phases({s: -(-n // block_rows) for s, n in rows.items()}, shares)
    schema = ("__key string, __plan array<struct<phase:int,first:long,last:long,share:long,period:long,slot:long,slots:array<int>>>")
    plans = spark.createDataFrame([(s, [(p["phase"], p["first"], p["last"], p["share"], p["period"], p["slot"], p["slots"])
                                        for p in ps]) for s, ps in plan.items()], schema)
    before = counts.withColumn("__before", F.coalesce(F.sum("n").over(
        Window.partitionBy("__key").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    here = Window.partitionBy("__key", "__range").orderBy("__hash", F.col(f"`{doc_id}`"))
    numbered = (keyed.withColumn("__place", F.row_number().over(here) - 1)
                .join(before, ["__key", "__range"])
                .withColumn("__place", F.col("__place") + F.col("__before"))
                .withColumn("mix_block", F.floor(F.col("__place") / block_rows).cast("long"))
                .join(F.broadcast(plans), "__key")
                .withColumn("__p", F.get(F.filter("__plan", lambda p: (p["first"] <= F.col("mix_block")) & (F.col("mix_block") < p["last"])), F.lit(0))))
    nth = F.col("mix_block") - F.col("__p.first")
    slot = (F.col("__p.slot") + F.floor(nth / F.col("__p.share")) * F.col("__p.period")
            + F.get(F.col("__p.slots"), (nth % F.col("__p.share")).cast("int"))).cast("long")
    return (numbered.withColumn("mix_slot", slot).withColumn("mix_phase", F.col("__p.phase"))
            .withColumn("mix_order", F.col("mix_slot") * block_rows + F.col("__place") % block_rows)
            .select(*[F.col(f"`{c}`") for c in df.columns], *COLUMNS))


def mixed_rows(df: DataFrame, weights: dict[str | None, int] | None = None, **names) -> DataFrame:
    """The rows of ``df`` in mixed order: parts in order, and rows in each."""
    out = mix_sources(df, weights, **names)
    return out.repartitionByRange("mix_order").sortWithinPartitions("mix_order").drop(*COLUMNS)
