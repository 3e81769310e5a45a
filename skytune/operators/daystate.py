"""Day roll-ups as mergeable states: a new extract is read, old ones are not.

A roll-up's *state* holds, per day, sums, extremes, centred moments (count,
mean, sum of squared deviations) and a quantile sketch, all of which merge.
States of several extracts merge to the state of all their rows, states of days
to those of a season or a year, without reading the rows again.  ``DayStates``
keeps one folder of states per extract; a repeated extract replaces its own.

Medians from states are approximate: a KLL sketch as a binary column, with
``SKETCH_K`` entries a rank error of ``rank_error(SKETCH_K)`` of the rows at 99 %
confidence.  Everything else equals a full run but for the order of summation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.nulls import flag
from . import daily as D

SKETCH_K = 400

#: A measure is (kind, value); kinds: sum, least, most, moments, sketch.
Spec = dict[str, tuple[str, Column]]


def rank_error(k: int = SKETCH_K) -> float:
    """Of a KLL sketch's quantile, as a share of all rows (fixed values: the
    published fit for 99 % confidence)."""
    return 2.296 / k ** 0.9021


# ---- states --------------------------------------------------------------------

def states_of(rows: DataFrame, keys: list[str], spec: Spec, k: int = SKETCH_K) -> DataFrame:
    """One pass: the state of every key."""
    aggs = []
    for name, (kind, value) in spec.items():
        if kind == "moments":
            aggs += [F.count(value).alias(f"{name}_n"), F.avg(value).alias(f"{name}_mean"),
                     (F.var_pop(value) * F.count(value)).alias(f"{name}_m2")]
        elif kind == "sketch":
            # a key without values has no sketch
            aggs.append(F.when(F.count(value) > 0, F.kll_sketch_agg_double(value, k)).alias(name))
        else:
            aggs.append({"sum": F.sum, "least": F.min, "most": F.max}[kind](value).alias(name))
    return rows.groupBy(*keys).agg(*aggs)


def merged(states: DataFrame, keys: list[str], spec: Spec, k: int = SKETCH_K) -> DataFrame:
    """The states of coarser ``keys`` (or of the same ones, over several
    extracts).  Squared deviations move to the common mean first, so nothing
    cancels.  ``states`` is at day grain: keys are bounded by the calendar."""
    aggs = []
    for name, (kind, _) in spec.items():
        if kind == "moments":
            n, mean, m2 = (F.col(f"{name}_{p}") for p in ("n", "mean", "m2"))
            w = Window.partitionBy(*keys)
            states = states.withColumn(f"_{name}_mean", F.try_divide(F.sum(n * mean).over(w), F.sum(n).over(w)))
            off = mean - F.col(f"_{name}_mean")
            aggs += [F.sum(n).alias(f"{name}_n"), F.first(f"_{name}_mean", ignorenulls=True).alias(f"{name}_mean"),
                     F.sum(m2 + n * off * off).alias(f"{name}_m2")]
        elif kind == "sketch":
            aggs.append(F.when(F.count(name) > 0, F.kll_merge_agg_double(name, k)).alias(name))
        else:
            aggs.append({"sum": F.sum, "least": F.min, "most": F.max}[kind](name).alias(name))
    return states.groupBy(*keys).agg(*aggs)


def spread(name: str, least: str | None = None, most: str | None = None) -> Column:
    """Sample standard deviation of a ``moments`` measure, NULL below two values;
    0 where ``least`` and ``most`` are equal (merged means may differ in a bit)."""
    out = F.sqrt(F.col(f"{name}_m2") / (F.col(f"{name}_n") - 1))
    if least and most:
        out = F.when(F.col(least) == F.col(most), F.lit(0.0)).otherwise(out)
    return F.when(F.col(f"{name}_n") > 1, out)


def approximate_median(sketch: str) -> Column:
    return F.kll_sketch_get_quantile_double(sketch, F.lit(0.5))


# ---- G1: stream metrics ------------------------------------------------------------

def stream_spec(sad_threshold: float = D.SAD_THRESHOLD, inclusive: bool = False) -> Spec:
    """The measures of ``daily.STREAM_MEASURES`` as states."""
    valence, streams = F.col("valence"), F.col("streams")
    values = {None: F.lit(1).cast("long"), "valence": valence, "streams": streams, "valence_streams": valence * streams}
    conditions = {"any": F.lit(True), "known": valence.isNotNull(), "sad": D.sad_flag("valence", sad_threshold, inclusive)}
    kinds = {"rows": "sum", "total": "sum", "least": "least", "most": "most"}
    spec: Spec = {}
    for name, (take, value, when) in D.STREAM_MEASURES.items():
        if take in kinds:
            empty = {"rows": F.lit(0).cast("long"), "total": F.lit(0.0)}.get(take)
            held = F.when(conditions[when], values[value])
            spec[name] = (kinds[take], held if empty is None else held.otherwise(empty))
    return spec | {"valence": ("moments", valence), "valence_sketch": ("sketch", valence)}


def stream_metrics(states: DataFrame, keys: list[str]) -> DataFrame:
    """G1's columns from states; the median is approximate."""
    named = states.select(*keys, *[c for c in D.STREAM_MEASURES if c in states.columns], F.col("valence_mean").alias("avg_valence"),
                          spread("valence", "min_valence", "max_valence").alias("std_valence"), approximate_median("valence_sketch").alias("median_valence"))
    return D.form_ratios(named, D.STREAM_RATIOS, ("valence_streams",))


# ---- G2-G7: daily summary ------------------------------------------------------------

def summary_spec(features: list[str], sad_threshold: float = D.SAD_THRESHOLD) -> Spec:
    """The partial sums of ``daily.daily_summary`` as states."""
    v = F.col("valence")
    sad = D.sad_flag("valence", sad_threshold)
    low = flag(F.col("energy") <= D.LOW_ENERGY_THRESHOLD) if "energy" in features else F.lit(False)
    flags = {"sad": sad, "low": low, "dep": sad & low}
    counted = lambda c: F.when(c, F.lit(1)).otherwise(F.lit(0)).cast("long")
    known = v.isNotNull()
    streams = F.when(F.col("streams") >= 0, F.col("streams"))
    spec: Spec = {
        "top200_rows": ("sum", counted(F.col("rank").isNotNull())), "tracks_with_valence": ("sum", counted(known)),
        "_sad_n": ("sum", counted(known & sad)), "min_valence": ("least", v), "max_valence": ("most", v),
        "_stream_sum_all": ("sum", F.coalesce(F.col("streams"), F.lit(0.0))),
        "_total_streams": ("sum", F.when(known, streams)), "_sad_streams": ("sum", F.when(known & sad, streams)),
        "valence": ("moments", v), "valence_sketch": ("sketch", v)}
    for f in features:
        spec[f"_{f}_total"] = ("sum", F.when(known, F.col(f)))
        spec[f"_{f}_rows"] = ("sum", counted(known & F.col(f).isNotNull()))
    for tag, w in (("s", streams), ("r", D.rank_weight("rank"))):
        spec |= {name: ("sum", value) for name, value in D.weighted_values(w, tag, v, flags, features).items()}
    return spec


def summary(states: DataFrame, features: list[str]) -> DataFrame:
    """``daily.daily_summary`` from day states; the median is approximate."""
    day = states.withColumns({
        "avg_valence": F.col("valence_mean"), "std_valence": spread("valence", "min_valence", "max_valence"), "median_valence": approximate_median("valence_sketch")} | {
        f"avg_{f}": F.try_divide(F.col(f"_{f}_total"), F.nullif(F.col(f"_{f}_rows"), F.lit(0))) for f in features})
    return D.summary_columns(D.with_weight_choice(day).where(F.col("date").isNotNull()), features)


# ---- store ---------------------------------------------------------------------------

class DayStates:
    """States by extract under a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, spec: Spec, keys: tuple[str, ...] = ("date",), k: int = SKETCH_K):
        self.spark, self.path, self.spec, self.keys, self.k = spark, path.rstrip("/"), spec, list(keys), k

    def add(self, extract: str, rows: DataFrame) -> None:
        """Read one extract and keep its states; an extract of that name is
        replaced, so a failed or repeated load counts once."""
        states_of(rows, self.keys, self.spec, self.k).write.mode("overwrite").parquet(f"{self.path}/extract={extract}")

    def extracts(self) -> list[str]:
        """Extracts whose load has ended (a folder without its mark is a load
        that failed: it is left out until it is repeated)."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        root = hadoop.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        found = [s.getPath() for s in fs.listStatus(root) if s.isDirectory() and s.getPath().getName().startswith("extract=")]
        return sorted(p.toString() for p in found if fs.exists(hadoop.Path(p, "_SUCCESS")))

    def states(self) -> DataFrame:
        """The states of all extracts together."""
        paths = self.extracts()
        if not paths:
            raise FileNotFoundError(self.path)
        return merged(self.spark.read.parquet(*paths), self.keys, self.spec, self.k)
