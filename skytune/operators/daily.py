"""Song-level flags and daily roll-ups.

Every roll-up is a single ``groupBy("date")`` over the song rows with
conditional aggregates (map-side partial aggregation, so a hot day costs no
more than a cold one).  The dataset-level weight choice (streams vs rank
weight, G6) is resolved *after* the day aggregation from per-day partial
sums, so the song rows are scanned once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import flag, safe_ratio
from ..session import cut_lineage
from . import quantiles as Q

# Thresholds and labels of the authoritative version.
SAD_THRESHOLD = 0.40
LOW_ENERGY_THRESHOLD = 0.50
STREAM_SHARE_LABEL = "streamgewogen aandeel sad songs"
RANK_SHARE_LABEL = "rankgewogen aandeel sad songs"
AUDIO_FEATURES = ("energy", "danceability", "speechiness", "tempo", "acousticness",
                  "instrumentalness", "liveness", "loudness", "popularity")


def rank_weight(rank: str | Column = "rank") -> Column:
    """max(201 - rank, 1); NULL rank stays NULL."""
    r = F.col(rank) if isinstance(rank, str) else rank
    return F.when(r.isNotNull(), F.greatest(F.lit(201.0) - r, F.lit(1.0)))


def sad_flag(valence: str = "valence", threshold: float = SAD_THRESHOLD,
             inclusive: bool = True, energy: str | None = None,
             energy_threshold: float = LOW_ENERGY_THRESHOLD) -> Column:
    """sad = valence <= t (or < t); with ``energy`` the older rule
    (valence and energy low, valence alone when energy is missing)."""
    v = F.col(valence)
    low_v = v <= threshold if inclusive else v < threshold
    if energy is None:
        return flag(low_v)
    e = F.col(energy)
    return flag(F.when(e.isNull(), low_v).otherwise(low_v & (e <= energy_threshold)))


# ---- measures of a day -------------------------------------------------------
#
# A roll-up is declared: what is taken (rows, total, mean, ...), of which value,
# under which condition.  Batch and streaming roll-ups are built from the same
# lists; ratios are formed from the measures afterwards.

_TAKE = {
    "rows": lambda value, when: F.count_if(when),
    "total": lambda value, when: F.sum(F.when(when, value).otherwise(F.lit(0.0))),
    "mean": lambda value, when: F.avg(F.when(when, value)),
    "spread": lambda value, when: F.stddev_samp(F.when(when, value)),
    "least": lambda value, when: F.min(F.when(when, value)),
    "most": lambda value, when: F.max(F.when(when, value)),
}

#: measure -> (take, value, condition) of the early stream path (G1).  Fixed values: the names.
STREAM_MEASURES = {
    "song_rows": ("rows", None, "any"),
    "tracks_with_valence": ("rows", None, "known"),
    "sad_songs_count": ("rows", None, "sad"),
    "avg_valence": ("mean", "valence", "known"),
    "std_valence": ("spread", "valence", "known"),
    "min_valence": ("least", "valence", "known"),
    "max_valence": ("most", "valence", "known"),
    "total_streams": ("total", "streams", "any"),
    "streams_with_valence": ("total", "streams", "known"),
    "sad_streams": ("total", "streams", "sad"),
    "valence_streams": ("total", "valence_streams", "known"),
}
#: ratio -> (part, whole); NULL unless the whole is positive.
STREAM_RATIOS = {
    "valence_coverage": ("tracks_with_valence", "song_rows"),
    "share_sad_songs": ("sad_songs_count", "tracks_with_valence"),
    "stream_coverage": ("streams_with_valence", "total_streams"),
    "share_sad_streams": ("sad_streams", "streams_with_valence"),
    "weighted_avg_valence": ("valence_streams", "streams_with_valence"),
}


def take_measures(measures: dict, values: dict[str, Column], conditions: dict[str, Column]) -> list[Column]:
    """The aggregates of a list of measures, named."""
    return [_TAKE[take](None if value is None else values[value], conditions[when]).alias(name)
            for name, (take, value, when) in measures.items()]


def form_ratios(day: DataFrame, ratios: dict[str, tuple[str, str]], helpers: tuple[str, ...] = ()) -> DataFrame:
    """``day`` with its ratios, without the measures that only serve them."""
    return day.withColumns({r: safe_ratio(*parts) for r, parts in ratios.items()}).drop(*helpers)


def stream_rows(songs: DataFrame, negatives: str = "drop") -> DataFrame:
    """The rows a stream roll-up counts: dated, with streams; negative streams
    go (``drop``) or count as unknown (``null``)."""
    rows = songs.select("date", "streams", "valence").where("date IS NOT NULL AND streams IS NOT NULL")
    if negatives == "drop":
        return rows.where("streams >= 0")
    return rows.withColumn("streams", F.when(F.col("streams") >= 0, F.col("streams")))


def stream_measures(sad_threshold: float = SAD_THRESHOLD, inclusive: bool = False) -> list[Column]:
    """G1's aggregates over ``stream_rows``."""
    valence, streams = F.col("valence"), F.col("streams")
    return take_measures(
        STREAM_MEASURES, {"valence": valence, "streams": streams, "valence_streams": valence * streams},
        {"any": F.lit(True), "known": valence.isNotNull(), "sad": sad_flag("valence", sad_threshold, inclusive)})


#: The exact median of a day (``operators.quantiles``).
MEDIAN = {"median_valence": 0.5}


def daily_stream_metrics(songs: DataFrame, sad_threshold: float = SAD_THRESHOLD,
                         inclusive: bool = False, negatives: str = "drop") -> DataFrame:
    """G1 (early Spark path): stream metrics per day of (date, streams, valence).

    The measures and a quantile sketch come from one pass, written at day
    grain; days too large for the sketch alone are read once more."""
    rows = stream_rows(songs, negatives)
    day = cut_lineage(rows.groupBy("date").agg(*stream_measures(sad_threshold, inclusive), *Q.sketch(F.col("valence"), MEDIAN)))
    return Q.with_quantiles(form_ratios(day, STREAM_RATIOS, ("valence_streams",)), rows, ["date"], "valence", MEDIAN)


def daily_totals_early(songs: DataFrame, sad_threshold: float = 0.35) -> DataFrame:
    """G8 (first pandas path): totals per day over rows with streams >= 0.

    sad = valence < 0.35; shares divide by all streams / all songs of the day.
    """
    s = songs.where(F.col("date").isNotNull() & (F.col("streams") >= 0))
    sad = flag(F.col("valence") < sad_threshold)
    d = s.groupBy("date").agg(
        F.sum("streams").alias("total_streams"),
        F.sum(F.when(sad, F.col("streams")).otherwise(F.lit(0.0))).alias("sad_streams"),
        F.count(F.lit(1)).alias("total_songs"),
        F.count_if(sad).alias("sad_songs_count"),
    )
    return d.select("*", F.try_divide(F.col("sad_streams"), F.nullif(F.col("total_streams"), F.lit(0.0))).alias("share_sad_streams"),
                    (F.col("sad_songs_count") / F.col("total_songs")).alias("share_sad_songs"))


def daily_coverage(songs: DataFrame) -> DataFrame:
    """Rows with a rank, rows with valence, and their ratio per day."""
    d = songs.where(F.col("date").isNotNull()).groupBy("date").agg(
        F.count("rank").alias("top200_rows"), F.count("valence").alias("tracks_with_valence"))
    return d.select("*", safe_ratio("tracks_with_valence", "top200_rows").alias("valence_coverage"))


def weighted_values(w: Column, tag: str, v: Column, flags: dict[str, Column], features: list[str]) -> dict[str, Column]:
    """What the weighted means and shares of a weight add up, by name."""
    ok = v.isNotNull() & w.isNotNull() & (w > 0)
    parts = {f"_{tag}_vnum": F.when(ok, v * w), f"_{tag}_den": F.when(ok, w), f"_{tag}_total": F.when(v.isNotNull(), w)}
    for name, fl in flags.items():
        parts[f"_{tag}_{name}"] = F.when(ok & fl, w)
    for f in features:
        x = F.col(f)
        okf = ok & x.isNotNull()
        parts |= {f"_{tag}_{f}_num": F.when(okf, x * w), f"_{tag}_{f}_den": F.when(okf, w)}
    return parts


def _weighted_parts(w: Column, tag: str, v: Column, flags: dict[str, Column],
                    features: list[str]) -> list[Column]:
    return [F.sum(value).alias(name) for name, value in weighted_values(w, tag, v, flags, features).items()]


def daily_summary(songs: DataFrame, features: list[str] | None = None,
                  sad_threshold: float = SAD_THRESHOLD) -> DataFrame:
    """The daily summary of the song pipeline: a pass over all
    columns and a narrow one for the median's sketch, written at day grain;
    days whose median the sketch leaves open are read once more.

    Input: date, rank, streams, valence and the audio features present.
    Days whose rows all lack valence keep their coverage and get NULL metrics.
    Weight = streams (negatives nulled) when the dataset's streams sum > 0,
    else the rank weight; the choice is labelled in ``weight_source``.
    """
    if features is None:
        features = [f for f in AUDIO_FEATURES if f in songs.columns]
    v = F.col("valence")
    sad = sad_flag("valence", sad_threshold)
    low = flag(F.col("energy") <= LOW_ENERGY_THRESHOLD) if "energy" in songs.columns else F.lit(False)
    flags = {"sad": sad, "low": low, "dep": sad & low}
    streams_nn = F.when(F.col("streams") >= 0, F.col("streams"))
    rw = rank_weight("rank")
    aggs = [
        F.count("rank").alias("top200_rows"),
        F.count(v).alias("tracks_with_valence"),
        F.avg(v).alias("avg_valence"),
        F.stddev_samp(v).alias("std_valence"), F.min(v).alias("min_valence"), F.max(v).alias("max_valence"),
        F.count_if(v.isNotNull() & sad).alias("_sad_n"),
        F.sum(F.coalesce(F.col("streams"), F.lit(0.0))).alias("_stream_sum_all"),
        F.sum(F.when(v.isNotNull(), streams_nn)).alias("_total_streams"),
        F.sum(F.when(v.isNotNull() & sad, streams_nn)).alias("_sad_streams"),
    ]
    aggs += [F.avg(F.when(v.isNotNull(), F.col(f))).alias(f"avg_{f}") for f in features]
    aggs += _weighted_parts(streams_nn, "s", v, flags, features)
    aggs += _weighted_parts(rw, "r", v, flags, features)
    # the sketch has a narrow pass of its own: beside it, the other aggregates
    # would leave generated code
    sketched = songs.groupBy(F.col("date").alias("_date")).agg(*Q.sketch(v, MEDIAN))
    per_day = songs.groupBy("date").agg(*aggs)
    per_day = cut_lineage(per_day.join(sketched, F.col("date").eqNullSafe(F.col("_date"))).drop("_date"))
    per_day = with_weight_choice(per_day).where(F.col("date").isNotNull())
    return summary_columns(Q.with_quantiles(per_day, songs, ["date"], "valence", MEDIAN), features)


def with_weight_choice(per_day: DataFrame) -> DataFrame:
    """The dataset-level weight choice from the per-day partial sums.  The
    window has no partition key, but it runs over day-grain rows (one per
    calendar day), never over song rows."""
    has_streams = F.sum("_stream_sum_all").over(Window.partitionBy()) > 0
    return per_day.withColumn("_has_streams", F.coalesce(has_streams, F.lit(False)))


def summary_columns(per_day: DataFrame, features: list[str]) -> DataFrame:
    """The columns of the daily summary from a day's partial sums."""
    used = F.col("tracks_with_valence") > 0
    hs = F.col("_has_streams")

    def pick(name: str) -> Column:
        return F.when(hs, F.col(f"_s_{name}")).otherwise(F.col(f"_r_{name}"))

    def wratio(num: str, den: str) -> Column:
        return F.try_divide(pick(num), F.nullif(pick(den), F.lit(0.0)))

    total_streams = F.when(used & hs, F.coalesce(F.col("_total_streams"), F.lit(0.0)))
    sad_streams = F.when(used & hs, F.coalesce(F.col("_sad_streams"), F.lit(0.0)))
    share_sad_streams = F.when(total_streams > 0, F.try_divide(sad_streams, total_streams))
    cols = [
        "date", F.col("top200_rows").cast("long").alias("top200_rows"),
        F.col("tracks_with_valence").cast("long").alias("tracks_with_valence"),
        safe_ratio("tracks_with_valence", "top200_rows").alias("valence_coverage"),
        "avg_valence", "median_valence", "std_valence", "min_valence", "max_valence",
        F.when(used, F.col("_sad_n")).cast("long").alias("sad_songs_count"),
        F.when(used, F.col("_sad_n") / F.col("tracks_with_valence")).alias("share_sad_songs"),
        wratio("vnum", "den").alias("weighted_avg_valence"),
        wratio("sad", "den").alias("weighted_share_sad"),
        wratio("low", "den").alias("weighted_share_low_energy"),
        wratio("dep", "den").alias("weighted_share_depressive"),
        F.when(used, F.coalesce(pick("total"), F.lit(0.0))).alias("analysis_weight_total"),
        F.when(used, F.when(hs, F.lit("streams")).otherwise(F.lit("rank_weight"))).alias("weight_source"),
    ]
    for f in features:
        cols += [F.col(f"avg_{f}"), wratio(f"{f}_num", f"{f}_den").alias(f"weighted_avg_{f}")]
    cols += [
        total_streams.alias("total_streams"), sad_streams.alias("sad_streams"),
        share_sad_streams.alias("share_sad_streams"),
        F.when(used, F.when(hs, share_sad_streams).otherwise(wratio("sad", "den"))).alias("main_sad_share_metric"),
        F.when(used, F.when(hs, F.lit(STREAM_SHARE_LABEL)).otherwise(F.lit(RANK_SHARE_LABEL))).alias("main_sad_share_label"),
    ]
    return per_day.select(*cols)


def song_level_weights(songs: DataFrame) -> DataFrame:
    """G6 at song grain: analysis_weight and weight_source per row.

    The dataset-level choice is a scalar subquery (executed once, one column
    scanned), not a join."""
    has_streams = songs.select((F.sum(F.coalesce(F.col("streams"), F.lit(0.0))) > 0).alias("h")).scalar()
    hs = F.coalesce(has_streams, F.lit(False))
    streams_nn = F.when(F.col("streams") >= 0, F.col("streams"))
    return songs.select(
        *[c for c in songs.columns if c != "streams"],
        F.when(hs, streams_nn).otherwise(F.col("streams")).alias("streams"),
        rank_weight("rank").alias("rank_weight"),
        F.when(hs, streams_nn).otherwise(rank_weight("rank")).alias("analysis_weight"),
        F.when(hs, F.lit("streams")).otherwise(F.lit("rank_weight")).alias("weight_source"),
    )


def daily_energy(songs: DataFrame) -> DataFrame:
    """Mean energy and rows with energy per day."""
    return songs.where(F.col("date").isNotNull()).groupBy("date").agg(
        F.avg("energy").alias("avg_energy"), F.count("energy").alias("tracks_with_energy"))
