"""The reference's pipelines as lazy plan builders over the fixture views.

* E4 ``early_*``   - stream metrics per day joined to the weather calendar.
* E1/E2 ``final_daily`` - daily summary joined to the classified calendar.
* E3 ``analysis_daily`` / ``song_weather`` - benchmark, main metrics and
  calendar fields, and song rows enriched with the day attributes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import calendar_fields
from ..functions.nulls import flag
from ..functions.text import first_artist_simple, strip_blanks
from ..operators import daily as D
from ..operators import weather as W
from ..session import materialize_once
from ..sources import fixtures as X

# Fixed labels of the main metrics.
WEIGHTED_VALENCE_LABEL = "rank/streamgewogen gemiddelde valence"
PLAIN_VALENCE_LABEL = "gemiddelde valence"
SONG_SHARE_LABEL = "aandeel sad songs"
EARLY_HEAVY_RAIN_MM = 5.0


def source_files(sf: str) -> tuple[str, ...]:
    """The tables behind the day-grain tables."""
    return tuple(f"{sf.rstrip('/')}/{t}.parquet" for t in ("lineitem", "part", "orders"))


def songs(spark: SparkSession, sf: str) -> DataFrame:
    return X.song_day(spark, sf)


def weather_calendar(spark: SparkSession, sf: str) -> DataFrame:
    """Station readings -> clipped, de-duplicated, averaged, gap-free."""
    return W.weather_calendar(X.weather_station(spark, sf), songs(spark, sf).select("date"),
                              station="station", order=["ordinal"])


def weather_typed(spark: SparkSession, sf: str) -> DataFrame:
    return W.weather_types(weather_calendar(spark, sf))


def daily(spark: SparkSession, sf: str) -> DataFrame:
    return D.daily_summary(songs(spark, sf))


def final_daily(spark: SparkSession, sf: str) -> DataFrame:
    """Daily summary LEFT JOIN classified weather (day grain, broadcast).

    Materialized once per application (day grain, checkpointed)."""
    return materialize_once(spark, ("final_daily", sf), lambda: daily(spark, sf).join(
        F.broadcast(weather_typed(spark, sf)), "date", "left"), source_files(sf))


def main_metrics(df: DataFrame) -> DataFrame:
    """Dataset-level choice of the main valence and sad-share metrics."""
    has = W.one_row(df, F.count("weighted_avg_valence").alias("_nw"), F.count("main_sad_share_metric").alias("_nm"),
                    F.count("share_sad_streams").alias("_nss"), F.count("weighted_share_sad").alias("_nws"))
    d = df.crossJoin(has)
    wv = F.col("_nw") > 0
    keep = F.col("_nm") > 0
    sad = (F.when(keep, F.col("main_sad_share_metric"))
           .when(F.col("_nss") > 0, F.col("share_sad_streams"))
           .when(F.col("_nws") > 0, F.col("weighted_share_sad"))
           .otherwise(F.col("share_sad_songs")))
    sad_label = (F.when(keep, F.coalesce(F.col("main_sad_share_label"), F.lit(SONG_SHARE_LABEL)))
                 .when(F.col("_nss") > 0, F.lit(D.STREAM_SHARE_LABEL))
                 .when(F.col("_nws") > 0, F.lit(D.RANK_SHARE_LABEL))
                 .otherwise(F.lit(SONG_SHARE_LABEL)))
    rest = [c for c in df.columns if c not in ("main_sad_share_metric", "main_sad_share_label")]
    return d.select(
        *rest,
        F.when(wv, F.col("weighted_avg_valence")).otherwise(F.col("avg_valence")).alias("main_avg_valence_metric"),
        F.when(wv, F.lit(WEIGHTED_VALENCE_LABEL)).otherwise(F.lit(PLAIN_VALENCE_LABEL)).alias("main_avg_valence_label"),
        sad.alias("main_sad_share_metric"), sad_label.alias("main_sad_share_label"),
    )


def analysis_daily(spark: SparkSession, sf: str, min_days: int = W.MIN_WEATHER_GROUP_DAYS) -> DataFrame:
    """E3 load: benchmark classes, main metrics and calendar fields per day
    (materialized once per application; day grain)."""
    def build():
        d = W.weather_benchmark(final_daily(spark, sf), min_days)
        return main_metrics(d).select("*", *calendar_fields("date"))
    return materialize_once(spark, ("analysis_daily", sf, min_days), build, source_files(sf))


# Day attributes carried to song rows.
SONG_WEATHER_COLS = ["prcp", "tsun", "bad_weather", "good_weather", "good_bad_weather_type",
                     "selected_weather_benchmark_day", "season", "year", "month"]


def song_level(spark: SparkSession, sf: str) -> DataFrame:
    """Song rows with weights, flags and entity keys (row grain, lazy)."""
    s = D.song_level_weights(songs(spark, sf))
    s = s.select("*", F.lower(strip_blanks("genre")).alias("track_genre"),
                 first_artist_simple("artist").alias("artist_first"))
    return s.select("*", flag(F.col("rank") <= 50).alias("top_50"))


def song_weather(spark: SparkSession, sf: str, min_days: int = W.MIN_WEATHER_GROUP_DAYS) -> DataFrame:
    """Song rows with weights LEFT JOIN day attributes (day grain, broadcast)."""
    days = analysis_daily(spark, sf, min_days).select("date", *SONG_WEATHER_COLS)
    return song_level(spark, sf).join(F.broadcast(days), "date", "left")


# -- E4: the early Spark path ---------------------------------------------

def early_daily(spark: SparkSession, sf: str) -> DataFrame:
    return D.daily_stream_metrics(songs(spark, sf))


def early_final(spark: SparkSession, sf: str) -> DataFrame:
    """E4 final: stream metrics LEFT JOIN weather with tri-state flags
    (materialized once per application; day grain)."""
    def build():
        w = weather_calendar(spark, sf).where(F.col("date").isNotNull())
        p = F.col("prcp")
        return early_daily(spark, sf).join(F.broadcast(w), "date", "left").select(
            "*", F.when(p.isNotNull(), p > 0).alias("rainy_day"),
            F.when(p.isNotNull(), p > EARLY_HEAVY_RAIN_MM).alias("heavy_rain"))
    return materialize_once(spark, ("early_final", sf), build, source_files(sf))


def early_inner(spark: SparkSession, sf: str) -> DataFrame:
    """The same join as an inner join (days present on both sides)."""
    w = weather_calendar(spark, sf).select("date", "prcp", "tsun")
    return early_daily(spark, sf).join(F.broadcast(w), "date", "inner")
