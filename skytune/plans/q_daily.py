"""Daily roll-up queries."""

from __future__ import annotations

from ..operators import daily as D
from . import pipelines as P
from .catalog import O, query


@query("daily_summary", O.build("SELECT * FROM daily_summary", "daily_summary"))
def daily_summary(spark, sf):
    """Daily summary of the song pipeline (streams or rank weights)."""
    return P.daily(spark, sf)


@query("daily_coverage", O.build("""
SELECT date, count(rank) AS top200_rows, count(valence) AS tracks_with_valence,
       CASE WHEN count(rank) > 0 THEN count(valence) / count(rank) END AS valence_coverage
FROM song_day WHERE date IS NOT NULL GROUP BY date""", "song_day"))
def daily_coverage(spark, sf):
    """Coverage per day."""
    return D.daily_coverage(P.songs(spark, sf))


@query("daily_stream_metrics", O.build("SELECT * FROM early_metrics", "early_metrics"))
def daily_stream_metrics(spark, sf):
    """G1: stream metrics per day (early Spark path; exact median)."""
    return P.early_daily(spark, sf)


@query("daily_totals_early", O.build("""
SELECT date, sum(streams) AS total_streams,
       sum(CASE WHEN valence < 0.35 THEN streams ELSE 0.0 END) AS sad_streams,
       count(*) AS total_songs, count(*) FILTER (WHERE valence < 0.35) AS sad_songs_count,
       sum(CASE WHEN valence < 0.35 THEN streams ELSE 0.0 END) / nullif(sum(streams), 0.0) AS share_sad_streams,
       count(*) FILTER (WHERE valence < 0.35) / count(*) AS share_sad_songs
FROM song_day WHERE date IS NOT NULL AND streams >= 0 GROUP BY date""", "song_day"))
def daily_totals_early(spark, sf):
    """First pandas path totals (sad = valence < 0.35)."""
    return D.daily_totals_early(P.songs(spark, sf))


@query("daily_energy", O.build("""
SELECT date, avg(energy) AS avg_energy, count(energy) AS tracks_with_energy
FROM song_day WHERE date IS NOT NULL GROUP BY date""", "song_day"))
def daily_energy(spark, sf):
    """Mean energy and rows with energy per day."""
    return D.daily_energy(P.songs(spark, sf))
