"""Entity (genre / artist) daily shares (F8, F9, G16, WN2).

entity_share = weight of the entity on a day / weight of all valid entities
that day.  The day total is derived from the (date, entity) aggregate - a
day-grain result, calendar-bounded, so it is broadcast back - instead of a
window over all entity-day rows of a day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

# Entity names treated as missing.
MISSING_ENTITY_NAMES = ("nan", "none", "unknown")
MIN_DAYS_ENTITY = 20
DAY_COLS = ("prcp", "tsun", "good_bad_weather_type", "selected_weather_benchmark_day", "season", "year", "month")


def valid_names(df: DataFrame, entity: str) -> DataFrame:
    """F8: entity present, not blank, not a missing-name token."""
    e = F.col(entity).cast("string")
    return df.where(e.isNotNull() & (F.regexp_replace(e, r"^\s+|\s+$", "") != "") & ~F.lower(e).isin(*MISSING_ENTITY_NAMES))


def entity_daily_shares(song_weather: DataFrame, entity: str, day_attrs: DataFrame | None = None,
                        weight: str = "analysis_weight") -> DataFrame:
    """(date, entity, entity_weight, entity_tracks, day_total_weight,
    entity_share) plus the day attributes (LEFT JOIN by date)."""
    rows = song_weather.where(F.col("date").isNotNull() & F.col(entity).isNotNull() & (F.col(weight) > 0))
    # a barrier: the names are judged once per day, not per row
    ed = rows.groupBy("date", entity).agg(F.sum(weight).alias("entity_weight"), F.count(F.lit(1)).alias("entity_tracks"))
    ed = valid_names(cut_lineage(ed), entity)
    totals = ed.groupBy("date").agg(F.sum("entity_weight").alias("day_total_weight"))
    out = ed.join(F.broadcast(totals), "date").withColumn(
        "entity_share", F.col("entity_weight") / F.col("day_total_weight"))
    if day_attrs is not None:
        out = out.join(F.broadcast(day_attrs), "date", "left")
    return out


def entities_with_days(entity_day: DataFrame, entity: str, min_days: int = MIN_DAYS_ENTITY) -> DataFrame:
    """keep entities with at least ``min_days`` entity-day rows."""
    n = entity_day.groupBy(entity).agg(F.count(F.lit(1)).alias("_days")).where(F.col("_days") >= min_days)
    return entity_day.join(n.select(entity), entity, "left_semi")
