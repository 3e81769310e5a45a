"""Covariate (weather) calendar and day classes.

Day-grain tables have one row per calendar day, so their size is bounded by
the date range, not by the data volume; dataset-level thresholds (quantiles,
mean, sd, counts) are one-row aggregates joined with ``broadcast``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import flag
from .dedup import keep_first

# Thresholds of the authoritative versions.
HEAVY_RAIN_MM = 5.0
MIN_PRCP_STRICT_RAINY = 1.0
MAX_PRCP_STRICT_SUNNY = 0.2
PRCP_GOOD_MAX = 0.2
PRCP_BAD_FLOOR = 1.0
PRCP_BAD_FLOOR_RELAXED = 0.5
MIN_WEATHER_GROUP_DAYS = 20
EXTREME_RAIN_MM = 5.0
EXTREME_DRY_MM = 1.0

# Fixed labels.
RAIN_LABEL, DRY_LABEL = "Regenachtig", "Droog"
STRICT_RAINY, STRICT_SUNNY, STRICT_MIXED = "Strict regenachtig", "Strict zonnig", "Gemengd/overig"
BAD_WEATHER_LABEL = "Regenachtig/slecht weer"
GOOD_WEATHER_LABEL = "Zonnig/goed weer"
EXTREME_RAINY, EXTREME_SUNNY = "strict_rainy", "strict_sunny"


def one_row(df: DataFrame, *aggs: Column) -> DataFrame:
    """A dataset-level scalar row, broadcast (size bound: one row)."""
    return F.broadcast(df.agg(*aggs))


def station_daily_mean(raw: DataFrame, station: str | None = "station",
                       order: list[str] | None = None) -> DataFrame:
    """F14 + G9: keep the first reading per (station, date) - or de-dup on
    (date, prcp, tsun) without a station - then average stations per day."""
    cols = ["date", "prcp", "tsun"]
    r = raw.where(F.col("date").isNotNull())
    if station is not None:
        r = keep_first(r.select(station, *cols, *(order or [])), [station, "date"], order or cols)
    else:
        r = r.select(*cols).dropDuplicates(cols)
    return r.groupBy("date").agg(F.avg("prcp").alias("prcp"), F.avg("tsun").alias("tsun"))


def date_bounds(df: DataFrame, date: str = "date") -> DataFrame:
    return one_row(df, F.min(date).alias("_start"), F.max(date).alias("_end"))


def clip_to(df: DataFrame, bounds: DataFrame, date: str = "date") -> DataFrame:
    """keep rows whose date lies in the bounds row (broadcast, one row)."""
    return df.crossJoin(bounds).where(F.col(date).between(F.col("_start"), F.col("_end"))).drop("_start", "_end")


def calendar(bounds: DataFrame) -> DataFrame:
    """One row per day from _start to _end (size = the date range)."""
    return bounds.select(F.explode(F.sequence("_start", "_end", F.expr("INTERVAL 1 DAY"))).alias("date"))


def weather_calendar(readings: DataFrame, span_of: DataFrame, station: str | None = "station",
                     order: list[str] | None = None) -> DataFrame:
    """E2 core: clip readings to the date span of ``span_of``, station mean per
    day, and fill the gap-free calendar (missing days -> NULL values)."""
    bounds = date_bounds(span_of)
    daily = station_daily_mean(clip_to(readings, bounds), station, order)
    return calendar(bounds).join(F.broadcast(daily), "date", "left")


def _z(x: str, mean: str, sd: str) -> Column:
    return F.when(F.col(sd) != 0, (F.col(x) - F.col(mean)) / F.col(sd))


def weather_types(weather: DataFrame, heavy_inclusive: bool = True, dry_rule: str = "le0",
                  unknown_as_false: bool = True) -> DataFrame:
    """Rain flags, rain/dry label, z-scores and the strict
    (q40/q60 of tsun) type with its English key."""
    stats = one_row(
        weather,
        F.percentile(F.col("tsun"), F.array(F.lit(0.40), F.lit(0.60))).alias("_q"),
        F.avg("prcp").alias("_mp"), F.stddev_samp("prcp").alias("_sp"),
        F.avg("tsun").alias("_mt"), F.stddev_samp("tsun").alias("_st"),
    )
    w = weather.crossJoin(stats)
    p, t = F.col("prcp"), F.col("tsun")
    wrap = flag if unknown_as_false else (lambda c: c)
    dry = {"le0": p <= 0, "eq0": p == 0, "le02": p <= 0.2}[dry_rule]
    rainy_strict = flag((p >= MIN_PRCP_STRICT_RAINY) & (t <= F.col("_q")[0]))
    sunny_strict = flag((p <= MAX_PRCP_STRICT_SUNNY) & (t >= F.col("_q")[1]))
    zt, zp = _z("tsun", "_mt", "_st"), _z("prcp", "_mp", "_sp")
    return w.select(
        *weather.columns,
        wrap(p > 0).alias("rainy_day"),
        wrap(p >= HEAVY_RAIN_MM if heavy_inclusive else p > HEAVY_RAIN_MM).alias("heavy_rain"),
        wrap(dry).alias("dry_day"),
        F.when(p > 0, RAIN_LABEL).otherwise(DRY_LABEL).alias("rain_dry_type"),
        (zt - zp).alias("weather_score_sunny"), (zp - zt).alias("weather_score_dreary"),
        F.when(rainy_strict, STRICT_RAINY).when(sunny_strict, STRICT_SUNNY).otherwise(STRICT_MIXED).alias("strict_weather_type"),
        F.when(rainy_strict, "rainy").when(sunny_strict, "sunny").otherwise("mixed").alias("weather_type_key"),
    )


def rain_dry_classes(daily: DataFrame) -> DataFrame:
    """X12b/X13 (v3 split without a neutral class): rainy = prcp > 0,
    dry = prcp == 0 (both False when prcp is missing), label Regenachtig /
    Droog (missing prcp is labelled dry), and the sunny/rainy score pair."""
    stats = one_row(daily, F.avg("prcp").alias("_mp"), F.stddev_samp("prcp").alias("_sp"),
                    F.avg("tsun").alias("_mt"), F.stddev_samp("tsun").alias("_st"))
    p = F.col("prcp")
    zt, zp = _z("tsun", "_mt", "_st"), _z("prcp", "_mp", "_sp")
    return daily.crossJoin(stats).select(
        *daily.columns, flag(p > 0).alias("rainy_day"), flag(p == 0).alias("dry_day"),
        F.when(flag(p > 0), RAIN_LABEL).otherwise(DRY_LABEL).alias("rain_dry_type"),
        (zt - zp).alias("weather_score_sunny"), (zp - zt).alias("weather_score_rainy"))


def strict_thresholds(weather: DataFrame) -> DataFrame:
    """Threshold table of the strict type (q40/q60; +-inf when tsun is empty)."""
    q = weather.agg(F.percentile(F.col("tsun"), F.array(F.lit(0.40), F.lit(0.60))).alias("q"))
    return q.select(F.inline(F.array(
        F.struct(F.lit("min_prcp_strict_rainy").alias("threshold"), F.lit(MIN_PRCP_STRICT_RAINY).alias("value")),
        F.struct(F.lit("max_prcp_strict_sunny").alias("threshold"), F.lit(MAX_PRCP_STRICT_SUNNY).alias("value")),
        F.struct(F.lit("tsun_low_quantile_40").alias("threshold"),
                 F.coalesce(F.col("q")[0], F.lit(float("inf"))).alias("value")),
        F.struct(F.lit("tsun_high_quantile_60").alias("threshold"),
                 F.coalesce(F.col("q")[1], F.lit(float("-inf"))).alias("value")),
    )))


def _benchmark_row(daily: DataFrame, min_days: int) -> DataFrame:
    """X16 thresholds as one row: strict pass, counts under it, relaxed pass."""
    p, t = F.col("prcp"), F.col("tsun")
    q = daily.agg(
        F.percentile(p, F.array(F.lit(0.50), F.lit(0.67))).alias("_qp"),
        F.percentile(t, F.array(F.lit(0.33), F.lit(0.50), F.lit(0.67))).alias("_qt"),
        (F.min(t) < F.max(t)).alias("_tsun_ok"),
    )
    q = q.select(
        F.coalesce(F.col("_tsun_ok"), F.lit(False)).alias("_tsun_ok"),
        F.greatest(F.lit(PRCP_BAD_FLOOR), F.coalesce(F.col("_qp")[1], F.lit(PRCP_BAD_FLOOR))).alias("_pbad_strict"),
        F.greatest(F.lit(PRCP_BAD_FLOOR_RELAXED), F.coalesce(F.col("_qp")[0], F.lit(PRCP_BAD_FLOOR_RELAXED))).alias("_pbad_relaxed"),
        F.col("_qt")[2].alias("_tgood_strict"), F.col("_qt")[0].alias("_tbad_strict"), F.col("_qt")[1].alias("_tmid"),
    )
    counts = daily.crossJoin(F.broadcast(q)).agg(
        F.first("_tsun_ok").alias("_tsun_ok"), F.first("_pbad_strict").alias("_pbad_strict"),
        F.first("_pbad_relaxed").alias("_pbad_relaxed"), F.first("_tgood_strict").alias("_tgood_strict"),
        F.first("_tbad_strict").alias("_tbad_strict"), F.first("_tmid").alias("_tmid"),
        F.count_if(flag((p <= PRCP_GOOD_MAX) & (t >= F.col("_tgood_strict")))).alias("_ng"),
        F.count_if(flag((p >= F.col("_pbad_strict")) & (t <= F.col("_tbad_strict")))).alias("_nb"),
    )
    strict_ok = (F.col("_ng") >= min_days) & (F.col("_nb") >= min_days)
    version = (F.when(~F.col("_tsun_ok"), "prcp_only_fallback")
               .when(strict_ok, "strict_prcp_and_tsun")
               .otherwise("relaxed_prcp_and_tsun_due_to_low_n"))
    return F.broadcast(counts.select(
        version.alias("benchmark_version"),
        F.lit(PRCP_GOOD_MAX).alias("prcp_good_max"),
        F.when(~F.col("_tsun_ok") | strict_ok, F.col("_pbad_strict")).otherwise(F.col("_pbad_relaxed")).alias("prcp_bad_min"),
        F.when(~F.col("_tsun_ok"), F.lit(None).cast("double"))
         .when(strict_ok, F.col("_tgood_strict")).otherwise(F.col("_tmid")).alias("tsun_good_min"),
        F.when(~F.col("_tsun_ok"), F.lit(None).cast("double"))
         .when(strict_ok, F.col("_tbad_strict")).otherwise(F.col("_tmid")).alias("tsun_bad_max"),
    ))


def weather_benchmark(daily: DataFrame, min_days: int = MIN_WEATHER_GROUP_DAYS,
                      keep_thresholds: bool = False) -> DataFrame:
    """Adaptive good/bad weather benchmark with exclusive flags and the
    good/bad z-score pair.  No collect: three one-row passes, broadcast."""
    th = _benchmark_row(daily, min_days)
    stats = one_row(daily, F.avg("prcp").alias("_mp"), F.stddev_samp("prcp").alias("_sp"),
                    F.avg("tsun").alias("_mt"), F.stddev_samp("tsun").alias("_st"))
    d = daily.crossJoin(th).crossJoin(stats)
    p, t = F.col("prcp"), F.col("tsun")
    fallback = F.col("benchmark_version") == "prcp_only_fallback"
    good = flag(F.when(fallback, p <= F.col("prcp_good_max"))
                .otherwise((p <= F.col("prcp_good_max")) & (t >= F.col("tsun_good_min"))))
    bad = flag(F.when(fallback, p >= F.col("prcp_bad_min"))
               .otherwise((p >= F.col("prcp_bad_min")) & (t <= F.col("tsun_bad_max"))))
    zt, zp = _z("tsun", "_mt", "_st"), _z("prcp", "_mp", "_sp")
    label = F.when(good & ~bad, GOOD_WEATHER_LABEL).when(bad & ~good, BAD_WEATHER_LABEL)
    extra = ["benchmark_version", "prcp_good_max", "prcp_bad_min", "tsun_good_min", "tsun_bad_max"] if keep_thresholds else []
    return d.select(
        *daily.columns,
        (good & ~bad).alias("good_weather"), (bad & ~good).alias("bad_weather"),
        label.alias("good_bad_weather_type"), label.isNotNull().alias("selected_weather_benchmark_day"),
        (zt - zp).alias("weather_score_good"), (zp - zt).alias("weather_score_bad"),
        *extra,
    )


# Fixed texts of the threshold table.
BENCHMARK_MEANINGS = (
    ("prcp_good_max", "Maximum neerslag voor zonnig/goed weer"),
    ("prcp_bad_min", "Minimum neerslag voor regenachtig/slecht weer"),
    ("tsun_good_min", "Minimum zonneschijn voor zonnig/goed weer"),
    ("tsun_bad_max", "Maximum zonneschijn voor regenachtig/slecht weer"),
    ("n_good_weather_days", "Aantal geselecteerde zonnige/goede dagen"),
    ("n_bad_weather_days", "Aantal geselecteerde regenachtige/slechte dagen"),
    ("benchmark_version", "Gebruikte definitie"),
)


def benchmark_thresholds(daily: DataFrame, min_days: int = MIN_WEATHER_GROUP_DAYS) -> DataFrame:
    """P11 over X16: (parameter, value, label, meaning), seven rows; numbers
    in ``value``, the version name in ``label``."""
    b = weather_benchmark(daily, min_days, keep_thresholds=True)
    row = b.agg(F.first("prcp_good_max").alias("prcp_good_max"), F.first("prcp_bad_min").alias("prcp_bad_min"),
                F.first("tsun_good_min").alias("tsun_good_min"), F.first("tsun_bad_max").alias("tsun_bad_max"),
                F.count_if("good_weather").cast("double").alias("n_good_weather_days"),
                F.count_if("bad_weather").cast("double").alias("n_bad_weather_days"),
                F.first("benchmark_version").alias("benchmark_version"))
    entries = [F.struct(F.lit(k).alias("parameter"),
                        (F.lit(None).cast("double") if k == "benchmark_version" else F.col(k).cast("double")).alias("value"),
                        (F.col(k) if k == "benchmark_version" else F.lit(None).cast("string")).alias("label"),
                        F.lit(m).alias("meaning")) for k, m in BENCHMARK_MEANINGS]
    return row.select(F.inline(F.array(*entries)))


def extreme_groups(daily: DataFrame, valence_metric: str, sad_metric: str,
                   coverage_min: float = 0.70) -> DataFrame:
    """F7 + X15: coverage-filtered days labelled strict_rainy (prcp >= 5 and
    tsun <= q25) or strict_sunny (prcp < 1 and tsun >= q75), else NULL."""
    d = daily.where(F.col("date").isNotNull() & F.col("valence_coverage").isNotNull()
                    & F.col(valence_metric).isNotNull() & F.col(sad_metric).isNotNull()
                    & F.col("prcp").isNotNull() & F.col("tsun").isNotNull()
                    & (F.col("valence_coverage") >= coverage_min))
    q = one_row(d, F.percentile("tsun", F.array(F.lit(0.25), F.lit(0.75))).alias("_q"))
    p, t = F.col("prcp"), F.col("tsun")
    rainy = flag((p >= EXTREME_RAIN_MM) & (t <= F.col("_q")[0]))
    sunny = flag((p < EXTREME_DRY_MM) & (t >= F.col("_q")[1]))
    return d.crossJoin(q).select(*d.columns, rainy.alias("strict_rainy_day"), sunny.alias("strict_sunny_day"),
                                 F.when(sunny, EXTREME_SUNNY).when(rainy, EXTREME_RAINY).alias("extreme_group"))


def compared(days: DataFrame, group: str = "extreme_group", least: int = 2) -> DataFrame:
    """the days of a group, for a comparison.  Raises ``ValueError`` where
    no day has a group or fewer than ``least`` groups are left (one row of
    counts reaches the driver); the definitions are then too strict."""
    chosen = days.where(F.col(group).isNotNull())
    found = chosen.agg(F.count(F.lit(1)).alias("days"), F.countDistinct(group).alias("groups")).first()
    if not found["days"]:
        raise ValueError("no day is in any of the groups: loosen the thresholds")
    if found["groups"] < least:
        raise ValueError(f"{found['groups']} of {least} groups have days: loosen the thresholds")
    return chosen
