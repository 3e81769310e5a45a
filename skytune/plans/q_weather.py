"""Weather calendar, classes, joins and group summaries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import weather as W
from ..session import cut_lineage
from . import pipelines as P
from .catalog import O, query


@query("weather_daily_calendar", O.build("SELECT * FROM weather_cal", "weather_cal"))
def weather_daily_calendar(spark, sf):
    """Clipped, de-duplicated station mean on the gap-free calendar."""
    return P.weather_calendar(spark, sf)


@query("weather_classes_strict", O.build("SELECT * FROM weather_typed", "weather_typed"))
def weather_classes_strict(spark, sf):
    """Rain flags, rain/dry label, scores, strict type."""
    return P.weather_typed(spark, sf)


@query("strict_thresholds", O.build("""
SELECT * FROM (VALUES ('min_prcp_strict_rainy', 1.0), ('max_prcp_strict_sunny', 0.2)) t(threshold, value)
UNION ALL SELECT 'tsun_low_quantile_40', coalesce(q40, 'inf'::DOUBLE) FROM wt_stats
UNION ALL SELECT 'tsun_high_quantile_60', coalesce(q60, '-inf'::DOUBLE) FROM wt_stats""", "wt_stats"))
def strict_thresholds(spark, sf):
    """Threshold table of the strict weather type."""
    return W.strict_thresholds(P.weather_calendar(spark, sf))


@query("final_daily_left", O.build("SELECT * FROM final_daily", "final_daily"))
def final_daily_left(spark, sf):
    """Daily summary LEFT JOIN classified weather."""
    return P.final_daily(spark, sf)


@query("weather_benchmark", O.build("SELECT * FROM benchmarked", "benchmarked"))
def weather_benchmark(spark, sf):
    """Adaptive good/bad benchmark on the final daily table."""
    return W.weather_benchmark(P.final_daily(spark, sf))


@query("benchmark_thresholds", O.build("""
SELECT 'prcp_good_max' AS parameter, prcp_good_max AS value, NULL::VARCHAR AS label, 'Maximum neerslag voor zonnig/goed weer' AS meaning FROM benchmarked_th
UNION ALL SELECT 'prcp_bad_min', prcp_bad_min, NULL, 'Minimum neerslag voor regenachtig/slecht weer' FROM benchmarked_th
UNION ALL SELECT 'tsun_good_min', tsun_good_min, NULL, 'Minimum zonneschijn voor zonnig/goed weer' FROM benchmarked_th
UNION ALL SELECT 'tsun_bad_max', tsun_bad_max, NULL, 'Maximum zonneschijn voor regenachtig/slecht weer' FROM benchmarked_th
UNION ALL SELECT 'n_good_weather_days', CAST(count(*) FILTER (WHERE good_weather) AS DOUBLE), NULL, 'Aantal geselecteerde zonnige/goede dagen' FROM benchmarked
UNION ALL SELECT 'n_bad_weather_days', CAST(count(*) FILTER (WHERE bad_weather) AS DOUBLE), NULL, 'Aantal geselecteerde regenachtige/slechte dagen' FROM benchmarked
UNION ALL SELECT 'benchmark_version', NULL, benchmark_version, 'Gebruikte definitie' FROM benchmarked_th""", "benchmarked_th", "benchmarked"))
def benchmark_thresholds(spark, sf):
    """P11 over X16: the seven-row threshold table (numbers in value, version in label)."""
    return W.benchmark_thresholds(P.final_daily(spark, sf))


@query("final_daily_inner", O.build("""
SELECT e.*, w.prcp, w.tsun FROM early_metrics e JOIN weather_cal w ON e.date = w.date""", "early_metrics", "weather_cal"))
def final_daily_inner(spark, sf):
    """Stream metrics INNER JOIN the weather calendar."""
    return P.early_inner(spark, sf)


@query("final_daily_early", O.build("SELECT * FROM early_final", "early_final"))
def final_daily_early(spark, sf):
    """Stream metrics LEFT JOIN weather with tri-state flags."""
    return P.early_final(spark, sf)


@query("rain_group_summary", O.build("""
SELECT rainy_day, count(*) AS days, avg(prcp) AS avg_prcp, avg(tsun) AS avg_tsun,
       avg(sad_streams) AS avg_sad_streams, avg(share_sad_streams) AS avg_share_sad_streams,
       avg(share_sad_songs) AS avg_share_sad_songs, avg(weighted_avg_valence) AS avg_weighted_valence
FROM early_final WHERE prcp IS NOT NULL GROUP BY rainy_day""", "early_final"))
def rain_group_summary(spark, sf):
    """Rainy vs dry day averages (days with prcp only)."""
    f = P.early_final(spark, sf).where(F.col("prcp").isNotNull())
    return f.groupBy("rainy_day").agg(
        F.count(F.lit(1)).alias("days"), F.avg("prcp").alias("avg_prcp"), F.avg("tsun").alias("avg_tsun"),
        F.avg("sad_streams").alias("avg_sad_streams"), F.avg("share_sad_streams").alias("avg_share_sad_streams"),
        F.avg("share_sad_songs").alias("avg_share_sad_songs"), F.avg("weighted_avg_valence").alias("avg_weighted_valence"))


_EXTREME_SQL = """
SELECT *, coalesce(prcp >= 5.0 AND tsun <= q25, false) AS strict_rainy_day,
       coalesce(prcp < 1.0 AND tsun >= q75, false) AS strict_sunny_day,
       CASE WHEN coalesce(prcp < 1.0 AND tsun >= q75, false) THEN 'strict_sunny'
            WHEN coalesce(prcp >= 5.0 AND tsun <= q25, false) THEN 'strict_rainy' END AS extreme_group
FROM ext_base, (SELECT quantile_cont(tsun, 0.25) AS q25, quantile_cont(tsun, 0.75) AS q75 FROM ext_base)"""
O.part("ext_base", ("analysis_daily",), """
SELECT date, valence_coverage, main_avg_valence_metric, main_sad_share_metric, prcp, tsun FROM analysis_daily
WHERE valence_coverage IS NOT NULL AND main_avg_valence_metric IS NOT NULL AND main_sad_share_metric IS NOT NULL
  AND prcp IS NOT NULL AND tsun IS NOT NULL AND valence_coverage >= 0.70""")
O.part("ext_days", ("ext_base",), _EXTREME_SQL)


def _extreme(spark, sf):
    d = P.analysis_daily(spark, sf).select("date", "valence_coverage", "main_avg_valence_metric",
                                           "main_sad_share_metric", "prcp", "tsun")
    return W.extreme_groups(d, "main_avg_valence_metric", "main_sad_share_metric")


@query("weather_classes_extreme", O.build("SELECT * EXCLUDE (q25, q75) FROM ext_days", "ext_days"))
def weather_classes_extreme(spark, sf):
    """Coverage filter and the two extreme day groups."""
    return _extreme(spark, sf)


O.part("ext_groups", ("ext_days",), """
  SELECT extreme_group, count(*) AS aantal_dagen, avg(main_avg_valence_metric) AS gemiddelde_valence,
         avg(main_sad_share_metric) AS gemiddelde_sad_share, avg(prcp) AS gemiddelde_prcp, avg(tsun) AS gemiddelde_tsun
  FROM ext_days WHERE extreme_group IS NOT NULL GROUP BY extreme_group""")


@query("extreme_summary", O.build("""
SELECT *, CASE WHEN count(*) OVER () = 2 THEN 2 * gemiddelde_valence - sum(gemiddelde_valence) OVER () END AS verschil_valence,
       CASE WHEN count(*) OVER () = 2 THEN 2 * gemiddelde_sad_share - sum(gemiddelde_sad_share) OVER () END AS verschil_sad_share
FROM ext_groups""", "ext_groups"))
def extreme_summary(spark, sf):
    """Extreme-group averages and the signed difference to the other
    group (own mean minus the other; the window spans the <= 2 group rows)."""
    e = W.compared(cut_lineage(_extreme(spark, sf)))
    g = e.groupBy("extreme_group").agg(
        F.count(F.lit(1)).alias("aantal_dagen"), F.avg("main_avg_valence_metric").alias("gemiddelde_valence"),
        F.avg("main_sad_share_metric").alias("gemiddelde_sad_share"),
        F.avg("prcp").alias("gemiddelde_prcp"), F.avg("tsun").alias("gemiddelde_tsun"))
    allg = Window.partitionBy()
    two = F.count(F.lit(1)).over(allg) == 2

    def diff(c):
        return F.when(two, 2 * F.col(c) - F.sum(c).over(allg))

    return g.select("*", diff("gemiddelde_valence").alias("verschil_valence"),
                    diff("gemiddelde_sad_share").alias("verschil_sad_share"))


# -- X16: the branches that the fixture's days do not reach -----------------------
O.benchmark("relaxed", "final_daily", 10 ** 6)


@query("weather_benchmark_relaxed", O.build("SELECT * FROM relaxed", "relaxed"))
def weather_benchmark_relaxed(spark, sf):
    """X16 relaxed: more days asked for than the strict rule finds."""
    return W.weather_benchmark(P.final_daily(spark, sf), 10 ** 6)


O.part("sunless", ("final_daily",), "SELECT * REPLACE (CAST(NULL AS DOUBLE) AS tsun) FROM final_daily")
O.benchmark("rain_only", "sunless")


@query("weather_benchmark_rain_only", O.build("SELECT * FROM rain_only", "rain_only"))
def weather_benchmark_rain_only(spark, sf):
    """X16 fallback: no sunshine numbers, rain alone decides."""
    return W.weather_benchmark(P.final_daily(spark, sf).withColumn("tsun", F.lit(None).cast("double")))


@query("weather_flags_light_rain", O.build("""
SELECT date, prcp, tsun, prcp > 0 AS rainy_day, prcp > 5.0 AS heavy_rain, prcp <= 0.2 AS dry_day FROM weather_cal""", "weather_cal"))
def weather_flags_light_rain(spark, sf):
    """Tri-state flags, heavy rain above 5 mm, dry up to 0.2 mm."""
    return W.weather_types(P.weather_calendar(spark, sf), heavy_inclusive=False, dry_rule="le02", unknown_as_false=False).select(
        "date", "prcp", "tsun", "rainy_day", "heavy_rain", "dry_day")
