"""Profiles, significance ledger and the keyed cache."""

from __future__ import annotations

import functools
import hashlib

from pyspark.sql import functions as F

from ..operators import daily as D
from ..operators import profile as PR
from ..operators import stattests as S
from ..operators.weather import BAD_WEATHER_LABEL as BAD, GOOD_WEATHER_LABEL as GOOD
from ..session import ensure_checkpoint_dir, fingerprint, materialize_once, remove_at_exit
from ..sources import fixtures as X
from ..sources.cache import DailyCache
from . import pipelines as P
from . import q_analysis as QA
from . import q_entity as QE
from . import q_match as QM
from .catalog import O, query


@query("quality_table", O.build("""
SELECT 'chart_rows_after_filter' AS metric, CAST(count(*) AS DOUBLE) AS value, NULL::VARCHAR AS label FROM song_day
UNION ALL SELECT 'unique_days', CAST(count(DISTINCT date) AS DOUBLE), NULL FROM song_day
UNION ALL SELECT 'rows_with_valence', CAST(count(valence) AS DOUBLE), NULL FROM song_day
UNION ALL SELECT 'valence_match_rate', count(valence) / count(*), NULL FROM song_day
UNION ALL SELECT 'weight_source', NULL, CASE WHEN has_streams THEN 'streams' ELSE 'rank_weight' END FROM sd_hs
UNION ALL SELECT 'sad_threshold', 0.40, NULL
UNION ALL SELECT 'low_energy_threshold', 0.50, NULL""", "song_day", "sd_hs"))
def quality_table(spark, sf):
    """Data-quality key/value table of the song rows."""
    s = P.songs(spark, sf)
    row = s.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("date").alias("days"), F.count("valence").alias("nv"),
                (F.sum(F.coalesce(F.col("streams"), F.lit(0.0))) > 0).alias("hs"))
    return PR.key_values(row, [
        ("chart_rows_after_filter", F.col("n"), None), ("unique_days", F.col("days"), None),
        ("rows_with_valence", F.col("nv"), None), ("valence_match_rate", F.col("nv") / F.col("n"), None),
        ("weight_source", None, F.when(F.coalesce(F.col("hs"), F.lit(False)), "streams").otherwise("rank_weight")),
        ("sad_threshold", F.lit(D.SAD_THRESHOLD), None), ("low_energy_threshold", F.lit(D.LOW_ENERGY_THRESHOLD), None)])


WEATHER_TYPED_COLS = ("date", "prcp", "tsun", "rainy_day", "heavy_rain", "dry_day", "rain_dry_type",
                      "weather_score_sunny", "weather_score_dreary", "strict_weather_type", "weather_type_key")


@query("null_profile", O.build("\nUNION ALL\n".join(
    f"SELECT '{c}' AS column, count(*) FILTER (WHERE {c} IS NULL) AS null_count, count({c}) AS non_null_count FROM weather_typed"
    for c in WEATHER_TYPED_COLS), "weather_typed"))
def null_profile(spark, sf):
    """Null counts per column of the classified weather calendar."""
    return PR.null_profile(P.weather_typed(spark, sf), list(WEATHER_TYPED_COLS))


@query("value_counts", O.build("""
SELECT strict_weather_type, count(*) AS n FROM weather_typed GROUP BY strict_weather_type""", "weather_typed"))
def value_counts(spark, sf):
    """Strict weather type distribution (NULL kept)."""
    return PR.value_counts(P.weather_typed(spark, sf), "strict_weather_type")


@query("describe_profile", O.build("\nUNION ALL\n".join(f"""
SELECT '{c}' AS column, count({c}) AS n_values, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min,
       quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS median, quantile_cont({c}, 0.75) AS q75, max({c}) AS max
FROM song_day""" for c in ("streams", "valence", "energy", "rank")), "song_day"))
def describe_profile(spark, sf):
    """describe() of the song-row numbers in one grouped pass."""
    return PR.describe(P.songs(spark, sf), ["streams", "valence", "energy", "rank"])


@query("off_size_days", O.build("""
SELECT date, count(*) AS rows FROM chart_f GROUP BY date HAVING count(*) <> 200""", "chart_f"))
def off_size_days(spark, sf):
    """Days of the filtered chart whose row count is not 200."""
    return PR.off_size_days(QM.charts_filtered(spark, sf))


@query("dataset_profile", O.build("""
SELECT count(*) AS rows, count(DISTINCT date) AS days, min(date) AS first_date, max(date) AS last_date,
       count(DISTINCT track_genre) AS genres, count(valence) AS rows_with_valence FROM cascade""", "cascade"))
def dataset_profile(spark, sf):
    """Rows, distinct days, date range, distinct genres of the matched song rows."""
    c = QM.cascade(spark, sf)
    return c.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("date").alias("days"),
                 F.min("date").alias("first_date"), F.max("date").alias("last_date"),
                 F.countDistinct("track_genre").alias("genres"), F.count("valence").alias("rows_with_valence"))


# -- T21 G24: significance ledger ------------------------------------------
# Names of the analyses and of their tests.
ANALYSES = {
    "main": "01_main_valence_and_sad_share_vs_weather", "season": "02_seasons_vs_valence",
    "genre": "03_genre_vs_weather_prcp_tsun", "artist": "04_artists_vs_weather_prcp_tsun",
    "audio": "05_06_07_audiofeatures_vs_weather_prcp_tsun", "box": "08_good_vs_bad_weather_boxplots",
}
CORRELATIONS = (("Pearson correlation", "pearson_r", "pearson_p"), ("Spearman correlation", "spearman_rho", "spearman_p"))
TWO_GROUPS = (("Welch t-test", "welch_t", "welch_p"), ("Mann-Whitney U", "mannwhitney_u", "mannwhitney_p"))
SEASONS = (("One-way ANOVA", "anova_f", "anova_p"), ("Kruskal-Wallis", "kruskal_h", "kruskal_p"))
CORRECTED = " + BH correction"


def _ledger_sql() -> str:
    """A select for each (source, test); the Spark side emits all tests of a
    source from one pass."""
    sources = [  # analysis, table, variable, comparison, n, tests, corrected
        ("main", "main_ct", "metric_label", "metric_label || ' vs ' || weather_var", "n", CORRELATIONS, False),
        ("main", "main_tg", "metric_label", f"'{BAD} vs {GOOD}'", "n_a + n_b", TWO_GROUPS, False),
        ("season", "season_av", "metric_label", "'season groups'", "n_total", SEASONS, False),
        ("genre", "ent_corr_track_genre", "track_genre", "'entity_share vs ' || weather_var", "n_days", CORRELATIONS, True),
        ("artist", "ent_corr_artist_first", "artist_first", "'entity_share vs ' || weather_var", "n_days", CORRELATIONS, True),
        ("audio", "feat_corr", "feature", "feature || ' vs ' || weather_var", "n", CORRELATIONS, True),
        ("audio", "featg_bh", "feature", f"'{BAD} vs {GOOD}'", "n_a + n_b", TWO_GROUPS[:1], True),
        ("box", "box_tg", "metric_label", f"'{BAD} vs {GOOD}'", "n_a + n_b", TWO_GROUPS[:1], False)]
    return "\nUNION ALL\n".join(
        f"SELECT '{ANALYSES[a]}' AS analysis, '{test}{CORRECTED if bh else ''}' AS test, {variable} AS variable, {comparison} AS comparison, "
        f"{n} AS n, {stat} AS statistic, {p} AS p_value, {f'{p}_adj_bh' if bh else 'NULL::DOUBLE'} AS p_adjusted FROM {src}"
        for a, src, variable, comparison, n, tests, bh in sources for test, stat, p in tests)


O.part("ledger_raw", ("main_ct", "main_tg", "season_av", "ent_corr_track_genre", "ent_corr_artist_first",
                      "feat_corr", "featg_bh", "box_tg"), _ledger_sql())
O.part("ledger", ("ledger_raw",), f"""
SELECT analysis, test, variable, comparison, CAST(n AS BIGINT) AS n, CAST(statistic AS DOUBLE) AS statistic,
       p_value, p_adjusted, CAST(0.05 AS DOUBLE) AS alpha,
       {O.conclusion_sql('p_value', 'p_adjusted')} = 'SIGNIFICANT' AS significant_005,
       {O.conclusion_sql('p_value', 'p_adjusted')} AS conclusion_005
FROM ledger_raw""")


def ledger(spark, sf):
    """The ledger, stored once per application (one row per test): its reports
    do not run the tests again."""
    return materialize_once(spark, ("ledger", sf), lambda: _ledger(spark, sf), P.source_files(sf))


def _ledger(spark, sf):
    """Eight frames, each built once; all its tests leave it in one pass."""
    def rows(df, analysis, variable, comparison, n, tests, corrected=False):
        entry = lambda test, stat, p: F.struct(
            F.lit(ANALYSES[analysis]).alias("analysis"), F.lit(test + (CORRECTED if corrected else "")).alias("test"),
            F.col(variable).cast("string").alias("variable"), comparison.alias("comparison"), n.cast("long").alias("n"),
            F.col(stat).cast("double").alias("statistic"), F.col(p).alias("p_value"),
            (F.col(f"{p}_adj_bh") if corrected else F.lit(None).cast("double")).alias("p_adjusted"))
        return df.select(F.inline(F.array(*[entry(*t) for t in tests])))

    sides, both = F.lit(f"{BAD} vs {GOOD}"), F.col("n_a") + F.col("n_b")
    against = F.concat(F.lit("entity_share vs "), F.col("weather_var"))
    frames = [
        rows(S.correlation_tests(QA._main_corr_long(spark, sf), ["metric", "metric_label", "weather_var"], "x", "y", min_n=10),
             "main", "metric_label", F.concat_ws(" vs ", "metric_label", "weather_var"), F.col("n"), CORRELATIONS),
        rows(QA.two_group_tests(spark, sf), "main", "metric_label", sides, both, TWO_GROUPS),
        rows(QA.season_tests(spark, sf), "season", "metric_label", F.lit("season groups"), F.col("n_total"), SEASONS),
        rows(QE.entity_corr(spark, sf, "track_genre"), "genre", "track_genre", against, F.col("n_days"), CORRELATIONS, True),
        rows(QE.entity_corr(spark, sf, "artist_first"), "artist", "artist_first", against, F.col("n_days"), CORRELATIONS, True),
        rows(QA.feature_corr(spark, sf), "audio", "feature", F.concat_ws(" vs ", "feature", "weather_var"), F.col("n"), CORRELATIONS, True),
        rows(QA.feature_group_tests(spark, sf), "audio", "feature", sides, both, TWO_GROUPS[:1], True),
        rows(QA.boxplot_tests(spark, sf), "box", "metric_label", sides, both, TWO_GROUPS[:1])]
    out = functools.reduce(lambda a, b: a.unionByName(b), frames)
    c = S.conclusion(F.col("p_value"), F.col("p_adjusted"))
    return out.select("*", F.lit(S.ALPHA).alias("alpha"), (c == S.SIGNIFICANT).alias("significant_005"),
                      c.alias("conclusion_005"))


@query("significance_ledger", O.build("SELECT * FROM ledger", "ledger"))
def significance_ledger(spark, sf):
    """T21 SO1 ST2: every test of the analysis in one table, ordered by
    analysis, adjusted p, raw p (nulls last)."""
    return ledger(spark, sf).orderBy("analysis", F.asc_nulls_last("p_adjusted"), F.asc_nulls_last("p_value"))


@query("significance_counts", O.build("""
SELECT count(*) AS tests, count(*) FILTER (WHERE significant_005) AS significant FROM ledger""", "ledger"))
def significance_counts(spark, sf):
    """Number of tests and of significant results."""
    return ledger(spark, sf).agg(F.count(F.lit(1)).alias("tests"), F.count_if("significant_005").alias("significant"))


# -- S5-S7: keyed daily cache ------------------------------------------------
def _cache(spark, sf) -> DailyCache:
    root = ensure_checkpoint_dir(spark)
    state = repr((spark.sparkContext.applicationId, fingerprint(spark, *P.source_files(sf))))
    path = f"{root.rstrip('/')}/skytune-weather-cache-{hashlib.sha1(state.encode()).hexdigest()[:16]}"
    remove_at_exit(spark, path)
    cache = DailyCache(spark, path)
    readings = P.weather_calendar(spark, sf).where(F.col("prcp").isNotNull() | F.col("tsun").isNotNull())
    cache.append(readings)
    return cache


O.part("cache_rows", ("weather_cal",), "SELECT * FROM weather_cal WHERE prcp IS NOT NULL OR tsun IS NOT NULL")


@query("cache_range_read", O.build("""
SELECT * FROM cache_rows WHERE date BETWEEN (SELECT d0 FROM sd_bounds) AND (SELECT d1 FROM sd_bounds)""",
    "cache_rows", "sd_bounds"))
def cache_range_read(spark, sf):
    """Range read from the keyed daily cache over the chart date span."""
    bounds = P.songs(spark, sf).agg(F.min("date").alias("start"), F.max("date").alias("end"))
    return _cache(spark, sf).read_between(bounds)


@query("cache_complete", O.build("""
SELECT count(*) AS rows, datediff('day', d0, d1) AS days, count(*) >= 0.9 * datediff('day', d0, d1) AS complete
FROM cache_rows, sd_bounds WHERE date BETWEEN d0 AND d1 GROUP BY d0, d1""", "cache_rows", "sd_bounds"))
def cache_complete(spark, sf):
    """Is the cache at least 90 % complete over the chart date span."""
    bounds = P.songs(spark, sf).agg(F.min("date").alias("start"), F.max("date").alias("end"))
    return _cache(spark, sf).completeness_between(bounds).select(
        F.col("rows").cast("long"), F.col("days").cast("long"), "complete")


@query("cache_append", O.build("""
SELECT c.* FROM weather_cal c ANTI JOIN cache_rows r ON c.date = r.date""", "weather_cal", "cache_rows"))
def cache_append(spark, sf):
    """Calendar rows the cache does not hold yet (anti join on date)."""
    return _cache(spark, sf).new_rows(P.weather_calendar(spark, sf))
