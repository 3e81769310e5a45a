"""E3 analysis queries on the day grain (T1-T10, T15-T20, G13, G14, G23, G26, P10, WN1, T3, T4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reshape as R
from ..operators import stattests as S
from ..operators.weather import BAD_WEATHER_LABEL as BAD, GOOD_WEATHER_LABEL as GOOD
from . import pipelines as P
from .catalog import O, query

# Metric labels of the reference's reports.
MAIN_METRICS = (("main_avg_valence_metric", "Gemiddelde valence Top 200"),
                ("main_sad_share_metric", "Aandeel sad songs/sad streams"))
WEATHER_VARS = ("prcp", "tsun")
DAILY_FEATURES = (("valence", "weighted_avg_valence"), ("energy", "weighted_avg_energy"),
                  ("danceability", "weighted_avg_danceability"), ("speechiness", "weighted_avg_speechiness"),
                  ("tempo", "weighted_avg_tempo"), ("acousticness", "weighted_avg_acousticness"),
                  ("instrumentalness", "weighted_avg_instrumentalness"), ("liveness", "weighted_avg_liveness"),
                  ("loudness", "weighted_avg_loudness"))
BOX_METRICS = (("Gemiddelde valence Top 200", "main_avg_valence_metric"),
               ("Aandeel sad songs/sad streams", "main_sad_share_metric"),
               ("Energy", "weighted_avg_energy"), ("Danceability", "weighted_avg_danceability"),
               ("Speechiness", "weighted_avg_speechiness"), ("Aandeel lage energy", "weighted_share_low_energy"),
               ("Aandeel depressieve songs", "weighted_share_depressive"))
EARLY_PAIRS = (("share_sad_streams", "prcp"), ("share_sad_streams", "tsun"),
               ("share_sad_songs", "prcp"), ("share_sad_songs", "tsun"),
               ("weighted_avg_valence", "prcp"), ("weighted_avg_valence", "tsun"),
               ("sad_streams", "prcp"), ("sad_streams", "tsun"))
MATRIX_COLS = ("main_avg_valence_metric", "main_sad_share_metric", "prcp", "tsun")

def _union(selects: list[str]) -> str:
    return "\nUNION ALL\n".join(selects)


# -- T3: fixed pairs on the early dataset ----------------------------------
O.part("pairs_long", ("early_final",), _union([
    f"SELECT '{a}' AS left_column, '{b}' AS right_column, CAST({a} AS DOUBLE) AS x, CAST({b} AS DOUBLE) AS y FROM early_final"
    for a, b in EARLY_PAIRS]))
O.corr_tests("pairs_ct", "pairs_long", ["left_column", "right_column"], "x", "y", min_n=2)


@query("corr_pairs", O.build("""
SELECT left_column, right_column, n AS row_count, pearson_r AS pearson_correlation FROM pairs_ct""", "pairs_ct"))
def corr_pairs(spark, sf):
    """Pearson r for 8 fixed (metric, weather) pairs in one grouped pass."""
    f = P.early_final(spark, sf)
    long = R.long_of(f, [], [{"left_column": a, "right_column": b, "x": F.col(a).cast("double"),
                              "y": F.col(b).cast("double")} for a, b in EARLY_PAIRS])
    t = S.correlation_tests(long, ["left_column", "right_column"], "x", "y", min_n=2)
    return t.select("left_column", "right_column", F.col("n").alias("row_count"),
                    F.col("pearson_r").alias("pearson_correlation"))


# -- T4: correlation matrix on the cleaned extreme base --------------------
O.part("matrix_long", ("ext_base",), _union([
    f"SELECT '{a}' AS row_var, '{b}' AS col_var, CAST({a} AS DOUBLE) AS x, CAST({b} AS DOUBLE) AS y FROM ext_base"
    for a in MATRIX_COLS for b in MATRIX_COLS]))
O.corr_tests("matrix_ct", "matrix_long", ["row_var", "col_var"], "x", "y", min_n=2)


@query("corr_matrix", O.build("SELECT row_var, col_var, n, pearson_r FROM matrix_ct", "matrix_ct"))
def corr_matrix(spark, sf):
    """T4: pairwise-complete Pearson matrix (long form) of the cleaned days."""
    d = P.analysis_daily(spark, sf).where(
        F.col("valence_coverage").isNotNull() & F.col("main_avg_valence_metric").isNotNull()
        & F.col("main_sad_share_metric").isNotNull() & F.col("prcp").isNotNull() & F.col("tsun").isNotNull()
        & (F.col("valence_coverage") >= 0.70))
    long = R.long_of(d, [], [{"row_var": a, "col_var": b, "x": F.col(a).cast("double"), "y": F.col(b).cast("double")}
                             for a in MATRIX_COLS for b in MATRIX_COLS])
    return S.correlation_tests(long, ["row_var", "col_var"], "x", "y", min_n=2).select("row_var", "col_var", "n", "pearson_r")


# -- T1 T2 T18: main metrics vs weather ------------------------------------
O.part("main_corr_long", ("analysis_daily",), _union([
    f"SELECT '{m}' AS metric, '{lab}' AS metric_label, '{w}' AS weather_var, CAST({w} AS DOUBLE) AS x, "
    f"CAST({m} AS DOUBLE) AS y FROM analysis_daily" for m, lab in MAIN_METRICS for w in WEATHER_VARS]))
O.corr_tests("main_ct", "main_corr_long", ["metric", "metric_label", "weather_var"], "x", "y", min_n=10)


def _main_corr_long(spark, sf):
    d = P.analysis_daily(spark, sf)
    return R.long_of(d, [], [{"metric": m, "metric_label": lab, "weather_var": w, "x": F.col(w).cast("double"),
                              "y": F.col(m).cast("double")} for m, lab in MAIN_METRICS for w in WEATHER_VARS])


@query("corr_tests_main", O.build(f"""
SELECT *, {O.conclusion_sql('pearson_p')} AS pearson_conclusion_005,
       {O.conclusion_sql('spearman_p')} AS spearman_conclusion_005 FROM main_ct""", "main_ct"))
def corr_tests_main(spark, sf):
    """Pearson/Spearman of the main metrics with prcp and tsun."""
    t = S.correlation_tests(_main_corr_long(spark, sf), ["metric", "metric_label", "weather_var"], "x", "y", min_n=10)
    return t.select("*", S.conclusion(F.col("pearson_p")).alias("pearson_conclusion_005"),
                    S.conclusion(F.col("spearman_p")).alias("spearman_conclusion_005"))


# -- T5-T7 T19: main metrics, bad vs good weather --------------------------
O.part("main_grp_long", ("analysis_daily",), _union([
    f"SELECT '{m}' AS metric, '{lab}' AS metric_label, good_bad_weather_type AS g, CAST({m} AS DOUBLE) AS v FROM analysis_daily"
    for m, lab in MAIN_METRICS]))
O.two_group("main_tg", "main_grp_long", ["metric", "metric_label"], "g", "v", BAD, GOOD)


@query("two_group_tests", O.build(f"""
SELECT *, metric AS value, {O.conclusion_sql('welch_p')} AS welch_conclusion_005,
       {O.conclusion_sql('mannwhitney_p')} AS mannwhitney_conclusion_005 FROM main_tg""", "main_tg"))
def two_group_tests(spark, sf):
    """Welch, Mann-Whitney and Cohen's d, bad vs good weather days."""
    d = P.analysis_daily(spark, sf)
    long = R.long_of(d, [], [{"metric": m, "metric_label": lab, "g": F.col("good_bad_weather_type"),
                              "v": F.col(m).cast("double")} for m, lab in MAIN_METRICS])
    t = S.two_group_tests(long, ["metric", "metric_label"], "g", "v", BAD, GOOD)
    return t.select("*", F.col("metric").alias("value"),
                    S.conclusion(F.col("welch_p")).alias("welch_conclusion_005"),
                    S.conclusion(F.col("mannwhitney_p")).alias("mannwhitney_conclusion_005"))


# -- G13: per metric x weather group summary -------------------------------
@query("group_metric_summary", O.build(_union([f"""
SELECT good_bad_weather_type, count(date) AS n_days, avg({m}) AS mean_value, median({m}) AS median_value,
       stddev_samp({m}) AS sd_value, avg(prcp) AS mean_prcp, avg(tsun) AS mean_tsun,
       '{m}' AS metric, '{lab}' AS metric_label
FROM analysis_daily WHERE good_bad_weather_type IS NOT NULL GROUP BY good_bad_weather_type""" for m, lab in MAIN_METRICS]),
    "analysis_daily"))
def group_metric_summary(spark, sf):
    """N, mean, median, sd of each main metric and mean weather per day class."""
    d = P.analysis_daily(spark, sf).where(F.col("good_bad_weather_type").isNotNull())
    long = R.long_of(d, ["date", "good_bad_weather_type", "prcp", "tsun"],
                     [{"metric": m, "metric_label": lab, "v": F.col(m).cast("double")} for m, lab in MAIN_METRICS])
    return long.groupBy("good_bad_weather_type", "metric", "metric_label").agg(
        F.count("date").alias("n_days"), F.avg("v").alias("mean_value"), F.median("v").alias("median_value"),
        F.stddev_samp("v").alias("sd_value"), F.avg("prcp").alias("mean_prcp"), F.avg("tsun").alias("mean_tsun"))


# -- G14 / T20: seasons ----------------------------------------------------
@query("season_summary", O.build("""
SELECT season, count(date) AS n_days,
       avg(main_sad_share_metric) AS mean_sad_share, median(main_sad_share_metric) AS median_sad_share,
       stddev_samp(main_sad_share_metric) AS sd_sad_share,
       avg(main_avg_valence_metric) AS mean_avg_valence, median(main_avg_valence_metric) AS median_avg_valence,
       stddev_samp(main_avg_valence_metric) AS sd_avg_valence,
       avg(prcp) AS mean_prcp, avg(tsun) AS mean_tsun, min(season_order) AS season_order
FROM analysis_daily WHERE season IS NOT NULL GROUP BY season""", "analysis_daily"))
def season_summary(spark, sf):
    """Season summary of the two main metrics and the weather."""
    d = P.analysis_daily(spark, sf).where(F.col("season").isNotNull())
    s, v = "main_sad_share_metric", "main_avg_valence_metric"
    return d.groupBy("season").agg(
        F.count("date").alias("n_days"), F.avg(s).alias("mean_sad_share"), F.median(s).alias("median_sad_share"),
        F.stddev_samp(s).alias("sd_sad_share"), F.avg(v).alias("mean_avg_valence"),
        F.median(v).alias("median_avg_valence"), F.stddev_samp(v).alias("sd_avg_valence"),
        F.avg("prcp").alias("mean_prcp"), F.avg("tsun").alias("mean_tsun"), F.min("season_order").alias("season_order"))


O.part("season_long", ("analysis_daily",), _union([
    f"SELECT '{m}' AS metric, '{lab}' AS metric_label, season, CAST({m} AS DOUBLE) AS v FROM analysis_daily"
    for m, lab in (MAIN_METRICS[1], MAIN_METRICS[0])]))
O.anova("season_av", "season_long", ["metric", "metric_label"], "season", "v")


@query("season_tests", O.build(f"""
SELECT *, 'season' AS group_col, {O.conclusion_sql('anova_p')} AS anova_conclusion_005,
       {O.conclusion_sql('kruskal_p')} AS kruskal_conclusion_005 FROM season_av""", "season_av"))
def season_tests(spark, sf):
    """One-way ANOVA and Kruskal-Wallis across seasons."""
    d = P.analysis_daily(spark, sf)
    long = R.long_of(d, [], [{"metric": m, "metric_label": lab, "season": F.col("season"), "v": F.col(m).cast("double")}
                             for m, lab in (MAIN_METRICS[1], MAIN_METRICS[0])])
    t = S.anova_kruskal(long, ["metric", "metric_label"], "season", "v")
    return t.select("*", F.lit("season").alias("group_col"),
                    S.conclusion(F.col("anova_p")).alias("anova_conclusion_005"),
                    S.conclusion(F.col("kruskal_p")).alias("kruskal_conclusion_005"))


# -- T15 G23: audio features vs weather, BH over all pairs ------------------
O.part("feat_long", ("analysis_daily",), _union([
    f"SELECT '{f}' AS feature, '{c}' AS feature_col, '{w}' AS weather_var, CAST({w} AS DOUBLE) AS x, "
    f"CAST({c} AS DOUBLE) AS y FROM analysis_daily" for f, c in DAILY_FEATURES for w in WEATHER_VARS]))
O.corr_tests("feat_ct", "feat_long", ["feature", "feature_col", "weather_var"], "x", "y", min_n=10)
O.bh("feat_bh", "feat_ct", [], [("pearson_p", "pearson_p_adj_bh"), ("spearman_p", "spearman_p_adj_bh")])
O.part("feat_corr", ("feat_bh",), f"""
SELECT *, {O.conclusion_sql('pearson_p', 'pearson_p_adj_bh')} AS pearson_conclusion_005,
       {O.conclusion_sql('spearman_p', 'spearman_p_adj_bh')} AS spearman_conclusion_005,
       {O.conclusion_sql('pearson_p', 'pearson_p_adj_bh')} = 'SIGNIFICANT' AS significant_pearson_005,
       {O.conclusion_sql('spearman_p', 'spearman_p_adj_bh')} = 'SIGNIFICANT' AS significant_spearman_005
FROM feat_bh""")


def feature_corr(spark, sf, features=DAILY_FEATURES):
    d = P.analysis_daily(spark, sf)
    long = R.long_of(d, [], [{"feature": f, "feature_col": c, "weather_var": w, "x": F.col(w).cast("double"),
                              "y": F.col(c).cast("double")} for f, c in features for w in WEATHER_VARS])
    t = S.correlation_tests(long, ["feature", "feature_col", "weather_var"], "x", "y", min_n=10)
    t = S.bh_adjust_all(t, [], {"pearson_p": "pearson_p_adj_bh", "spearman_p": "spearman_p_adj_bh"})
    pc = S.conclusion(F.col("pearson_p"), F.col("pearson_p_adj_bh"))
    sc = S.conclusion(F.col("spearman_p"), F.col("spearman_p_adj_bh"))
    return t.select("*", pc.alias("pearson_conclusion_005"), sc.alias("spearman_conclusion_005"),
                    (pc == S.SIGNIFICANT).alias("significant_pearson_005"),
                    (sc == S.SIGNIFICANT).alias("significant_spearman_005"))


@query("corr_tests_features", O.build("SELECT * FROM feat_corr", "feat_corr"))
def corr_tests_features(spark, sf):
    """Daily audio features vs prcp/tsun, BH over all pairs."""
    return feature_corr(spark, sf)


@query("feature_strength", O.build("""
SELECT feature, max(greatest(abs(pearson_r), abs(spearman_rho))) AS max_abs_corr_weather
FROM feat_corr GROUP BY feature""", "feat_corr"))
def feature_strength(spark, sf):
    """Strongest absolute correlation of each feature with the weather."""
    t = feature_corr(spark, sf)
    return t.groupBy("feature").agg(
        F.max(F.greatest(F.abs("pearson_r"), F.abs("spearman_rho"))).alias("max_abs_corr_weather"))


# -- T16: feature good/bad tests, BH over features --------------------------
O.part("featg_long", ("analysis_daily",), _union([
    f"SELECT '{f}' AS feature, '{c}' AS feature_col, good_bad_weather_type AS g, CAST({c} AS DOUBLE) AS v FROM analysis_daily"
    for f, c in DAILY_FEATURES]))
O.two_group("featg_tg", "featg_long", ["feature", "feature_col"], "g", "v", BAD, GOOD)
O.bh("featg_bh", "featg_tg", [], [("welch_p", "welch_p_adj_bh"), ("mannwhitney_p", "mannwhitney_p_adj_bh")])


@query("feature_group_tests", O.build(f"""
SELECT *, {O.conclusion_sql('welch_p', 'welch_p_adj_bh')} AS welch_conclusion_005,
       {O.conclusion_sql('mannwhitney_p', 'mannwhitney_p_adj_bh')} AS mannwhitney_conclusion_005,
       {O.conclusion_sql('welch_p', 'welch_p_adj_bh')} = 'SIGNIFICANT' AS significant_welch_005
FROM featg_bh""", "featg_bh"))
def feature_group_tests(spark, sf):
    """Features bad vs good weather, BH over features per test."""
    d = P.analysis_daily(spark, sf)
    long = R.long_of(d, [], [{"feature": f, "feature_col": c, "g": F.col("good_bad_weather_type"),
                              "v": F.col(c).cast("double")} for f, c in DAILY_FEATURES])
    t = S.two_group_tests(long, ["feature", "feature_col"], "g", "v", BAD, GOOD)
    t = S.bh_adjust_all(t, [], {"welch_p": "welch_p_adj_bh", "mannwhitney_p": "mannwhitney_p_adj_bh"})
    wc = S.conclusion(F.col("welch_p"), F.col("welch_p_adj_bh"))
    return t.select("*", wc.alias("welch_conclusion_005"),
                    S.conclusion(F.col("mannwhitney_p"), F.col("mannwhitney_p_adj_bh")).alias("mannwhitney_conclusion_005"),
                    (wc == S.SIGNIFICANT).alias("significant_welch_005"))


# -- P10 T17 G26: headline metrics long data, tests and box summary ---------
O.part("box_long", ("analysis_daily",), _union([
    f"SELECT strftime(date, '%Y-%m-%d') AS date, good_bad_weather_type, '{lab}' AS metric_label, '{c}' AS metric_col, "
    f"CAST({c} AS DOUBLE) AS value, prcp, tsun FROM analysis_daily "
    f"WHERE {c} IS NOT NULL AND good_bad_weather_type IS NOT NULL" for lab, c in BOX_METRICS]))


def box_long(spark, sf):
    d = P.analysis_daily(spark, sf).where(F.col("good_bad_weather_type").isNotNull())
    long = R.long_of(d, ["date", "good_bad_weather_type", "prcp", "tsun"],
                     [{"metric_label": lab, "metric_col": c, "value": F.col(c).cast("double")} for lab, c in BOX_METRICS])
    return long.where(F.col("value").isNotNull()).select(
        F.date_format("date", "yyyy-MM-dd").alias("date"), "good_bad_weather_type", "metric_label", "metric_col",
        "value", "prcp", "tsun")


@query("metric_long", O.build("SELECT * FROM box_long", "box_long"))
def metric_long(spark, sf):
    """Day x headline metric long table (labelled days, values present)."""
    return box_long(spark, sf)


O.two_group("box_tg", "box_long", ["metric_label", "metric_col"], "good_bad_weather_type", "value", BAD, GOOD)


@query("boxplot_tests", O.build(f"""
SELECT *, {O.conclusion_sql('welch_p')} AS welch_conclusion_005,
       {O.conclusion_sql('mannwhitney_p')} AS mannwhitney_conclusion_005 FROM box_tg""", "box_tg"))
def boxplot_tests(spark, sf):
    """Welch / Mann-Whitney per headline metric, bad vs good weather."""
    t = S.two_group_tests(box_long(spark, sf), ["metric_label", "metric_col"], "good_bad_weather_type", "value", BAD, GOOD)
    return t.select("*", S.conclusion(F.col("welch_p")).alias("welch_conclusion_005"),
                    S.conclusion(F.col("mannwhitney_p")).alias("mannwhitney_conclusion_005"))


O.part("box_q", ("box_long",), """
SELECT metric_label, metric_col, good_bad_weather_type, count(value) AS n, min(value) AS min_value,
       max(value) AS max_value, avg(value) AS mean_value, quantile_cont(value, 0.25) AS q1,
       quantile_cont(value, 0.5) AS median_value, quantile_cont(value, 0.75) AS q3
FROM box_long GROUP BY metric_label, metric_col, good_bad_weather_type""")


@query("box_summary", O.build("""
SELECT q.*, min(l.value) FILTER (WHERE l.value >= q.q1 - 1.5 * (q.q3 - q.q1)) AS whisker_low,
       max(l.value) FILTER (WHERE l.value <= q.q3 + 1.5 * (q.q3 - q.q1)) AS whisker_high
FROM box_q q JOIN box_long l USING (metric_label, metric_col, good_bad_weather_type)
GROUP BY ALL""", "box_q"))
def box_summary(spark, sf):
    """Five-number summary with whiskers per headline metric x day class."""
    return R.box_summary(box_long(spark, sf), ["metric_label", "metric_col", "good_bad_weather_type"], "value")


# -- WN1: trailing 14-row mean of the main metrics --------------------------
@query("rolling_14", O.build(_union([f"""
SELECT date, '{m}' AS metric, CAST({m} AS DOUBLE) AS value,
       CASE WHEN count({m}) OVER w >= 4 THEN avg({m}) OVER w END AS rolling_14
FROM analysis_daily WHERE {m} IS NOT NULL
WINDOW w AS (ORDER BY date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)""" for m, _ in MAIN_METRICS]), "analysis_daily"))
def rolling_14(spark, sf):
    """WN1: trailing 14-row mean (>= 4 values) per main metric day series."""
    d = P.analysis_daily(spark, sf)
    long = R.long_of(d, ["date"], [{"metric": m, "value": F.col(m).cast("double")} for m, _ in MAIN_METRICS])
    return R.trailing_mean(long, ["metric"], "date", "value")


# -- v3: rain / dry split without a neutral class (X12b X13 T5-T7) -----------
from ..operators import weather as W  # noqa: E402
from ..operators.weather import DRY_LABEL as DRY, RAIN_LABEL as RAIN  # noqa: E402

O.part("rd_stats", ("analysis_daily",), """
SELECT avg(prcp) AS mp, stddev_samp(prcp) AS sp, avg(tsun) AS mt, stddev_samp(tsun) AS st FROM analysis_daily""")


@query("weather_classes_rain_dry", O.build(f"""
SELECT date, prcp, tsun, coalesce(prcp > 0, false) AS rainy_day, coalesce(prcp = 0, false) AS dry_day,
       CASE WHEN coalesce(prcp > 0, false) THEN 'Regenachtig' ELSE 'Droog' END AS rain_dry_type,
       {O.round_abs_sql(O.zsql('tsun', 'mt', 'st') + ' - ' + O.zsql('prcp', 'mp', 'sp'))} AS weather_score_sunny,
       {O.round_abs_sql(O.zsql('prcp', 'mp', 'sp') + ' - ' + O.zsql('tsun', 'mt', 'st'))} AS weather_score_rainy
FROM analysis_daily, rd_stats""", "analysis_daily", "rd_stats"))
def weather_classes_rain_dry(spark, sf):
    """Rainy / dry day split of the final daily table (v3 definition)."""
    d = P.analysis_daily(spark, sf).select("date", "prcp", "tsun")
    return W.rain_dry_classes(d)


O.part("rd_long", ("analysis_daily",), _union([
    f"SELECT '{m}' AS metric, '{lab}' AS metric_label, CASE WHEN coalesce(prcp > 0, false) THEN 'Regenachtig' ELSE 'Droog' END AS g, "
    f"CAST({m} AS DOUBLE) AS v FROM analysis_daily" for m, lab in MAIN_METRICS]))
O.two_group("rd_tg", "rd_long", ["metric", "metric_label"], "g", "v", RAIN, DRY)


@query("rain_dry_tests", O.build(f"""
SELECT *, {O.conclusion_sql('welch_p')} AS welch_conclusion_005,
       {O.conclusion_sql('mannwhitney_p')} AS mannwhitney_conclusion_005 FROM rd_tg""", "rd_tg"))
def rain_dry_tests(spark, sf):
    """T5 T6 T7 (v3): main metrics on rainy vs dry days."""
    d = W.rain_dry_classes(P.analysis_daily(spark, sf).select("date", "prcp", "tsun", *[m for m, _ in MAIN_METRICS]))
    long = R.long_of(d, [], [{"metric": m, "metric_label": lab, "g": F.col("rain_dry_type"),
                              "v": F.col(m).cast("double")} for m, lab in MAIN_METRICS])
    t = S.two_group_tests(long, ["metric", "metric_label"], "g", "v", RAIN, DRY)
    return t.select("*", S.conclusion(F.col("welch_p")).alias("welch_conclusion_005"),
                    S.conclusion(F.col("mannwhitney_p")).alias("mannwhitney_conclusion_005"))
