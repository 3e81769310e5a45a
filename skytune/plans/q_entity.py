"""Entity analyses: genre/artist daily shares and their weather tests
(F8 F9 G16 WN2 T11 T12 ST3) and song-grain feature tests (T13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import entity as EN
from ..operators import reshape as R
from ..operators import stattests as S
from ..functions.nulls import flag
from ..operators.daily import AUDIO_FEATURES, LOW_ENERGY_THRESHOLD, sad_flag
from ..operators.weather import STRICT_RAINY, STRICT_SUNNY
from . import pipelines as P
from ..session import cut_lineage, materialize_once
from .catalog import O, query

WEATHER_VARS = ("prcp", "tsun")
SONG_FEATURES = ("valence", *AUDIO_FEATURES)
DAY_ATTRS = ("prcp", "tsun", "good_bad_weather_type", "selected_weather_benchmark_day", "season", "year", "month")

O.part("sw_base", ("sd_base",), f"""
SELECT date, rank, valence, {', '.join(AUDIO_FEATURES)}, has_streams,
       CASE WHEN has_streams THEN s_nn ELSE streams END AS streams,
       CASE WHEN has_streams THEN s_nn ELSE rw END AS analysis_weight,
       lower(regexp_replace(genre, '^\\s+|\\s+$', '', 'g')) AS track_genre,
       regexp_replace(split_part(lower(artist), ',', 1), '^\\s+|\\s+$', '', 'g') AS artist_first,
       coalesce(rank <= 50, false) AS top_50
FROM sd_base""")

for _e in ("track_genre", "artist_first"):
    O.part(f"ent_day_{_e}", ("sw_base",), f"""
SELECT date, {_e}, sum(analysis_weight) AS entity_weight, count(*) AS entity_tracks FROM sw_base
WHERE date IS NOT NULL AND {_e} IS NOT NULL AND analysis_weight IS NOT NULL
  AND regexp_replace({_e}, '^\\s+|\\s+$', '', 'g') <> '' AND lower({_e}) NOT IN ('nan', 'none', 'unknown')
  AND analysis_weight > 0
GROUP BY date, {_e}""")
    O.part(f"ent_share_{_e}", (f"ent_day_{_e}", "analysis_daily"), f"""
SELECT e.*, t.day_total_weight, e.entity_weight / t.day_total_weight AS entity_share,
       {', '.join('a.' + c for c in DAY_ATTRS)}
FROM ent_day_{_e} e JOIN (SELECT date, sum(entity_weight) AS day_total_weight FROM ent_day_{_e} GROUP BY date) t
  ON e.date = t.date LEFT JOIN analysis_daily a ON e.date = a.date""")
    O.part(f"ent_elig_{_e}", (f"ent_share_{_e}",), f"""
SELECT * FROM ent_share_{_e} WHERE {_e} IN (SELECT {_e} FROM ent_share_{_e} GROUP BY {_e} HAVING count(*) >= 20)""")
    O.part(f"ent_long_{_e}", (f"ent_elig_{_e}",), "\nUNION ALL\n".join(
        f"SELECT {_e}, '{w}' AS weather_var, CAST({w} AS DOUBLE) AS x, entity_share AS y FROM ent_elig_{_e}"
        for w in WEATHER_VARS))
    O.corr_tests(f"ent_ct_{_e}", f"ent_long_{_e}", [_e, "weather_var"], "x", "y", min_n=20)
    O.part(f"ent_ctm_{_e}", (f"ent_ct_{_e}", f"ent_elig_{_e}"), f"""
SELECT c.* EXCLUDE (n), c.n AS n_days, m.mean_entity_share FROM ent_ct_{_e} c
JOIN (SELECT {_e}, avg(entity_share) AS mean_entity_share FROM ent_elig_{_e} GROUP BY {_e}) m ON c.{_e} = m.{_e}""")
    O.bh(f"ent_bh_{_e}", f"ent_ctm_{_e}", ["weather_var"],
         [("pearson_p", "pearson_p_adj_bh"), ("spearman_p", "spearman_p_adj_bh")])
    O.part(f"ent_corr_{_e}", (f"ent_bh_{_e}",), f"""
SELECT *, {O.conclusion_sql('pearson_p', 'pearson_p_adj_bh')} AS pearson_conclusion_005,
       {O.conclusion_sql('spearman_p', 'spearman_p_adj_bh')} AS spearman_conclusion_005,
       {O.conclusion_sql('pearson_p', 'pearson_p_adj_bh')} = 'SIGNIFICANT' AS significant_pearson_005,
       {O.conclusion_sql('spearman_p', 'spearman_p_adj_bh')} = 'SIGNIFICANT' AS significant_spearman_005
FROM ent_bh_{_e}""")


def entity_day(spark, sf, entity):
    """Entity x day table, materialized once per application: five reports
    read it, and it is far smaller than the song rows it is built from."""
    def build():
        days = P.analysis_daily(spark, sf).select("date", *DAY_ATTRS)
        return EN.entity_daily_shares(P.song_level(spark, sf), entity, days)
    return materialize_once(spark, ("entity_day", sf, entity), build, P.source_files(sf))


def entity_corr(spark, sf, entity):
    """Per entity (>= 20 days) and weather variable, Pearson/Spearman of
    the daily share; BH per weather variable."""
    ed = EN.entities_with_days(entity_day(spark, sf, entity), entity)
    long = R.long_of(ed, [entity], [{"weather_var": w, "x": F.col(w).cast("double"), "y": F.col("entity_share")}
                                    for w in WEATHER_VARS])
    t = S.correlation_tests(long, [entity, "weather_var"], "x", "y", min_n=EN.MIN_DAYS_ENTITY)
    mean = ed.groupBy(entity).agg(F.avg("entity_share").alias("mean_entity_share"))
    t = t.withColumnRenamed("n", "n_days").join(mean, entity)
    t = S.bh_adjust_all(t, ["weather_var"], {"pearson_p": "pearson_p_adj_bh", "spearman_p": "spearman_p_adj_bh"})
    pc = S.conclusion(F.col("pearson_p"), F.col("pearson_p_adj_bh"))
    sc = S.conclusion(F.col("spearman_p"), F.col("spearman_p_adj_bh"))
    return t.select("*", pc.alias("pearson_conclusion_005"), sc.alias("spearman_conclusion_005"),
                    (pc == S.SIGNIFICANT).alias("significant_pearson_005"),
                    (sc == S.SIGNIFICANT).alias("significant_spearman_005"))


@query("entity_daily_share", O.build("SELECT * FROM ent_share_track_genre", "ent_share_track_genre"))
def entity_daily_share(spark, sf):
    """F8 G16 WN2: genre share of each day's weight, with day attributes."""
    return entity_day(spark, sf, "track_genre")


@query("entity_daily_share_artist", O.build("SELECT * FROM ent_share_artist_first", "ent_share_artist_first"))
def entity_daily_share_artist(spark, sf):
    """F8 G16 WN2: first-artist share of each day's weight."""
    return entity_day(spark, sf, "artist_first")


@query("entity_corr", O.build("SELECT * FROM ent_corr_track_genre", "ent_corr_track_genre"))
def entity_corr_genre(spark, sf):
    """Genre share vs prcp/tsun, BH per weather variable."""
    return entity_corr(spark, sf, "track_genre")


@query("entity_corr_artist", O.build("SELECT * FROM ent_corr_artist_first", "ent_corr_artist_first"))
def entity_corr_artist(spark, sf):
    """First-artist share vs prcp/tsun, BH per weather variable."""
    return entity_corr(spark, sf, "artist_first")


@query("entity_topk", O.build("""
SELECT track_genre, weather_var, pearson_r, CASE WHEN pearson_r < 0 THEN 'negative' ELSE 'positive' END AS side FROM (
  SELECT *, row_number() OVER (PARTITION BY weather_var ORDER BY pearson_r DESC, track_genre) AS hi,
            row_number() OVER (PARTITION BY weather_var ORDER BY pearson_r ASC, track_genre) AS lo
  FROM ent_corr_track_genre WHERE pearson_r IS NOT NULL) WHERE hi <= 6 OR lo <= 6""", "ent_corr_track_genre"))
def entity_topk(spark, sf):
    """ST3: 6 most positive and 6 most negative genre correlations per weather variable."""
    t = entity_corr(spark, sf, "track_genre")
    return R.top_bottom_k(t, ["weather_var"], "track_genre", "pearson_r", 6).select(
        "track_genre", "weather_var", "pearson_r", "side")


# -- T12: per-entity strict rainy vs strict sunny days ---------------------
O.part("ent_strict", ("ent_elig_track_genre", "final_daily"), """
SELECT e.track_genre, e.entity_share, f.strict_weather_type FROM ent_elig_track_genre e
LEFT JOIN final_daily f ON e.date = f.date""")
O.two_group("ent_tg", "ent_strict", ["track_genre"], "strict_weather_type", "entity_share", STRICT_RAINY, STRICT_SUNNY)
O.bh("ent_tg_bh", "ent_tg", [], [("welch_p", "welch_p_adj_bh")])


@query("entity_group_tests", O.build("""
SELECT *, coalesce(welch_p_adj_bh < 0.05, false) AS significant_welch_005 FROM ent_tg_bh""", "ent_tg_bh"))
def entity_group_tests(spark, sf):
    """Per genre (>= 20 days) Welch/Mann-Whitney of the share on strict
    rainy vs strict sunny days, BH over genres."""
    ed = EN.entities_with_days(entity_day(spark, sf, "track_genre"), "track_genre")
    strict = P.final_daily(spark, sf).select("date", "strict_weather_type")
    ed = ed.join(F.broadcast(strict), "date", "left")
    t = S.two_group_tests(ed, ["track_genre"], "strict_weather_type", "entity_share", STRICT_RAINY, STRICT_SUNNY)
    t = S.bh_adjust(t, [], "welch_p", "welch_p_adj_bh")
    return t.select("*", F.coalesce(F.col("welch_p_adj_bh") < 0.05, F.lit(False)).alias("significant_welch_005"))


# -- T13: song-grain features vs rank / weight / top 50 ---------------------
O.part("fr_long", ("sw_base",), "\nUNION ALL\n".join(
    f"SELECT '{f}' AS feature, CAST({f} AS DOUBLE) AS x, CAST(rank AS DOUBLE) AS r, "
    f"CAST(CASE WHEN has_streams THEN streams ELSE analysis_weight END AS DOUBLE) AS w, "
    f"CAST(top_50 AS VARCHAR) AS top FROM sw_base" for f in SONG_FEATURES))
O.corr_tests("fr_rank", "fr_long", ["feature"], "x", "r", min_n=30)
O.corr_tests("fr_weight", "fr_long", ["feature"], "x", "w", min_n=30)
O.part("fr_top_src", ("fr_long",), "SELECT feature, top, x FROM fr_long")
O.two_group("fr_top", "fr_top_src", ["feature"], "top", "x", "true", "false")
O.part("fr_joined", ("fr_rank", "fr_weight", "fr_top", "sw_base"), """
SELECT a.feature, a.n AS n_rank, a.pearson_r AS pearson_r_with_rank, a.pearson_p AS pearson_p_with_rank,
       a.spearman_rho AS spearman_rho_with_rank, a.spearman_p AS spearman_p_with_rank,
       (SELECT CASE WHEN bool_or(has_streams) THEN 'streams' ELSE 'analysis_weight' END FROM sw_base) AS weight_var,
       b.n AS n_weight, b.pearson_r AS pearson_r_with_weight, b.pearson_p AS pearson_p_with_weight,
       b.spearman_rho AS spearman_rho_with_weight, b.spearman_p AS spearman_p_with_weight,
       greatest(abs(a.spearman_rho), abs(b.spearman_rho)) AS abs_best_corr_rank_or_weight,
       t.welch_t AS top50_vs_rest_welch_t, t.welch_p AS top50_vs_rest_welch_p, t.mean_a AS top50_mean, t.mean_b AS rest_mean
FROM fr_rank a JOIN fr_weight b ON a.feature = b.feature JOIN fr_top t ON a.feature = t.feature""")
O.bh("fr_bh", "fr_joined", [], [("spearman_p_with_rank", "spearman_p_with_rank_adj_bh"),
                                ("spearman_p_with_weight", "spearman_p_with_weight_adj_bh"),
                                ("top50_vs_rest_welch_p", "top50_vs_rest_welch_p_adj_bh")])


@query("feature_rank_corr", O.build("""
SELECT *, coalesce(spearman_p_with_rank_adj_bh < 0.05, false) AS significant_rank_005,
       coalesce(spearman_p_with_weight_adj_bh < 0.05, false) AS significant_weight_005,
       coalesce(top50_vs_rest_welch_p_adj_bh < 0.05, false) AS significant_top50_005 FROM fr_bh""", "fr_bh"))
def feature_rank_corr(spark, sf):
    """Song-grain feature vs rank and vs weight (exact distributed ranks)
    and top-50 vs rest Welch; three BH families."""
    s = P.song_level(spark, sf)
    has = s.select((F.sum(F.coalesce(F.col("streams"), F.lit(0.0))) > 0).alias("h")).scalar()
    weight = F.when(F.coalesce(has, F.lit(False)), F.col("streams")).otherwise(F.col("analysis_weight"))
    # The tests make several passes over these rows: write the narrow columns
    # once instead of re-running the fact join per pass.
    s = cut_lineage(s.select(*SONG_FEATURES, F.col("rank").cast("double").alias("rank"), weight.cast("double").alias("weight"),
                             F.col("top_50").cast("string").alias("top")))
    c = S.target_correlations(s, list(SONG_FEATURES), ["rank", "weight"], min_n=30)
    long = R.long_of(s, [], [{"feature": f, "x": F.col(f).cast("double"), "top": F.col("top")} for f in SONG_FEATURES])
    # every feature has a row in c; without any song there is none
    t = S.two_group_tests(long, ["feature"], "top", "x", "true", "false", all_keys=False, mann_whitney=False)
    c = c.crossJoin(F.broadcast(s.limit(1).select(F.lit(True).alias("_any"))))
    of = lambda target, col: F.max(F.when(F.col("target") == target, F.col(col)))
    out = c.groupBy("feature").agg(
        of("rank", "n").alias("n_rank"),
        of("rank", "pearson_r").alias("pearson_r_with_rank"), of("rank", "pearson_p").alias("pearson_p_with_rank"),
        of("rank", "spearman_rho").alias("spearman_rho_with_rank"), of("rank", "spearman_p").alias("spearman_p_with_rank"),
        of("weight", "n").alias("n_weight"),
        of("weight", "pearson_r").alias("pearson_r_with_weight"), of("weight", "pearson_p").alias("pearson_p_with_weight"),
        of("weight", "spearman_rho").alias("spearman_rho_with_weight"), of("weight", "spearman_p").alias("spearman_p_with_weight"))
    out = out.join(t.select("feature", F.col("welch_t").alias("top50_vs_rest_welch_t"),
                            F.col("welch_p").alias("top50_vs_rest_welch_p"), F.col("mean_a").alias("top50_mean"),
                            F.col("mean_b").alias("rest_mean")), "feature", "left")
    out = out.select("*", F.when(F.coalesce(has, F.lit(False)), F.lit("streams")).otherwise(F.lit("analysis_weight")).alias("weight_var"),
                     F.greatest(F.abs("spearman_rho_with_rank"), F.abs("spearman_rho_with_weight")).alias("abs_best_corr_rank_or_weight"))
    out = S.bh_adjust_all(out, [], {p: p + "_adj_bh" for p in ("spearman_p_with_rank", "spearman_p_with_weight", "top50_vs_rest_welch_p")})
    return out.select("*", *[F.coalesce(F.col(p + "_adj_bh") < 0.05, F.lit(False)).alias(n) for p, n in (
        ("spearman_p_with_rank", "significant_rank_005"), ("spearman_p_with_weight", "significant_weight_005"),
        ("top50_vs_rest_welch_p", "significant_top50_005"))])


# -- J8 X11: song rows with the attributes of their day ------------------------------
_CARRIED = ", ".join(f"a.{c}" for c in P.SONG_WEATHER_COLS)


@query("song_weather", O.build(f"""
SELECT s.date, s.rank, s.valence, s.streams, s.analysis_weight, s.track_genre, s.artist_first, s.top_50,
       coalesce(s.rank <= 20, false) AS top_20, coalesce(s.valence <= 0.40, false) AS sad_song,
       coalesce(s.energy <= 0.50, false) AS low_energy_song,
       coalesce(CASE WHEN s.energy IS NULL THEN s.valence <= 0.40 ELSE s.valence <= 0.40 AND s.energy <= 0.50 END, false) AS sad_by_energy,
       {_CARRIED}
FROM sw_base s LEFT JOIN analysis_daily a ON s.date = a.date""", "sw_base", "analysis_daily"))
def song_weather(spark, sf):
    """Song rows with sad, low-energy, top 50 / top 20 flags and their day's weather."""
    s = P.song_weather(spark, sf)
    return s.select("date", "rank", "valence", "streams", "analysis_weight", "track_genre", "artist_first", "top_50",
                    flag(F.col("rank") <= 20).alias("top_20"), sad_flag().alias("sad_song"),
                    flag(F.col("energy") <= LOW_ENERGY_THRESHOLD).alias("low_energy_song"),
                    sad_flag(energy="energy").alias("sad_by_energy"), *P.SONG_WEATHER_COLS)
