"""DuckDB SQL of the same plans, as named CTE parts with dependencies.

``build(final_select, *parts)`` resolves the dependency closure and emits one
``WITH`` statement.  Every part reads the driver's whole tables.
"""

from __future__ import annotations

from ..functions.nulls import round_abs_sql
from ..sources.fixtures import SQL as FIXTURE_SQL

PARTS: dict[str, tuple[tuple[str, ...], str]] = {k: ((), v.strip()) for k, v in FIXTURE_SQL.items()}


def part(name: str, deps: tuple[str, ...], body: str) -> None:
    PARTS[name] = (deps, f"{name} AS (\n{body.strip()}\n)")


def build(final_select: str, *needed: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in PARTS[n][0]:
            visit(d)
        order.append(n)

    for n in needed:
        visit(n)
    if not order:
        return final_select.strip()
    return "WITH " + ",\n".join(PARTS[n][1] for n in order) + "\n" + final_select.strip()


def zsql(x: str, m: str, s: str) -> str:
    return f"(CASE WHEN {s} <> 0 THEN ({x} - {m}) / {s} END)"


# -- daily summary (G2-G7) -------------------------------------------------
def daily(name: str, src: str, features) -> None:
    """CTE ``{name}_daily``: the daily summary of the song rows in ``src``."""
    per_feature = "\n       ".join(
        f"avg({f}) FILTER (WHERE valence IS NOT NULL) AS avg_{f}, "
        f"sum({f} * w) FILTER (WHERE valence IS NOT NULL AND {f} IS NOT NULL AND w > 0) AS {f}_num, "
        f"sum(w) FILTER (WHERE valence IS NOT NULL AND {f} IS NOT NULL AND w > 0) AS {f}_den," for f in features)
    weighted = " ".join(f"avg_{f}, {f}_num / nullif({f}_den, 0) AS weighted_avg_{f}," for f in features)
    part(f"{name}_hs", (src,), f"""
SELECT coalesce(sum(coalesce(streams, 0.0)), 0) > 0 AS has_streams FROM {src}""")
    part(f"{name}_base", (src, f"{name}_hs"), f"""
SELECT s.*, has_streams,
       CASE WHEN streams >= 0 THEN streams END AS s_nn,
       CASE WHEN rank IS NOT NULL THEN greatest(201.0 - rank, 1.0) END AS rw,
       coalesce(valence <= 0.40, false) AS sad,
       coalesce(energy <= 0.50, false) AS low,
       CASE WHEN has_streams THEN (CASE WHEN streams >= 0 THEN streams END)
            ELSE (CASE WHEN rank IS NOT NULL THEN greatest(201.0 - rank, 1.0) END) END AS w
FROM {src} s, {name}_hs""")
    part(f"{name}_agg", (f"{name}_base",), f"""
SELECT date, count(rank) AS top200_rows, count(valence) AS tracks_with_valence,
       avg(valence) AS avg_valence, median(valence) AS median_valence, stddev_samp(valence) AS std_valence,
       min(valence) AS min_valence, max(valence) AS max_valence,
       count(*) FILTER (WHERE valence IS NOT NULL AND sad) AS sad_n,
       sum(valence * w) FILTER (WHERE valence IS NOT NULL AND w > 0) AS vnum,
       sum(w) FILTER (WHERE valence IS NOT NULL AND w > 0) AS den,
       sum(w) FILTER (WHERE valence IS NOT NULL AND w > 0 AND sad) AS w_sad,
       sum(w) FILTER (WHERE valence IS NOT NULL AND w > 0 AND low) AS w_low,
       sum(w) FILTER (WHERE valence IS NOT NULL AND w > 0 AND sad AND low) AS w_dep,
       sum(w) FILTER (WHERE valence IS NOT NULL) AS w_total,
       {per_feature}
       sum(s_nn) FILTER (WHERE valence IS NOT NULL) AS ts, sum(s_nn) FILTER (WHERE valence IS NOT NULL AND sad) AS ss,
       bool_or(has_streams) AS hs
FROM {name}_base WHERE date IS NOT NULL GROUP BY date""")
    part(f"{name}_daily", (f"{name}_agg",), f"""
SELECT date, top200_rows, tracks_with_valence,
       CASE WHEN top200_rows > 0 THEN tracks_with_valence / top200_rows END AS valence_coverage,
       avg_valence, median_valence, std_valence, min_valence, max_valence,
       CASE WHEN tracks_with_valence > 0 THEN sad_n END AS sad_songs_count,
       CASE WHEN tracks_with_valence > 0 THEN sad_n / tracks_with_valence END AS share_sad_songs,
       vnum / nullif(den, 0) AS weighted_avg_valence,
       w_sad / nullif(den, 0) AS weighted_share_sad,
       w_low / nullif(den, 0) AS weighted_share_low_energy,
       w_dep / nullif(den, 0) AS weighted_share_depressive,
       CASE WHEN tracks_with_valence > 0 THEN coalesce(w_total, 0.0) END AS analysis_weight_total,
       CASE WHEN tracks_with_valence > 0 THEN (CASE WHEN hs THEN 'streams' ELSE 'rank_weight' END) END AS weight_source,
       {weighted}
       CASE WHEN tracks_with_valence > 0 AND hs THEN coalesce(ts, 0.0) END AS total_streams,
       CASE WHEN tracks_with_valence > 0 AND hs THEN coalesce(ss, 0.0) END AS sad_streams,
       CASE WHEN tracks_with_valence > 0 AND hs AND coalesce(ts, 0.0) > 0 THEN coalesce(ss, 0.0) / ts END AS share_sad_streams,
       CASE WHEN tracks_with_valence > 0 THEN (CASE WHEN hs THEN (CASE WHEN coalesce(ts, 0.0) > 0 THEN coalesce(ss, 0.0) / ts END)
                                                   ELSE w_sad / nullif(den, 0) END) END AS main_sad_share_metric,
       CASE WHEN tracks_with_valence > 0 THEN (CASE WHEN hs THEN 'streamgewogen aandeel sad songs'
                                                   ELSE 'rankgewogen aandeel sad songs' END) END AS main_sad_share_label
FROM {name}_agg""")


# The audio features of a song but its valence.
AUDIO = ("energy", "danceability", "speechiness", "tempo", "acousticness", "instrumentalness", "liveness", "loudness", "popularity")
daily("sd", "song_day", AUDIO)
part("daily_summary", ("sd_daily",), "SELECT * FROM sd_daily")

# -- weather calendar (F6 F14 G9 J6) and types (X12-X14 X19) ---------------
part("sd_bounds", ("song_day",), "SELECT min(date) AS d0, max(date) AS d1 FROM song_day")
part("ws_first", ("weather_station", "sd_bounds"), """
SELECT station, date, prcp, tsun FROM weather_station, sd_bounds
WHERE date IS NOT NULL AND date BETWEEN d0 AND d1
QUALIFY row_number() OVER (PARTITION BY station, date ORDER BY ordinal) = 1""")
part("weather_daily", ("ws_first",), """
SELECT date, avg(prcp) AS prcp,
       avg(tsun) AS tsun
FROM ws_first GROUP BY date""")
part("calendar_days", ("sd_bounds",), """
SELECT CAST(unnest(generate_series(d0, d1, INTERVAL 1 DAY)) AS DATE) AS date FROM sd_bounds""")
part("weather_cal", ("calendar_days", "weather_daily"), """
SELECT c.date, w.prcp, w.tsun FROM calendar_days c LEFT JOIN weather_daily w ON c.date = w.date""")
part("wt_stats", ("weather_cal",), """
SELECT quantile_cont(tsun, 0.40) AS q40, quantile_cont(tsun, 0.60) AS q60,
       avg(prcp) AS mp, stddev_samp(prcp) AS sp, avg(tsun) AS mt, stddev_samp(tsun) AS st FROM weather_cal""")
part("weather_typed", ("weather_cal", "wt_stats"), f"""
SELECT date, prcp, tsun,
       coalesce(prcp > 0, false) AS rainy_day, coalesce(prcp >= 5.0, false) AS heavy_rain,
       coalesce(prcp <= 0, false) AS dry_day,
       CASE WHEN prcp > 0 THEN 'Regenachtig' ELSE 'Droog' END AS rain_dry_type,
       {round_abs_sql(zsql('tsun', 'mt', 'st') + ' - ' + zsql('prcp', 'mp', 'sp'))} AS weather_score_sunny,
       {round_abs_sql(zsql('prcp', 'mp', 'sp') + ' - ' + zsql('tsun', 'mt', 'st'))} AS weather_score_dreary,
       CASE WHEN coalesce(prcp >= 1.0 AND tsun <= q40, false) THEN 'Strict regenachtig'
            WHEN coalesce(prcp <= 0.2 AND tsun >= q60, false) THEN 'Strict zonnig' ELSE 'Gemengd/overig' END AS strict_weather_type,
       CASE WHEN coalesce(prcp >= 1.0 AND tsun <= q40, false) THEN 'rainy'
            WHEN coalesce(prcp <= 0.2 AND tsun >= q60, false) THEN 'sunny' ELSE 'mixed' END AS weather_type_key
FROM weather_cal, wt_stats""")
part("final_daily", ("daily_summary", "weather_typed"), """
SELECT d.*, w.* EXCLUDE (date) FROM daily_summary d LEFT JOIN weather_typed w ON d.date = w.date""")

# -- adaptive benchmark (X16) and main metrics (P12) -----------------------
def benchmark(name: str, src: str, min_days: int = 20) -> None:
    """CTE ``name``: X16 over the daily rows of ``src``; ``{name}_th`` has the thresholds."""
    part(f"{name}_q", (src,), f"""
SELECT greatest(1.0, coalesce(quantile_cont(prcp, 0.67), 1.0)) AS pbad_s,
       greatest(0.5, coalesce(quantile_cont(prcp, 0.50), 0.5)) AS pbad_r,
       quantile_cont(tsun, 0.33) AS qt33, quantile_cont(tsun, 0.50) AS qt50, quantile_cont(tsun, 0.67) AS qt67,
       coalesce(min(tsun) < max(tsun), false) AS tsun_ok,
       avg(prcp) AS mp, stddev_samp(prcp) AS sp, avg(tsun) AS mt, stddev_samp(tsun) AS st
FROM {src}""")
    part(f"{name}_count", (src, f"{name}_q"), f"""
SELECT count(*) FILTER (WHERE coalesce(prcp <= 0.2 AND tsun >= qt67, false)) AS ng,
       count(*) FILTER (WHERE coalesce(prcp >= pbad_s AND tsun <= qt33, false)) AS nb
FROM {src}, {name}_q""")
    part(f"{name}_th", (f"{name}_q", f"{name}_count"), f"""
SELECT CASE WHEN NOT tsun_ok THEN 'prcp_only_fallback' WHEN ng >= {min_days} AND nb >= {min_days} THEN 'strict_prcp_and_tsun'
            ELSE 'relaxed_prcp_and_tsun_due_to_low_n' END AS benchmark_version,
       0.2 AS prcp_good_max,
       CASE WHEN NOT tsun_ok OR (ng >= {min_days} AND nb >= {min_days}) THEN pbad_s ELSE pbad_r END AS prcp_bad_min,
       CASE WHEN NOT tsun_ok THEN NULL WHEN ng >= {min_days} AND nb >= {min_days} THEN qt67 ELSE qt50 END AS tsun_good_min,
       CASE WHEN NOT tsun_ok THEN NULL WHEN ng >= {min_days} AND nb >= {min_days} THEN qt33 ELSE qt50 END AS tsun_bad_max,
       mp, sp, mt, st
FROM {name}_q, {name}_count""")
    part(f"{name}_flags", (src, f"{name}_th"), f"""
SELECT f.*, benchmark_version, prcp_good_max, prcp_bad_min, tsun_good_min, tsun_bad_max, mp, sp, mt, st,
       coalesce(CASE WHEN benchmark_version = 'prcp_only_fallback' THEN prcp <= prcp_good_max
                     ELSE prcp <= prcp_good_max AND tsun >= tsun_good_min END, false) AS g_,
       coalesce(CASE WHEN benchmark_version = 'prcp_only_fallback' THEN prcp >= prcp_bad_min
                     ELSE prcp >= prcp_bad_min AND tsun <= tsun_bad_max END, false) AS b_
FROM {src} f, {name}_th""")
    part(name, (f"{name}_flags",), f"""
SELECT * EXCLUDE (g_, b_, mp, sp, mt, st, benchmark_version, prcp_good_max, prcp_bad_min, tsun_good_min, tsun_bad_max),
       g_ AND NOT b_ AS good_weather, b_ AND NOT g_ AS bad_weather,
       CASE WHEN g_ AND NOT b_ THEN 'Zonnig/goed weer' WHEN b_ AND NOT g_ THEN 'Regenachtig/slecht weer' END AS good_bad_weather_type,
       (g_ AND NOT b_) OR (b_ AND NOT g_) AS selected_weather_benchmark_day,
       {round_abs_sql(zsql('tsun', 'mt', 'st') + ' - ' + zsql('prcp', 'mp', 'sp'))} AS weather_score_good,
       {round_abs_sql(zsql('prcp', 'mp', 'sp') + ' - ' + zsql('tsun', 'mt', 'st'))} AS weather_score_bad
FROM {name}_flags""")


benchmark("benchmarked", "final_daily")
part("mm", ("benchmarked",), """
SELECT count(weighted_avg_valence) AS nw, count(main_sad_share_metric) AS nm,
       count(share_sad_streams) AS nss, count(weighted_share_sad) AS nws FROM benchmarked""")
part("analysis_daily", ("benchmarked", "mm"), """
SELECT b.* EXCLUDE (main_sad_share_metric, main_sad_share_label),
       CASE WHEN nw > 0 THEN weighted_avg_valence ELSE avg_valence END AS main_avg_valence_metric,
       CASE WHEN nw > 0 THEN 'rank/streamgewogen gemiddelde valence' ELSE 'gemiddelde valence' END AS main_avg_valence_label,
       CASE WHEN nm > 0 THEN main_sad_share_metric WHEN nss > 0 THEN share_sad_streams
            WHEN nws > 0 THEN weighted_share_sad ELSE share_sad_songs END AS main_sad_share_metric,
       CASE WHEN nm > 0 THEN coalesce(main_sad_share_label, 'aandeel sad songs')
            WHEN nss > 0 THEN 'streamgewogen aandeel sad songs' WHEN nws > 0 THEN 'rankgewogen aandeel sad songs'
            ELSE 'aandeel sad songs' END AS main_sad_share_label,
       CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, strftime(date, '%B') AS month_name,
       CASE WHEN month(date) IN (12, 1, 2) THEN 'winter' WHEN month(date) IN (3, 4, 5) THEN 'spring'
            WHEN month(date) IN (6, 7, 8) THEN 'summer' ELSE 'autumn' END AS season,
       CAST(CASE WHEN month(date) IN (12, 1, 2) THEN 1 WHEN month(date) IN (3, 4, 5) THEN 2
            WHEN month(date) IN (6, 7, 8) THEN 3 ELSE 4 END AS INTEGER) AS season_order
FROM benchmarked b, mm""")

# -- early Spark path (G1, E4) ---------------------------------------------
part("early_daily", ("song_day",), """
SELECT date, count(*) AS song_rows, sum(streams) AS total_streams, count(valence) AS tracks_with_valence,
       sum(CASE WHEN valence IS NOT NULL THEN streams ELSE 0.0 END) AS streams_with_valence,
       sum(CASE WHEN valence < 0.40 THEN streams ELSE 0.0 END) AS sad_streams,
       count(*) FILTER (WHERE valence < 0.40) AS sad_songs_count,
       avg(valence) AS avg_valence, median(valence) AS median_valence, stddev_samp(valence) AS std_valence,
       min(valence) AS min_valence, max(valence) AS max_valence,
       sum(CASE WHEN valence IS NOT NULL THEN valence * streams ELSE 0.0 END) AS wnum
FROM song_day WHERE date IS NOT NULL AND streams IS NOT NULL AND streams >= 0 GROUP BY date""")
part("early_metrics", ("early_daily",), """
SELECT * EXCLUDE (wnum),
       CASE WHEN song_rows > 0 THEN tracks_with_valence / song_rows END AS valence_coverage,
       CASE WHEN total_streams > 0 THEN streams_with_valence / total_streams END AS stream_coverage,
       CASE WHEN streams_with_valence > 0 THEN sad_streams / streams_with_valence END AS share_sad_streams,
       CASE WHEN tracks_with_valence > 0 THEN sad_songs_count / tracks_with_valence END AS share_sad_songs,
       CASE WHEN streams_with_valence > 0 THEN wnum / streams_with_valence END AS weighted_avg_valence
FROM early_daily""")
part("early_final", ("early_metrics", "weather_cal"), """
SELECT e.*, w.prcp, w.tsun,
       CASE WHEN w.prcp IS NOT NULL THEN w.prcp > 0 END AS rainy_day,
       CASE WHEN w.prcp IS NOT NULL THEN w.prcp > 5.0 END AS heavy_rain
FROM early_metrics e LEFT JOIN weather_cal w ON e.date = w.date""")


# -- statistical test generators (mirror operators.stattests) --------------
from ..functions import tails as _T  # noqa: E402


def _k(keys, prefix=""):
    return ", ".join(f"{prefix}{k}" for k in keys)


def _rank(keys, v):
    part = f"PARTITION BY {_k(keys)}" if keys else ""
    sep = ", " if keys else ""
    return (f"(rank() OVER ({part} ORDER BY {v}) + (count(*) OVER (PARTITION BY {_k(keys)}{sep}{v}) - 1) / 2.0)")


def corr_tests(name: str, src: str, keys: list[str], x: str, y: str, min_n: int = 10,
               all_keys: bool = True) -> None:
    """CTE ``name``: keys, n, pearson_r, pearson_p, spearman_rho, spearman_p."""
    K = _k(keys)
    part(f"{name}_d", (src,), f"""
SELECT {K}, CAST({x} AS DOUBLE) AS _x, CAST({y} AS DOUBLE) AS _y FROM {src}
WHERE {x} IS NOT NULL AND {y} IS NOT NULL""")
    part(f"{name}_r", (f"{name}_d",), f"""
SELECT *, {_rank(keys, '_x')} AS _rx, {_rank(keys, '_y')} AS _ry FROM {name}_d""")
    part(f"{name}_a", (f"{name}_r",), f"""
SELECT {K}, count(*) AS n, min(_x) < max(_x) AS vx, min(_y) < max(_y) AS vy,
       covar_samp(_x, _y) AS cxy, stddev_samp(_x) AS sx, stddev_samp(_y) AS sy,
       covar_samp(_rx, _ry) AS crr, stddev_samp(_rx) AS srx, stddev_samp(_ry) AS sry
FROM {name}_r GROUP BY {K}""")
    part(f"{name}_b", (f"{name}_a",), f"""
SELECT {K}, n,
       CASE WHEN n >= {min_n} AND vx AND vy THEN least(1.0, greatest(-1.0, cxy / nullif(sx * sy, 0))) END AS pearson_r,
       CASE WHEN n >= {min_n} AND vx AND vy THEN least(1.0, greatest(-1.0, crr / nullif(srx * sry, 0))) END AS spearman_rho
FROM {name}_a""")
    tp = _T.t_two_sided_sql("(pearson_r * sqrt(n - 2.0) / nullif(sqrt(1.0 - pearson_r * pearson_r), 0))", "(n - 2.0)", "duckdb")
    ts = _T.t_two_sided_sql("(spearman_rho * sqrt(n - 2.0) / nullif(sqrt(1.0 - spearman_rho * spearman_rho), 0))", "(n - 2.0)", "duckdb")
    if all_keys:
        part(f"{name}_keys", (src,), f"SELECT DISTINCT {K} FROM {src}")
        body = f"""
SELECT {_k(keys, 'k.')}, coalesce(b.n, 0) AS n, b.pearson_r,
       CASE WHEN abs(b.pearson_r) >= 1.0 THEN 0.0 ELSE {tp} END AS pearson_p,
       b.spearman_rho,
       CASE WHEN abs(b.spearman_rho) >= 1.0 THEN 0.0 ELSE {ts} END AS spearman_p
FROM {name}_keys k LEFT JOIN {name}_b b ON {' AND '.join(f'k.{c} IS NOT DISTINCT FROM b.{c}' for c in keys)}"""
        part(name, (f"{name}_keys", f"{name}_b"), body)
    else:
        part(name, (f"{name}_b",), f"""
SELECT {K}, n, pearson_r, CASE WHEN abs(pearson_r) >= 1.0 THEN 0.0 ELSE {tp} END AS pearson_p,
       spearman_rho, CASE WHEN abs(spearman_rho) >= 1.0 THEN 0.0 ELSE {ts} END AS spearman_p
FROM {name}_b""")


def two_group(name: str, src: str, keys: list[str], g: str, v: str, a: str, b: str) -> None:
    """CTE ``name``: Welch, Mann-Whitney, Cohen's d per keys (two_group_tests)."""
    K = _k(keys)
    part(f"{name}_d", (src,), f"""
SELECT {K}, {g} AS _g, CAST({v} AS DOUBLE) AS _v FROM {src} WHERE {g} IN ('{a}', '{b}') AND {v} IS NOT NULL""")
    part(f"{name}_r", (f"{name}_d",), f"SELECT *, {_rank(keys, '_v')} AS _r FROM {name}_d")
    part(f"{name}_t", (f"{name}_d",), f"""
SELECT {K}, sum(t * t * t - t) AS ties FROM (SELECT {K}, _v, CAST(count(*) AS DOUBLE) AS t FROM {name}_d GROUP BY {K}, _v) GROUP BY {K}""")
    part(f"{name}_a", (f"{name}_r", f"{name}_t"), f"""
SELECT {_k(keys, 'r.')}, count(*) FILTER (WHERE _g = '{a}') AS n_a, count(*) FILTER (WHERE _g = '{b}') AS n_b,
       avg(_v) FILTER (WHERE _g = '{a}') AS ma, avg(_v) FILTER (WHERE _g = '{b}') AS mb,
       median(_v) FILTER (WHERE _g = '{a}') AS meda, median(_v) FILTER (WHERE _g = '{b}') AS medb,
       var_samp(_v) FILTER (WHERE _g = '{a}') AS va, var_samp(_v) FILTER (WHERE _g = '{b}') AS vb,
       sum(_r) FILTER (WHERE _g = '{a}') AS ra, any_value(t.ties) AS ties
FROM {name}_r r LEFT JOIN {name}_t t ON {' AND '.join(f'r.{c} = t.{c}' for c in keys)} GROUP BY {_k(keys, 'r.')}""")
    part(f"{name}_b", (f"{name}_a",), f"""
SELECT *, CASE WHEN n_a > 0 AND n_b > 0 THEN ma END AS mean_a, CASE WHEN n_a > 0 AND n_b > 0 THEN mb END AS mean_b,
       CASE WHEN n_a > 0 AND n_b > 0 THEN meda END AS median_a, CASE WHEN n_a > 0 AND n_b > 0 THEN medb END AS median_b,
       CASE WHEN n_a >= 2 AND n_b >= 2 THEN va / n_a + vb / n_b END AS se2,
       CASE WHEN n_a >= 2 AND n_b >= 2 THEN ra - n_a * (n_a + 1.0) / 2.0 END AS mannwhitney_u,
       sqrt(((n_a - 1.0) * va + (n_b - 1.0) * vb) / (n_a + n_b - 2.0)) AS pooled
FROM {name}_a""")
    part(f"{name}_c", (f"{name}_b",), f"""
SELECT *, mean_a - mean_b AS difference_a_minus_b,
       CASE WHEN se2 = 0 AND mean_a <> mean_b THEN sign(mean_a - mean_b) * CAST('Infinity' AS DOUBLE)
            ELSE (mean_a - mean_b) / sqrt(nullif(se2, 0)) END AS welch_t,
       se2 * se2 / nullif((va / n_a) * (va / n_a) / (n_a - 1.0) + (vb / n_b) * (vb / n_b) / (n_b - 1.0), 0) AS dfw,
       (abs(mannwhitney_u - n_a * n_b / 2.0) - 0.5)
         / nullif(sqrt(n_a * n_b / 12.0 * ((n_a + n_b + 1.0) - ties / nullif((n_a + n_b) * (n_a + n_b - 1.0), 0))), 0) AS z
FROM {name}_b""")
    part(f"{name}_keys", (src,), f"SELECT DISTINCT {K} FROM {src}")
    part(f"{name}_ck", (f"{name}_keys", f"{name}_c"), f"""
SELECT {_k(keys, 'k.')}, c.* EXCLUDE ({K}, n_a, n_b), coalesce(c.n_a, 0) AS n_a, coalesce(c.n_b, 0) AS n_b
FROM {name}_keys k LEFT JOIN {name}_c c ON {' AND '.join(f'k.{c} = c.{c}' for c in keys)}""")
    part(name, (f"{name}_ck",), f"""
SELECT {K}, '{a}' AS group_a, '{b}' AS group_b, n_a, n_b, mean_a, mean_b, median_a, median_b, difference_a_minus_b,
       welch_t, CASE WHEN isinf(welch_t) THEN 0.0 WHEN welch_t IS NOT NULL THEN {_T.t_two_sided_sql('welch_t', 'dfw', 'duckdb')} END AS welch_p,
       mannwhitney_u,
       CASE WHEN z <= 0 THEN 1.0 WHEN z IS NOT NULL THEN {_T.norm_two_sided_sql('z', 'duckdb')} END AS mannwhitney_p,
       CASE WHEN z IS NOT NULL THEN 'asymptotic' END AS mannwhitney_method,
       CASE WHEN n_a >= 2 AND n_b >= 2 AND pooled > 0 THEN difference_a_minus_b / pooled END AS cohens_d
FROM {name}_ck""")


def anova(name: str, src: str, keys: list[str], g: str, v: str) -> None:
    """CTE ``name``: n_total, groups, anova_f/p, kruskal_h/p per keys."""
    K = _k(keys)
    part(f"{name}_d", (src,), f"""
SELECT {K}, {g} AS _g, CAST({v} AS DOUBLE) AS _v FROM {src} WHERE {g} IS NOT NULL AND {v} IS NOT NULL""")
    part(f"{name}_s", (f"{name}_d",), f"SELECT {K}, _g, count(*) AS ng FROM {name}_d GROUP BY {K}, _g")
    part(f"{name}_tot", (f"{name}_s",), f"SELECT {K}, sum(ng)::BIGINT AS n_total, count(*) AS groups FROM {name}_s GROUP BY {K}")
    part(f"{name}_v", (f"{name}_d", f"{name}_s"), f"""
SELECT d.*, {_rank(['d.' + k for k in keys], 'd._v')} AS _r FROM {name}_d d JOIN {name}_s s
  ON {' AND '.join(f'd.{c} = s.{c}' for c in keys + ['_g'])} WHERE s.ng >= 2""")
    part(f"{name}_g", (f"{name}_v",), f"""
SELECT *, sum(_s) OVER (PARTITION BY {K}) / sum(_n) OVER (PARTITION BY {K}) AS gm FROM (
  SELECT {K}, _g, CAST(count(*) AS DOUBLE) AS _n, avg(_v) AS _m, var_samp(_v) AS _var, sum(_r) AS _R, sum(_v) AS _s
  FROM {name}_v GROUP BY {K}, _g)""")
    part(f"{name}_t", (f"{name}_v",), f"""
SELECT {K}, sum(t * t * t - t) AS ties FROM (SELECT {K}, _v, CAST(count(*) AS DOUBLE) AS t FROM {name}_v GROUP BY {K}, _v) GROUP BY {K}""")
    part(f"{name}_a", (f"{name}_g", f"{name}_t"), f"""
SELECT {_k(keys, 'g.')}, CAST(count(*) AS DOUBLE) AS k, sum(_n) AS nn, sum(_n * (_m - gm) * (_m - gm)) AS ssb,
       sum((_n - 1.0) * _var) AS ssw, sum(_R * _R / _n) AS r2n, any_value(t.ties) AS ties
FROM {name}_g g LEFT JOIN {name}_t t ON {' AND '.join(f'g.{c} = t.{c}' for c in keys)} GROUP BY {_k(keys, 'g.')}""")
    part(f"{name}_b", (f"{name}_a",), f"""
SELECT {K}, k - 1.0 AS d1, nn - k AS d2,
       CASE WHEN k >= 2 AND ssw = 0 AND ssb > 0 THEN CAST('Infinity' AS DOUBLE)
            WHEN k >= 2 THEN (ssb / (k - 1.0)) / (nullif(ssw, 0) / (nn - k)) END AS anova_f,
       CASE WHEN k >= 2 THEN (12.0 / (nn * (nn + 1.0)) * r2n - 3.0 * (nn + 1.0)) / nullif(1.0 - ties / (nn * nn * nn - nn), 0) END AS kruskal_h
FROM {name}_a""")
    part(name, (f"{name}_tot", f"{name}_b"), f"""
SELECT {_k(keys, 't.')}, t.n_total, t.groups, b.anova_f,
       CASE WHEN isinf(b.anova_f) THEN 0.0 WHEN b.anova_f IS NOT NULL THEN {_T.f_upper_sql('b.anova_f', 'b.d1', 'b.d2', 'duckdb')} END AS anova_p,
       b.kruskal_h,
       CASE WHEN b.kruskal_h IS NOT NULL THEN {_T.chi2_upper_sql('b.kruskal_h', 'b.d1', 'duckdb')} END AS kruskal_p
FROM {name}_tot t LEFT JOIN {name}_b b ON {' AND '.join(f't.{c} = b.{c}' for c in keys)}""")


def bh(name: str, src: str, family: list[str], pairs: list[tuple[str, str]]) -> None:
    """CTE ``name`` = ``src`` plus BH-adjusted columns (p, out) per family."""
    def part_by(p):
        return ", ".join(family + [f"({p} IS NULL)"])
    step = ", ".join(f"row_number() OVER (PARTITION BY {part_by(p)} ORDER BY {p}) AS _rn_{p}, "
                     f"count({p}) OVER (PARTITION BY {part_by(p)}) AS _m_{p}" for p, _ in pairs)
    part(f"{name}_rn", (src,), f"SELECT *, {step} FROM {src}")
    outs = ", ".join(
        f"CASE WHEN {p} IS NOT NULL THEN least(1.0, min({p} * _m_{p} / _rn_{p}) OVER (PARTITION BY {part_by(p)} "
        f"ORDER BY _rn_{p} DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) END AS {o}" for p, o in pairs)
    drop = ", ".join(f"_rn_{p}, _m_{p}" for p, _ in pairs)
    part(name, (f"{name}_rn",), f"SELECT * EXCLUDE ({drop}), {outs} FROM {name}_rn")


def conclusion_sql(p: str, p_adj: str | None = None) -> str:
    use = f"coalesce({p_adj}, {p})" if p_adj else p
    return f"CASE WHEN {use} IS NULL THEN 'GEEN TEST' WHEN {use} < 0.05 THEN 'SIGNIFICANT' ELSE 'NIET SIGNIFICANT' END"
