"""Matching queries: keys, dates, chart filter, cascade."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as DT
from ..functions import text as TX
from ..operators import daily as D
from ..operators import match as M
from ..session import cut_lineage
from ..sources import fixtures as X
from .catalog import O, query

# The fixture's home market and the file order of its rows (with tie-breakers:
# the chart ordinal is not unique).
COUNTRY = "home"
CHART_ORDER = ["ordinal", "suppkey", "price"]
FEATURE_ORDER = ["ordinal"]
# Fixed patterns of the oracle, written out here so that it does not follow a
# change of the operators' own.
YMD = r"^(\d{4})[/-](\d{1,2})[/-](\d{1,2})$"
DMY = r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4})$"
ARTIST_SPLIT = r"\s*(?:,|;|/| x | and )\s*"
ID_PATTERNS = (r"open\.spotify\.com/track/([A-Za-z0-9]{22})", r"spotify:track:([A-Za-z0-9]{22})", r"\b([A-Za-z0-9]{22})\b")
WS = r"'^\s+|\s+$'"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, {WS}, '', 'g')"


def clean_key_sql(x: str, variant: str = "standard") -> str:
    v = f"strip_accents({_strip(f'lower({x})')})"
    v = f"replace({v}, '&', ' and ')"
    for pat in (r"\(.*?\)", r"\[.*?\]", r"\bfeat\.?\b.*", r"\bfeaturing\b.*", r"\bft\.?\b.*"):
        v = f"regexp_replace({v}, '{pat}', ' ', 'g')"
    if variant == "compact":
        v = f"regexp_replace(regexp_replace({v}, '\\s+', ' ', 'g'), '[^a-z0-9 ]+', '', 'g')"
    else:
        v = f"regexp_replace(regexp_replace({v}, '[^a-z0-9 ]+', ' ', 'g'), '\\s+', ' ', 'g')"
    return f"coalesce({_strip(v)}, '')"


def first_artist_sql(x: str, variant: str = "standard") -> str:
    return _strip(f"regexp_split_to_array({clean_key_sql(x, variant)}, '{ARTIST_SPLIT}')[1]")


def track_id_sql(x: str) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({x}, '{p}', 1), '')" for p in ID_PATTERNS) + ")"


def uri_tail_sql(x: str) -> str:
    s = f"regexp_replace({_strip(f'CAST({x} AS VARCHAR)')}, '/+$', '')"
    return f"string_split(string_split({s}, '/')[-1], ':')[-1]"


def clean_date_sql(x: str) -> str:
    s = _strip(f"CAST({x} AS VARCHAR)")
    s = _strip(f"split_part({s}, 'T', 1)")
    return f"nullif(split_part({s}, ' ', 1), '')"


def _iso_sql(y, m, d):
    return f"CASE WHEN ({m}) BETWEEN 1 AND 12 AND ({d}) BETWEEN 1 AND 31 THEN printf('%04d-%02d-%02d', {y}, {m}, {d}) END"


def normalize_date_sql(s: str, order: str) -> str:
    def g(rx, i):
        return f"TRY_CAST(regexp_extract({s}, '{rx}', {i}) AS INTEGER)"
    ymd = _iso_sql(g(YMD, 1), g(YMD, 2), g(YMD, 3))
    a, b, y = g(DMY, 1), g(DMY, 2), g(DMY, 3)
    return (f"CASE WHEN regexp_matches({s}, '{YMD}') THEN {ymd} "
            f"WHEN regexp_matches({s}, '{DMY}') THEN (CASE WHEN {order} = 'dayfirst' THEN {_iso_sql(y, b, a)} "
            f"ELSE {_iso_sql(y, a, b)} END) END")


# -- X1-X4b keys -------------------------------------------------------------
@query("clean_keys", O.build(f"""
SELECT ordinal, {clean_key_sql('track_name')} AS title_clean, {clean_key_sql('artists')} AS artist_clean,
       {first_artist_sql('artists')} AS artist_first_clean FROM features_raw""", "features_raw"))
def clean_keys(spark, sf):
    """Title / artist / first-artist matching keys of the lookup."""
    f = X.features_raw(spark, sf)
    return f.select("ordinal", TX.clean_key("track_name").alias("title_clean"),
                    TX.clean_key("artists").alias("artist_clean"), TX.first_artist("artists").alias("artist_first_clean"))


@query("clean_keys_compact", O.build(f"""
SELECT ordinal, {clean_key_sql('track_name', 'compact')} AS title_clean, {clean_key_sql('artists', 'compact')} AS artist_clean,
       {first_artist_sql('title', 'compact')} AS artist_first_clean FROM (SELECT ordinal, track_name, artists, artists AS title FROM features_raw)""",
    "features_raw"))
def clean_keys_compact(spark, sf):
    """Older key order (squeeze spaces, then delete symbols)."""
    f = X.features_raw(spark, sf)
    return f.select("ordinal", TX.clean_key("track_name", "compact").alias("title_clean"),
                    TX.clean_key("artists", "compact").alias("artist_clean"),
                    TX.first_artist("artists", "compact").alias("artist_first_clean"))


@query("track_ids", O.build(f"""
SELECT ordinal, track_url, {track_id_sql('track_url')} AS track_id, {uri_tail_sql('track_url')} AS uri_tail,
       regexp_replace(split_part(lower(artists), ',', 1), {WS}, '', 'g') AS artist_first_simple
FROM features_raw""", "features_raw"))
def track_ids(spark, sf):
    """Track id from URL/URI/text, URI tail, simple first artist."""
    f = X.features_raw(spark, sf)
    return f.select("ordinal", "track_url", TX.track_id("track_url").alias("track_id"),
                    TX.uri_tail("track_url").alias("uri_tail"), TX.first_artist_simple("artists").alias("artist_first_simple"))


# -- X5 X6 X21 dates -----------------------------------------------------------
O.part("cr_clean", ("charts_raw",), f"""
SELECT ordinal, suppkey, price, date_raw, {clean_date_sql('date_raw')} AS s FROM charts_raw""")
O.part("cr_vote", ("cr_clean",), f"""
SELECT count(*) FILTER (WHERE regexp_matches(s, '{DMY}') AND TRY_CAST(regexp_extract(s, '{DMY}', 1) AS INTEGER) > 12
                        AND TRY_CAST(regexp_extract(s, '{DMY}', 2) AS INTEGER) <= 12) AS dayfirst_votes,
       count(*) FILTER (WHERE regexp_matches(s, '{DMY}') AND TRY_CAST(regexp_extract(s, '{DMY}', 2) AS INTEGER) > 12
                        AND TRY_CAST(regexp_extract(s, '{DMY}', 1) AS INTEGER) <= 12) AS monthfirst_votes
FROM cr_clean""")
O.part("cr_order", ("cr_vote",), """
SELECT *, CASE WHEN dayfirst_votes >= monthfirst_votes THEN 'dayfirst' ELSE 'monthfirst' END AS slash_order FROM cr_vote""")


@query("date_order_vote", O.build("SELECT * FROM cr_order", "cr_order"))
def date_order_vote(spark, sf):
    """Day-first vs month-first vote over all raw chart dates."""
    return M.date_order_vote(X.charts_raw(spark, sf), "date_raw")


@query("date_normalise", O.build(f"""
SELECT ordinal, suppkey, price, date_raw, {normalize_date_sql('s', 'slash_order')} AS date_text,
       TRY_CAST({normalize_date_sql('s', 'slash_order')} AS DATE) AS date
FROM cr_clean, cr_order""", "cr_clean", "cr_order"))
def date_normalise(spark, sf):
    """Raw date text -> ISO text (voted slash order) -> DATE."""
    c = X.charts_raw(spark, sf)
    vote = F.broadcast(M.date_order_vote(c, "date_raw").select("slash_order"))
    d = c.crossJoin(vote).select("ordinal", "suppkey", "price", "date_raw", "slash_order",
                                 DT.clean_raw_date("date_raw").alias("_ds"))
    d = d.select("ordinal", "suppkey", "price", "date_raw",
                 DT.normalize_date_text(F.col("_ds"), F.col("slash_order"), cleaned=True).alias("date_text"))
    return d.withColumn("date", DT.to_date_lenient("date_text"))


# -- F1-F3 F12: chart filter ---------------------------------------------------
O.part("chart_f", ("charts_raw", "cr_order"), f"""
SELECT date, rank, title, artist, title_clean, artist_clean, artist_first_clean, track_id, streams FROM (
  SELECT {normalize_date_sql(clean_date_sql('date_raw'), 'slash_order')} AS date, CAST(rank AS DOUBLE) AS rank,
         CAST(title AS VARCHAR) AS title, CAST(artist AS VARCHAR) AS artist,
         {clean_key_sql('title')} AS title_clean, {clean_key_sql('artist')} AS artist_clean,
         {first_artist_sql('artist')} AS artist_first_clean, {track_id_sql('url')} AS track_id,
         CAST(streams AS DOUBLE) AS streams, ordinal, suppkey, price
  FROM charts_raw, cr_order
  WHERE lower({_strip('CAST(country AS VARCHAR)')}) = '{COUNTRY}'
    AND coalesce(contains(lower(chart), 'top') AND contains(lower(chart), '200') AND NOT contains(lower(chart), 'viral'), false)
    AND CAST(rank AS DOUBLE) BETWEEN 1 AND 200)
WHERE date IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY date, rank, title_clean, artist_clean ORDER BY ordinal, suppkey, price) = 1""")


def charts_filtered(spark, sf):
    return M.chart_filter(X.charts_raw(spark, sf), COUNTRY, CHART_ORDER)


@query("chart_filter", O.build("SELECT * FROM chart_f", "chart_f"))
def chart_filter(spark, sf):
    """Country / Top 200 / rank filter, ISO dates, keys, keep-first de-dup."""
    return charts_filtered(spark, sf)


# -- F13 J1 G18: cascade -------------------------------------------------------
O.part("fr_keys", ("features_raw",), f"""
SELECT ordinal, {track_id_sql('track_url')} AS track_id, {clean_key_sql('track_name')} AS title_clean,
       {clean_key_sql('artists')} AS artist_clean, {first_artist_sql('artists')} AS artist_first_clean,
       coalesce(CAST(track_name AS VARCHAR), 'nan') AS feature_title, coalesce(CAST(artists AS VARCHAR), 'nan') AS feature_artists,
       coalesce(lower({_strip('CAST(track_genre AS VARCHAR)')}), 'nan') AS track_genre,
       {', '.join(f'CAST({c} AS DOUBLE) AS {c}' if c in ('valence', 'energy', 'danceability', 'loudness') else f'CAST(NULL AS DOUBLE) AS {c}' for c in M.AUDIO_COLS)}
FROM features_raw""")
for _i, (_m, _keys) in enumerate(M.METHODS):
    O.part(f"fl_{_i}", ("fr_keys",), f"""
SELECT * EXCLUDE (ordinal) FROM fr_keys WHERE {' AND '.join(f"{k} IS NOT NULL AND {k} <> ''" for k in _keys)}
QUALIFY row_number() OVER (PARTITION BY {', '.join(_keys)} ORDER BY ordinal) = 1""")


def _pick(col):
    return ("CASE " + " ".join(f"WHEN f{i}.valence IS NOT NULL THEN f{i}.{col}" for i in range(3)) + " END")


O.part("cascade", ("chart_f", "fl_0", "fl_1", "fl_2"), f"""
SELECT c.*, CASE WHEN f0.valence IS NOT NULL THEN 'track_id' WHEN f1.valence IS NOT NULL THEN 'title_artist'
                 WHEN f2.valence IS NOT NULL THEN 'title_first_artist' END AS merge_method,
       {', '.join(f'{_pick(x)} AS {x}' for x in M.FEATURE_COLS if x != 'track_genre')},
       lower({_strip(f"coalesce({_pick('track_genre')}, 'unknown')")}) AS track_genre,
       {first_artist_sql('c.artist')} AS artist_first
FROM chart_f c
LEFT JOIN fl_0 f0 ON c.track_id = f0.track_id
LEFT JOIN fl_1 f1 ON c.title_clean = f1.title_clean AND c.artist_clean = f1.artist_clean
LEFT JOIN fl_2 f2 ON c.title_clean = f2.title_clean AND c.artist_first_clean = f2.artist_first_clean""")


def cascade(spark, sf):
    return M.cascade_match(charts_filtered(spark, sf), M.feature_lookups(X.features_raw(spark, sf), FEATURE_ORDER))


@query("cascade_match", O.build("SELECT * FROM cascade", "cascade"))
def cascade_match(spark, sf):
    """Three-key cascading feature match with provenance."""
    return cascade(spark, sf)


@query("match_methods", O.build("SELECT merge_method, count(*) AS n FROM cascade GROUP BY merge_method", "cascade"))
def match_methods(spark, sf):
    """Rows per match method (unmatched rows as NULL)."""
    return cascade(spark, sf).groupBy("merge_method").agg(F.count(F.lit(1)).alias("n"))


@query("sql_match", O.build(f"""
SELECT c.*, coalesce(f0.valence, f1.valence) AS valence, coalesce(f0.energy, f1.energy) AS energy,
       coalesce(f0.danceability, f1.danceability) AS danceability, coalesce(f0.acousticness, f1.acousticness) AS acousticness,
       lower({_strip("coalesce(f0.track_genre, f1.track_genre, 'unknown')")}) AS track_genre,
       CASE WHEN f0.valence IS NOT NULL THEN 'track_id' WHEN f1.valence IS NOT NULL THEN 'title_artist' END AS merge_method,
       {first_artist_sql('c.artist')} AS artist_first
FROM chart_f c LEFT JOIN fl_0 f0 ON c.track_id = f0.track_id
LEFT JOIN fl_1 f1 ON c.title_clean = f1.title_clean AND c.artist_clean = f1.artist_clean""", "chart_f", "fl_0", "fl_1"))
def sql_match(spark, sf):
    """Two-key match with per-column COALESCE."""
    return M.sql_style_match(charts_filtered(spark, sf), M.feature_lookups(X.features_raw(spark, sf), FEATURE_ORDER))


# -- G10 J9 P8 P9: popularity enrichment ---------------------------------------
@query("popularity_enrich", O.build(f"""
SELECT f.* EXCLUDE (tid), p.rank, p.streams FROM (SELECT *, {uri_tail_sql('track_url')} AS tid FROM features_raw) f
LEFT JOIN (SELECT {uri_tail_sql('url')} AS tid, avg(rank) AS rank, avg(streams) AS streams
           FROM charts_raw WHERE url IS NOT NULL GROUP BY 1) p ON f.tid = p.tid""", "features_raw", "charts_raw"))
def popularity_enrich(spark, sf):
    """Per-URI means of the chart numbers joined to the lookup by URI tail."""
    pop = X.charts_raw(spark, sf).select("url", "country", "rank", "streams")
    return M.popularity_enrich(X.features_raw(spark, sf), pop, "url", "track_url")


@query("popularity_by_country", O.build(f"""
SELECT s.*, p.streams AS streams_pop, p.price FROM (
  SELECT track_id, 'Home' AS market, sum(streams) AS streams FROM chart_f WHERE track_id IS NOT NULL GROUP BY track_id) s
LEFT JOIN (SELECT tid, country_key, avg(streams) AS streams, avg(price) AS price FROM (
             SELECT {uri_tail_sql('url')} AS tid, lower({_strip('country')}) AS country_key, streams, price FROM charts_raw WHERE url IS NOT NULL
             UNION ALL
             SELECT {uri_tail_sql("replace(url, 'spotify:track:', 'https://open.spotify.com/track/') || '/'")}, lower({_strip('country')}), streams * 2, price
             FROM charts_raw WHERE url IS NOT NULL) GROUP BY 1, 2) p
  ON s.track_id = p.tid AND lower(s.market) = p.country_key""", "chart_f", "charts_raw"))
def popularity_by_country(spark, sf):
    """Composite key (URI tail, country), two spellings of each URI, a column on both sides."""
    raw = X.charts_raw(spark, sf).select("url", "country", "streams", "price")
    web = raw.select(F.concat(F.replace(F.col("url"), F.lit("spotify:track:"), F.lit("https://open.spotify.com/track/")), F.lit("/")).alias("url"),
                     "country", (F.col("streams") * 2).alias("streams"), "price")
    songs = charts_filtered(spark, sf).where(F.col("track_id").isNotNull()).groupBy("track_id").agg(
        F.lit("Home").alias("market"), F.sum("streams").alias("streams"))
    return M.popularity_enrich(songs, raw.unionByName(web), "url", "track_id", "country", "market")


# -- E1: filter -> cascade -> daily summary --------------------------------------
O.part("matched_songs", ("cascade",), "SELECT * EXCLUDE (date), TRY_CAST(date AS DATE) AS date FROM cascade")
O.daily("matched", "matched_songs", M.AUDIO_COLS[1:])


@query("matched_daily_summary", O.build("SELECT * FROM matched_daily", "matched_daily"))
def matched_daily_summary(spark, sf):
    """The daily summary of the matched chart rows (filter -> cascade -> per day)."""
    songs = cascade(spark, sf).withColumn("date", DT.to_date_lenient("date"))
    return D.daily_summary(cut_lineage(songs.select("date", "rank", "streams", *M.AUDIO_COLS)))


# -- G6: no streams at all -> rank weights ---------------------------------------
O.part("unstreamed_songs", ("song_day",), "SELECT * EXCLUDE (streams), CAST(NULL AS DOUBLE) AS streams FROM song_day")
O.daily("unstreamed", "unstreamed_songs", ("energy",))


@query("rank_weight_summary", O.build("SELECT * FROM unstreamed_daily", "unstreamed_daily"))
def rank_weight_summary(spark, sf):
    """The daily summary of a chart without stream numbers (rank weights)."""
    songs = X.song_day(spark, sf).withColumn("streams", F.lit(None).cast("double"))
    return D.daily_summary(songs, ["energy"])
