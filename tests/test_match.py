import datetime as dt

from pyspark.sql import functions as F

from skytune.operators import entity as EN
from skytune.operators import match as M

CHARTS = "ordinal long, date_raw string, rank double, country string, chart string, url string, title string, artist string, streams double"
FEATS = "ordinal long, track_url string, track_name string, artists string, track_genre string, valence double, energy double"
TID = "b" * 22


def test_chart_filter_and_keep_first(spark):
    rows = [(1, "13/01/2020", 1.0, " Home ", "Top 200", None, "Song (Live)", "A & B", 10.0),
            (2, "13/01/2020", 1.0, "home", "top 200", None, "SONG", "a and b", 20.0),      # duplicate key: dropped
            (3, "13/01/2020", 2.0, "home", "Viral 50", None, "X", "Y", 1.0),               # viral
            (4, "14/01/2020", 300.0, "home", "Top 200", None, "X", "Y", 1.0),              # rank out of range
            (5, "15/01/2020", 3.0, "away", "Top 200", None, "X", "Y", 1.0),                # other country
            (6, "", 4.0, "home", "Top 200", None, "X", "Y", 1.0)]                          # no date
    out = M.chart_filter(spark.createDataFrame(rows, CHARTS), "home", ["ordinal"]).collect()
    assert len(out) == 1
    r = out[0]
    assert (r.date, r.title_clean, r.artist_clean, r.streams) == ("2020-01-13", "song", "a and b", 10.0)


def test_cascade_skips_null_valence_and_first_wins(spark):
    charts = spark.createDataFrame([
        (1, "2020-01-01", 1.0, "home", "Top 200", f"spotify:track:{TID}", "Hello", "Adele, Guest", 5.0),
        (2, "2020-01-01", 2.0, "home", "Top 200", None, "Other", "Nobody x DJ", 5.0),
        (3, "2020-01-01", 3.0, "home", "Top 200", None, "", "", 5.0)], CHARTS)
    feats = spark.createDataFrame([
        (1, f"https://open.spotify.com/track/{TID}", "Hello", "Adele", "Pop", None, 0.1),   # id match, null valence
        (2, None, "Hello", "Adele, Guest", "pop", 0.2, 0.2),                                 # title+artist: first wins
        (3, None, "Hello", "Adele, Guest", "rock", 0.9, 0.9),
        (4, None, "Other", "Nobody", "Jazz", 0.5, 0.5)], FEATS)
    c = M.chart_filter(charts, "home", ["ordinal"])
    out = {r.rank: r for r in M.cascade_match(c, M.feature_lookups(feats, ["ordinal"])).collect()}
    assert out[1.0].merge_method == "title_artist" and out[1.0].valence == 0.2 and out[1.0].track_genre == "pop"
    assert out[2.0].merge_method == "title_first_artist" and out[2.0].valence == 0.5
    assert out[3.0].merge_method is None and out[3.0].track_genre == "unknown"


def test_sql_style_match_mixes_columns(spark):
    charts = spark.createDataFrame([(1, "2020-01-01", 1.0, "home", "Top 200", f"spotify:track:{TID}", "Hi", "Al", 5.0)], CHARTS)
    feats = spark.createDataFrame([(1, f"spotify:track:{TID}", "zz", "zz", "pop", 0.3, None),
                                   (2, None, "Hi", "Al", "rock", 0.9, 0.7)], FEATS)
    c = M.chart_filter(charts, "home", ["ordinal"])
    r = M.sql_style_match(c, M.feature_lookups(feats, ["ordinal"])).collect()[0]
    assert (r.valence, r.energy, r.merge_method) == (0.3, 0.7, "track_id")


def test_entity_shares_sum_to_one_and_exclusions(spark):
    d = dt.date(2020, 1, 1)
    rows = [(d, "pop", 10.0), (d, "rock", 30.0), (d, "unknown", 5.0), (d, " ", 5.0), (d, "jazz", 0.0), (d, None, 1.0)]
    df = spark.createDataFrame(rows, "date date, g string, analysis_weight double")
    out = {r.g: r.entity_share for r in EN.entity_daily_shares(df, "g").collect()}
    assert out == {"pop": 0.25, "rock": 0.75}


def test_a_song_is_matched_once_and_chart_rows_meet_one_join(spark):
    rows = [(i, f"2020-01-{1 + i % 28:02}", float(1 + i), "home", "Top 200", f"spotify:track:{TID}" if i % 2 else None,
             "Hello" if i % 3 else "", "Adele" if i % 3 else "", 1.0) for i in range(120)]
    feats = spark.createDataFrame([(1, f"spotify:track:{TID}", "x", "y", "pop", 0.1, 0.1), (2, None, "Hello", "Adele", "rock", 0.2, 0.2)], FEATS)
    charts = M.chart_filter(spark.createDataFrame(rows, CHARTS), "home", ["ordinal"])
    out = M.cascade_match(charts, M.feature_lookups(feats, ["ordinal"]))
    got = {r["rank"]: (r.merge_method, r.valence) for r in out.collect()}
    assert got == {float(1 + i): ("track_id", 0.1) if i % 2 else ("title_artist", 0.2) if i % 3 else (None, None) for i in range(120)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 1
    songs = M.match_songs(charts.select(*[F.coalesce(k, F.lit("")).alias(k) for k in M.SONG_KEYS]).distinct(),
                          M.feature_lookups(feats, ["ordinal"]))
    assert songs.count() == 3


def test_empty_charts_and_empty_lookups(spark):
    feats = spark.createDataFrame([], FEATS)
    charts = M.chart_filter(spark.createDataFrame([(1, "2020-01-01", 1.0, "home", "Top 200", None, None, None, 1.0)], CHARTS), "home", ["ordinal"])
    row, = M.cascade_match(charts, M.feature_lookups(feats, ["ordinal"])).collect()
    assert row.merge_method is None and row.track_genre == "unknown"
    assert M.cascade_match(charts.limit(0), M.feature_lookups(feats, ["ordinal"])).collect() == []


def test_each_song_and_date_is_cleaned_once(spark):
    rows = [(i, ("13/01/2020", "2020-01-14", "01/15/2020", None, "")[i % 5], float(1 + i % 7), "home", "Top 200", (None, f"spotify:track:{TID}")[i % 2],
             ("Song (Live)", "SONG", None)[i % 3], ("A & B", None)[i % 2], float(i)) for i in range(210)]
    charts = spark.createDataFrame(rows, CHARTS)
    songs = M.song_keys(charts)
    assert songs.count() == 6
    assert {(r.title, r.artist, r.title_clean, r.artist_clean, r.artist_first_clean) for r in songs.collect()} == {
        (t, a, "song" if t else "", "a and b" if a else "", "a" if a else "") for t in ("Song (Live)", "SONG", None) for a in ("A & B", None)}
    assert M.with_song_keys(charts).count() == 210
    out = M.chart_filter(charts, "home", ["ordinal"])
    found = {}
    for o, d, r, _, _, u, t, a, s in rows:
        # the vote is even, so dates are read day first: 01/15/2020 is none
        key = ({"13/01/2020": "2020-01-13", "2020-01-14": "2020-01-14"}.get(d), r, "song" if t else "", "a and b" if a else "")
        if key[0]:
            found.setdefault(key, (t, a, "a" if a else "", TID if u else None, s))
    assert {(r.date, r["rank"], r.title_clean, r.artist_clean): (r.title, r.artist, r.artist_first_clean, r.track_id, r.streams) for r in out.collect()} == found
    assert out.count() == len(found)


def test_cascade_reads_no_chart_text_again(spark):
    charts = M.chart_filter(spark.createDataFrame([(1, "2020-01-01", 1.0, "home", "Top 200", None, "Hello", "Adele, Guest", 5.0),
                                                   (2, "2020-01-02", 1.0, "home", "Top 200", None, None, None, 5.0)], CHARTS), "home", ["ordinal"])
    out = M.cascade_match(charts, M.feature_lookups(spark.createDataFrame([(1, None, "Hello", "Adele", " Pop ", 0.1, 0.1)], FEATS), ["ordinal"]))
    assert {(r.title, r.artist_first, r.track_genre) for r in out.collect()} == {("Hello", "adele guest", "unknown"), (None, "", "unknown")}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("featuring") == 0


def test_popularity_reads_a_spelling_once(spark):
    pop = spark.createDataFrame([(u, c, p, n) for u, c in (("spotify:track:x", " Home"), ("https://h/track/x/", "home"), ("spotify:track:y", None), (None, "home"))
                                 for p, n in ((1.0, 2), (4.0, 4), (None, None))], "url string, country string, price double, plays long")
    final = spark.createDataFrame([("x", "HOME", 1.0), ("y", "home", 2.0), ("z", "home", 3.0)], "id string, market string, price double")
    out = M.popularity_enrich(final, pop, "url", "id", "country", "market")
    assert {r.id: (r.price, r.price_pop, r.plays) for r in out.collect()} == {"x": (1.0, 2.5, 3.0), "y": (2.0, None, None), "z": (3.0, None, None)}
    assert dict(out.dtypes)["plays"] == "double"
    assert {r.id: r.plays for r in M.popularity_enrich(final, pop, "url", "id").collect()} == {"x": 3.0, "y": 3.0, "z": None}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [url#") == 1               # by spelling, before the tails


def test_entity_names_are_judged_per_day_not_per_row(spark):
    d = dt.date(2020, 1, 1)
    names = ["pop", "NaN", " ", None, "\t", "none", "rock "]
    out = EN.entity_daily_shares(spark.createDataFrame([(d, names[i % 7], 1.0) for i in range(140)], "date date, g string, analysis_weight double"), "g")
    assert {(r.g, r.entity_weight, r.entity_tracks, r.entity_share) for r in out.collect()} == {("pop", 20.0, 20, 0.5), ("rock ", 20.0, 20, 0.5)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "analysis_weight" not in plan                     # rows are gone before names are judged


def test_strip_blanks_is_the_regex(spark):
    from skytune.functions import text as TX
    vals = ["", " ", "a", "\t\n a b \x0b\f\r", " x ", None, "a,", ",b", " A b , c", "no comma\n"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    assert [r[0] for r in df.select(TX.strip_blanks("v")).collect()] == [r[0] for r in df.selectExpr(r"regexp_replace(v, '^\\s+|\\s+$', '')").collect()]
    assert [r[0] for r in df.select(TX.first_artist_simple("v")).collect()] == [None if v is None else v.lower().split(",")[0].strip(" \t\n\x0b\f\r") for v in vals]
