"""Chart filtering and feature matching.

Texts are cleaned once per distinct value, not once per chart row: a date's
spelling, a song's title, artist and URL come back on most rows of a chart.
The cascade matches distinct songs, not chart rows, and all its steps in one
join against de-duplicated lookups (unique per key).  Lookups and matches are not
broadcast by hint: AQE turns a join into a broadcast only when the measured size
is under the threshold, and splits a skewed chart-side partition (a hot song)
otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import clean_raw_date, normalize_date_text, slash_votes, vote_label
from ..functions.nulls import flag, to_double
from ..functions.text import clean_key, first_of_key, norm_text_key, track_id, uri_tail
from ..session import cut_lineage
from .dedup import keep_first

# The ten audio features and the match-method labels.
AUDIO_COLS = ("valence", "energy", "danceability", "speechiness", "tempo", "acousticness",
              "instrumentalness", "liveness", "loudness", "popularity")
FEATURE_COLS = ("feature_title", "feature_artists", "track_genre") + AUDIO_COLS
METHODS = (("track_id", ("track_id",)), ("title_artist", ("title_clean", "artist_clean")),
           ("title_first_artist", ("title_clean", "artist_first_clean")))


def spellings(df: DataFrame, date_col: str) -> DataFrame:
    """(date_col, _rows): the distinct raw dates and how many rows have each."""
    return df.groupBy(date_col).agg(F.count(F.lit(1)).alias("_rows"))


def date_order_vote(df: DataFrame, date_col: str) -> DataFrame:
    """One row (dayfirst_votes, monthfirst_votes, slash_order) over all
    rows; a spelling is read once and votes with its rows."""
    return _vote(spellings(df, date_col), date_col)


def _vote(spelled: DataFrame, date_col: str) -> DataFrame:
    day, month = slash_votes(date_col, "_rows")
    return spelled.agg(day.alias("dayfirst_votes"), month.alias("monthfirst_votes")).select(
        "*", vote_label(F.col("dayfirst_votes"), F.col("monthfirst_votes")).alias("slash_order"))


SONG_TEXTS = ("title", "artist", "url")


def song_keys(rows: DataFrame) -> DataFrame:
    """The distinct songs (``SONG_TEXTS``) of ``rows`` with their matching keys."""
    songs = rows.select(*SONG_TEXTS).distinct()
    # each key is cleaned once, in a projection of its own; the first artist
    # comes from the cleaned column
    keyed = songs.select(*SONG_TEXTS, clean_key("title").alias("title_clean"), clean_key("artist").alias("artist_clean"),
                         track_id("url").alias("track_id"))
    return keyed.withColumn("artist_first_clean", first_of_key("artist_clean"))


def with_song_keys(rows: DataFrame) -> DataFrame:
    """``rows`` with the matching keys of their songs.  The join sorts by a hash
    of the three texts, and compares the texts where it agrees."""
    hashed = F.xxhash64(*SONG_TEXTS)
    songs = song_keys(rows).withColumn("_song", hashed).withColumnsRenamed({c: f"_{c}" for c in SONG_TEXTS})
    same = F.col("_hash") == F.col("_song")
    for c in SONG_TEXTS:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return rows.withColumn("_hash", hashed).join(songs, same).drop("_hash", "_song", *[f"_{c}" for c in SONG_TEXTS])


def chart_filter(charts: DataFrame, country: str, order: list[str], max_rank: float = 200.0) -> DataFrame:
    """One country's Top-200 rows with ISO date
    text and matching keys; keep-first per (date, rank, title key, artist key).

    The distinct spellings of dates are stored (their number decides whether the
    join with them is a broadcast): they vote, and give each row its date."""
    spelled = cut_lineage(spellings(charts, "date_raw"))
    vote = F.broadcast(_vote(spelled, "date_raw").select("slash_order"))
    dates = spelled.crossJoin(vote).select(F.col("date_raw").alias("_raw"), "slash_order", clean_raw_date("date_raw").alias("_ds")).select(
        "_raw", normalize_date_text(F.col("_ds"), F.col("slash_order"), cleaned=True).alias("date"))
    c = charts.where(norm_text_key("country") == country.strip().lower())
    if "chart" in c.columns:          # a source without that column holds one chart
        chart_text = F.lower(F.col("chart").cast("string"))
        c = c.where(flag(chart_text.contains("top") & chart_text.contains("200") & ~chart_text.contains("viral")))
    c = c.withColumn("rank", to_double("rank")).where(F.col("rank").between(1, max_rank))
    c = c.join(cut_lineage(dates.where(F.col("date").isNotNull())), F.col("date_raw") == F.col("_raw"))
    rows = c.select("date", "rank", F.col("title").cast("string").alias("title"), F.col("artist").cast("string").alias("artist"),
                    "url", to_double("streams").alias("streams"), *order)
    keyed = with_song_keys(rows).select("date", "rank", "title", "artist", "title_clean", "artist_clean", "artist_first_clean",
                                        "track_id", "streams", *order)
    out = keep_first(keyed, ["date", "rank", "title_clean", "artist_clean"], order)
    return out.drop(*order)


def feature_lookups(features: DataFrame, order: list[str]) -> dict[str, DataFrame]:
    """three keep-first lookups (by id; by title+artist; by title+first
    artist), blanks excluded.  Columns: key(s) + FEATURE_COLS."""
    audio = [to_double(c).alias(c) if c in features.columns else F.lit(None).cast("double").alias(c)
             for c in AUDIO_COLS]
    f = features.select(
        track_id("track_url").alias("track_id"), clean_key("track_name").alias("title_clean"),
        clean_key("artists").alias("artist_clean"),
        F.coalesce(F.col("track_name").cast("string"), F.lit("nan")).alias("feature_title"),
        F.coalesce(F.col("artists").cast("string"), F.lit("nan")).alias("feature_artists"),
        F.coalesce(F.lower(F.regexp_replace(F.col("track_genre").cast("string"), r"^\s+|\s+$", "")),
                   F.lit("nan")).alias("track_genre"),
        *audio, *order)
    # cleaned once and stored: three lookups read it
    f = cut_lineage(f).withColumn("artist_first_clean", first_of_key("artist_clean"))
    out = {}
    for method, keys in METHODS:
        ok = F.lit(True)
        for k in keys:
            ok = ok & F.col(k).isNotNull() & (F.col(k) != "")
        sub = f.where(ok).select(*keys, *FEATURE_COLS, *order)
        out[method] = keep_first(sub, list(keys), order).select(*keys, *FEATURE_COLS)
    return out


def spread_blanks(key: Column, *row: Column) -> Column:
    """A missing or blank key matches nothing: as one of 1024 values that no
    lookup holds, such rows do not all meet in one task of a join."""
    other = F.concat(F.lit("\x00"), F.pmod(F.xxhash64(*row), F.lit(1024)).cast("string"))
    return F.when(key.isNull() | (key == ""), other).otherwise(key)


def lookup_entries(lookups: dict[str, DataFrame]) -> DataFrame:
    """All lookups as one table ``(step, k1, k2, match)``: the keys of a step of
    the cascade and what it fills in.  Rows without a valence match nothing."""
    frames = []
    for step, (method, keys) in enumerate(METHODS):
        names = [F.col(k) for k in keys] + [F.lit("")] * (2 - len(keys))
        frames.append(lookups[method].where(F.col("valence").isNotNull()).select(
            F.lit(step).alias("step"), names[0].alias("k1"), names[1].alias("k2"),
            F.struct(F.lit(method).alias("merge_method"), *[F.col(x) for x in FEATURE_COLS]).alias("match")))
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


SONG_KEYS = ("track_id", "title_clean", "artist_clean", "artist_first_clean")


def match_songs(songs: DataFrame, lookups: dict[str, DataFrame]) -> DataFrame:
    """``songs`` (distinct rows of ``SONG_KEYS``) that match, with the ``match``
    of their first step: every song sends its keys of all steps at once, and the
    lowest step that finds something wins."""
    steps = F.array(*[
        F.struct(F.lit(step).alias("step"), F.col(keys[0]).alias("k1"), (F.col(keys[1]) if len(keys) > 1 else F.lit("")).alias("k2"))
        for step, (_, keys) in enumerate(METHODS)])
    sent = songs.select(*SONG_KEYS, F.inline(steps)).where((F.col("k1") != "") & ((F.col("step") == 0) | (F.col("k2") != "")))
    found = sent.join(lookup_entries(lookups), ["step", "k1", "k2"])
    return found.groupBy(*SONG_KEYS).agg(F.min_by("match", "step").alias("match"))


def cascade_match(charts: DataFrame, lookups: dict[str, DataFrame]) -> DataFrame:
    """Fill features by id, then title+artist, then title+first artist.

    A lookup row whose valence is NULL is not a match (the cascade goes on);
    all features of a row come from the same matched lookup row, and
    ``merge_method`` records which key matched.

    A song stays in a chart for many days and is matched once: the distinct key
    combinations go through one join with all lookups (``match_songs``), then the
    chart rows, stored first since they are read twice, meet the result in one
    join - the only shuffle they may take part in."""
    charts = cut_lineage(charts)
    keys = {k: F.coalesce(F.col(k), F.lit("")).alias(k) for k in SONG_KEYS}
    matched = match_songs(charts.select(*keys.values()).distinct(), lookups)
    matched = matched.select(F.xxhash64(*SONG_KEYS).alias("_song"), *[F.col(k).alias(f"_{k}") for k in SONG_KEYS], "match",
                             F.lower(F.regexp_replace(F.col("match")["track_genre"], r"^\s+|\s+$", "")).alias("_genre"))
    none = F.lit(True)
    for k in keys.values():
        none = none & (k == "")
    # rows without any key match nothing: a hash of the whole row spreads them
    hashed = F.when(none, F.xxhash64(*charts.columns)).otherwise(F.xxhash64(*keys.values()))
    cond = F.col("_hash") == F.col("_song")
    for k in SONG_KEYS:
        cond = cond & (keys[k] == F.col(f"_{k}"))
    c = charts.withColumn("_hash", hashed).join(matched, cond, "left")
    m = F.col("match")
    return c.select(
        *charts.columns, m["merge_method"].alias("merge_method"),
        *[m[x].alias(x) for x in FEATURE_COLS if x != "track_genre"],
        F.coalesce("_genre", F.lit("unknown")).alias("track_genre"), F.col("artist_first_clean").alias("artist_first"))


SQL_MATCH_COLS = ("valence", "energy", "danceability", "acousticness", "track_genre")


def sql_style_match(charts: DataFrame, lookups: dict[str, DataFrame]) -> DataFrame:
    """Two keys only, per-column COALESCE (columns may mix sources)."""
    a = lookups["track_id"].select(F.col("track_id").alias("_id"), *[F.col(x).alias(f"_a_{x}") for x in SQL_MATCH_COLS])
    b = lookups["title_artist"].select(F.col("title_clean").alias("_t"), F.col("artist_clean").alias("_ar"),
                                       *[F.col(x).alias(f"_b_{x}") for x in SQL_MATCH_COLS])
    row = [charts[x] for x in charts.columns]
    j = charts.join(a, spread_blanks(charts["track_id"], *row) == a["_id"], "left") \
        .join(b, (spread_blanks(charts["title_clean"], *row) == F.col("_t")) & (F.col("artist_clean") == F.col("_ar")), "left")
    cols = [F.coalesce(F.col(f"_a_{x}"), F.col(f"_b_{x}")).alias(x) for x in SQL_MATCH_COLS if x != "track_genre"]
    genre = F.lower(F.regexp_replace(F.coalesce(F.col("_a_track_genre"), F.col("_b_track_genre"), F.lit("unknown")),
                                     r"^\s+|\s+$", "")).alias("track_genre")
    method = (F.when(F.col("_a_valence").isNotNull(), "track_id")
              .when(F.col("_b_valence").isNotNull(), "title_artist")).alias("merge_method")
    return j.select(*charts.columns, *cols, genre, method, F.col("artist_first_clean").alias("artist_first"))


def popularity_enrich(final: DataFrame, popularity: DataFrame, uri_col: str, final_uri_col: str,
                      country_col: str | None = None, final_country_col: str | None = None) -> DataFrame:
    """Mean of every numeric popularity column per URI tail (and
    country when both sides have one); LEFT JOIN onto ``final``; overlapping
    names get the suffix ``_pop``."""
    both_country = country_col is not None and final_country_col is not None
    numeric = [f.name for f in popularity.schema.fields
               if f.name not in (uri_col, country_col) and f.dataType.typeName() in ("double", "float", "long", "integer")]
    # the right side is reduced to exactly the join keys: spellings of one
    # track's URI share a tail, so no row of ``final`` is ever multiplied
    # a spelling is read once, whatever the number of its rows
    given = [c for c in (uri_col, country_col if both_country else None) if c]
    keyed = popularity.where(F.col(uri_col).isNotNull()).groupBy(*given).agg(*[f(F.col(c).cast("double")).alias(f"_{t}_{c}")
                                                                              for c in numeric for t, f in (("sum", F.sum), ("n", F.count))])
    keyed = keyed.withColumn("_track_id", uri_tail(uri_col))
    left = final.withColumn("_track_id", uri_tail(final_uri_col))
    keys = ["_track_id"]
    if both_country:
        keyed = keyed.withColumn("_country_key", norm_text_key(country_col))
        left = left.withColumn("_country_key", norm_text_key(final_country_col))
        keys.append("_country_key")
    clash = set(final.columns)
    means = keyed.groupBy(*keys).agg(*[F.try_divide(F.sum(f"_sum_{c}"), F.sum(f"_n_{c}")).alias(f"{c}_pop" if c in clash else c) for c in numeric])
    return left.join(means, keys, "left").drop(*keys)
