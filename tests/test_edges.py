"""Inputs at the edge of the library's own operators."""

import datetime as dt
import math
import statistics
import unicodedata

import pytest
from pyspark.sql import functions as F

from skytune.functions import text as TX
from skytune.operators import daily as D
from skytune.operators import match as M
from skytune.operators import ranks as R
from skytune.operators import reshape as RS
from skytune.operators import stattests as S
from skytune.operators import weather as W


@pytest.mark.parametrize("raw,key", [
    ("x²", "x2"), ("ﬁre", "fire"), ("Ａbc", "abc"), ("Ⅳ", "iv"), ("½", "1 2"), ("Rémix Zoë", "remix zoe"), ("ĳs", "ijs"),
    ("été", "ete"), ("①②", "12"), ("㎏", "kg"), ("Ǆ", "dz"), ("𝐚𝐛", "ab"), ("日本", "")])
def test_keys_fold_every_compatible_letter(spark, raw, key):
    assert spark.range(1).select(TX.clean_key(F.lit(raw)).alias("k")).first().k == key


def test_fold_map_is_nfkd_without_marks(spark):
    rng = [c for c in map(chr, range(0xA0, 0x2FFFF, 7)) if unicodedata.category(c) not in ("Cs", "Cn")]
    rows = spark.createDataFrame([(c,) for c in rng], "c string").select("c", TX.strip_accents("c").alias("f")).collect()
    for r in rows:
        want = "".join(x for x in unicodedata.normalize("NFKD", r.c) if not unicodedata.combining(x))
        if any(x.isascii() and x.isalnum() for x in want) or not want:
            assert r.f == want, hex(ord(r.c))


def test_means_of_tiny_and_huge_readings(spark):
    df = spark.createDataFrame([("a", dt.date(2020, 1, 1), 1e-12, 5e14), ("b", dt.date(2020, 1, 1), 3e-12, 7e14)],
                               "station string, date date, prcp double, tsun double")
    row = W.station_daily_mean(df).first()
    assert (row.prcp, row.tsun) == (pytest.approx(2e-12), pytest.approx(6e14))


def test_two_spellings_of_a_uri_do_not_multiply_rows(spark):
    final = spark.createDataFrame([("spotify:track:X", 1.0, "Home"), ("spotify:track:Y", 2.0, "Home")], "uri string, streams double, market string")
    pop = spark.createDataFrame([("spotify:track:X", "home", 10.0), ("https://open.spotify.com/track/X/", " Home", 20.0),
                                 ("spotify:track:X", "away", 99.0)], "uri string, country string, streams double")
    rows = {r.uri: r.streams_pop for r in M.popularity_enrich(final, pop, "uri", "uri", "country", "market").collect()}
    assert rows == {"spotify:track:X": 15.0, "spotify:track:Y": None}
    assert M.popularity_enrich(final, pop, "uri", "uri").where("uri LIKE '%X'").first().streams_pop == 43.0


def test_a_chart_side_without_keys_is_spread(spark):
    charts = spark.createDataFrame([(i, None if i % 2 else "k", "", "") for i in range(2000)],
                                   "rank int, track_id string, title_clean string, artist_clean string")
    parts = charts.select(F.pmod(F.hash(M.spread_blanks(F.col("track_id"), *[F.col(c) for c in charts.columns])), F.lit(200)).alias("p"),
                          "track_id").where("track_id IS NULL")
    assert parts.select("p").distinct().count() > 100


def test_no_variance_inside_groups(spark):
    rows = [("flat", g, v) for g, v in (("a", 1.0), ("b", 2.0)) for _ in range(3)] + [("same", g, 1.0) for g in "ab" for _ in range(3)]
    df = spark.createDataFrame(rows, "k string, g string, v double")
    t = {r.k: r for r in S.two_group_tests(df, ["k"], "g", "v", "a", "b").collect()}
    assert t["flat"].welch_t == -math.inf and t["flat"].welch_p == 0.0
    assert t["same"].welch_t is None and t["same"].welch_p is None
    f = {r.k: r for r in S.anova_kruskal(df, ["k"], "g", "v").collect()}
    assert f["flat"].anova_f == math.inf and f["flat"].anova_p == 0.0 and f["same"].anova_f is None


def test_side_is_the_sign(spark):
    df = spark.createDataFrame([("f", "x", 0.9), ("f", "y", 0.2), ("f", "z", -0.1)], "fam string, lab string, r double")
    assert {r.lab: r.side for r in RS.top_bottom_k(df, ["fam"], "lab", "r", 6).collect()} == {"x": "positive", "y": "positive", "z": "negative"}


def test_an_outlier_does_not_fill_one_bucket(spark):
    df = spark.range(20_000).select(F.lit("k").alias("k"), F.when(F.col("id") == 7, 1e9).otherwise(F.col("id").cast("double")).alias("v"))
    cum = R.cumulative_counts(df, ["k"], "v", buckets=64, keep_bucket=True)
    sizes = [r["count"] for r in cum.groupBy("_b").count().collect()]
    assert len(sizes) > 50 and max(sizes) < 4 * 20_000 / 64
    assert cum.agg(F.max("_end")).first()[0] == 20_000


def test_quantiles_are_exact_whatever_the_values(spark):
    values = [1e9, -5.0, 0.0, 0.0, 0.1, 0.1, 0.1, 3.5, 2.25, -1e9, 7.0]
    df = spark.createDataFrame([("k", float(v)) for v in values], "k string, v double")
    row = R.exact_quantiles(df, ["k"], "v", {"m": 0.5, "q": 0.25}, buckets=4).first()
    assert row.m == statistics.median(values) and row.q == pytest.approx(statistics.quantiles(values, n=4, method="inclusive")[0])


def test_day_medians_use_no_buffer_of_a_day(spark):
    df = spark.createDataFrame([(dt.date(2020, 1, 1), 5.0, float(v), 1) for v in (3, 1, 2, 10)] + [(dt.date(2020, 1, 2), 1.0, None, 1)],
                               "date date, streams double, valence double, rank int")
    for out in (D.daily_stream_metrics(df), D.daily_summary(df, [])):
        assert {r.date.day: r.median_valence for r in out.collect()} == {1: 2.5, 2: None}
        assert "median(" not in out._jdf.queryExecution().executedPlan().toString()
