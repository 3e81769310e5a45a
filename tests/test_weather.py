import datetime as dt

import pytest
from pyspark.sql import functions as F

from skytune.operators import weather as W
from skytune.operators.dedup import keep_first


def days(n, start=dt.date(2020, 1, 1)):
    return [start + dt.timedelta(days=i) for i in range(n)]


def test_keep_first_is_deterministic_with_tiebreak(spark):
    df = spark.createDataFrame([("k", 2, 1, "b"), ("k", 1, 2, "c"), ("k", 1, 1, "a"), ("j", 5, 0, "z")],
                               "key string, o int, t int, v string")
    got = {r.key: r.v for r in keep_first(df, ["key"], ["o", "t"]).collect()}
    assert got == {"k": "a", "j": "z"}


def test_calendar_fills_gaps_and_station_mean(spark):
    d = days(4)
    rows = [("s1", d[0], 1.0, 2.0, 1), ("s1", d[0], 9.0, 9.0, 2), ("s2", d[0], 3.0, None, 3),
            ("s1", d[3], 0.0, 1.0, 4), ("s1", dt.date(2019, 1, 1), 5.0, 5.0, 5)]
    readings = spark.createDataFrame(rows, "station string, date date, prcp double, tsun double, ordinal long")
    span = spark.createDataFrame([(d[0],), (d[3],)], "date date")
    out = {r.date: r for r in W.weather_calendar(readings, span, "station", ["ordinal"]).collect()}
    assert sorted(out) == d
    assert out[d[0]].prcp == 2.0 and out[d[0]].tsun == 2.0     # first reading per station, mean over stations
    assert out[d[1]].prcp is None


def test_weather_types_missing_prcp_is_dry_and_flags_false(spark):
    rows = [(d, p, t) for d, p, t in zip(days(5), [0.0, 2.0, None, 6.0, 0.1], [10.0, 1.0, 5.0, None, 9.0])]
    w = W.weather_types(spark.createDataFrame(rows, "date date, prcp double, tsun double"))
    got = {r.date: r for r in w.collect()}
    r = got[days(5)[2]]
    assert (r.rainy_day, r.heavy_rain, r.dry_day, r.rain_dry_type) == (False, False, False, "Droog")
    assert got[days(5)[3]].heavy_rain is True and got[days(5)[1]].strict_weather_type == "Strict regenachtig"


def test_strict_thresholds_infinite_when_tsun_empty(spark):
    df = spark.createDataFrame([(d, 1.0, None) for d in days(3)], "date date, prcp double, tsun double")
    th = {r.threshold: r.value for r in W.strict_thresholds(df).collect()}
    assert th["tsun_low_quantile_40"] == float("inf") and th["tsun_high_quantile_60"] == float("-inf")


def _bench(spark, rows, min_days=20):
    df = spark.createDataFrame(rows, "date date, prcp double, tsun double")
    b = W.weather_benchmark(df, min_days, keep_thresholds=True)
    return b.select("benchmark_version").first()[0], b


def test_benchmark_prcp_only_fallback(spark):
    rows = [(d, p, None) for d, p in zip(days(40), [0.0] * 20 + [3.0] * 20)]
    version, b = _bench(spark, rows)
    assert version == "prcp_only_fallback"
    assert b.where("good_weather").count() == 20 and b.where("bad_weather").count() == 20


def test_benchmark_relaxes_when_groups_small(spark):
    rows = [(d, p, t) for d, p, t in zip(days(30), [0.0] * 15 + [2.0] * 15, [float(i) for i in range(30)])]
    version, b = _bench(spark, rows)
    assert version == "relaxed_prcp_and_tsun_due_to_low_n"
    assert b.select("tsun_good_min").first()[0] == pytest.approx(14.5)


def test_benchmark_strict_and_exclusive(spark):
    rows = [(d, 0.0, 100.0) for d in days(30)] + [(d, 5.0, 0.0) for d in days(30, dt.date(2021, 1, 1))] \
        + [(d, 1.0, 50.0) for d in days(30, dt.date(2022, 1, 1))]
    version, b = _bench(spark, rows)
    assert version == "strict_prcp_and_tsun"
    assert b.where(F.col("good_weather") & F.col("bad_weather")).count() == 0
    assert b.where("good_bad_weather_type = 'Zonnig/goed weer'").count() == 30
