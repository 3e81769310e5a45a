"""CSV sources, sinks and the daily cache, against hand-made files."""

import datetime as dt

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from skytune import session
from skytune.operators import match as M
from skytune.sources import csv as C
from skytune.sources import sinks
from skytune.sources.cache import DailyCache


def put(folder, name, text):
    (folder / name).write_text(text, encoding="utf-8")
    return str(folder / name)


@pytest.mark.parametrize("raw,tidy", [("Track Name", "track_name"), ("  URL / id ", "url_id"), ("A--b__C", "a_b_c"), ("é", "")])
def test_tidy_name(raw, tidy):
    assert C.tidy_name(raw) == tidy


def test_find_role():
    assert C.find_role(["my_track", "track_name", "title"], ["title", "track_name"]) == "title"
    assert C.find_role(["xx_title_xx", "a"], ["title"]) == "xx_title_xx"
    assert C.find_role(["Track Title", "Title"], ["title"]) == "Title"
    assert C.find_role(["a"], ["title"]) is None
    assert C.find_role(["DATE", "date2"], ["date"], "caseless") == "DATE"
    assert C.find_role(["date2"], ["date"], "caseless") is None
    assert C.find_role(["Spotify_URI", "x"], ["uri"], "part") == "Spotify_URI"
    with pytest.raises(ValueError, match="title"):
        C.roles_of(["date"], {"date": ["date"], "title": ["title"]}, set())


def test_quotes_and_line_breaks_in_fields(spark, tmp_path):
    path = put(tmp_path, "c.csv", 'Date,Rank,Country,Title,Artist,Streams\n2020-01-01,1,Home,"Say ""Hi"", now","A\nB",10\n2020-01-02,2,Home,plain,C,x\n')
    rows = C.charts_from_csv(spark, path).orderBy(*C.FILE_ORDER).collect()
    assert [(r.date_raw, r["rank"], r.title, r.artist, r.streams) for r in rows] == [
        ("2020-01-01", "1", 'Say "Hi", now', "A\nB", "10"), ("2020-01-02", "2", "plain", "C", "x")]


def test_files_with_other_headers_go_by_name(spark, tmp_path):
    put(tmp_path, "a.csv", "date,rank,country,title,artist\n2020-01-01,1,Home,t1,a1\n")
    put(tmp_path, "b.csv", "rank,date,artist,title,country,chart\n2,2020-01-02,a2,t2,Home,Top 200\n")
    rows = C.charts_from_csv(spark, str(tmp_path)).orderBy(*C.FILE_ORDER).collect()
    assert [(r.date_raw, r["rank"], r.title, r.artist, r.chart, r.url) for r in rows] == [
        ("2020-01-01", "1", "t1", "a1", None, None), ("2020-01-02", "2", "t2", "a2", "Top 200", None)]


def test_a_chart_column_is_only_asked_for_where_there_is_one(spark, tmp_path):
    path = put(tmp_path, "c.csv", "date,rank,country,title,artist\n2020-01-01,1,Home,t,a\n2020-01-01,2,home ,u,a\n2020-01-01,3,Away,v,a\n")
    df = C.charts_from_csv(spark, path)
    assert "chart" not in df.columns and M.chart_filter(df, "home", C.FILE_ORDER).count() == 2
    path = put(tmp_path, "d.csv", "date,rank,country,title,artist,chart\n2020-01-01,1,Home,t,a,viral50\n2020-01-01,2,home,u,a,TOP200\n")
    assert [r.title for r in M.chart_filter(C.charts_from_csv(spark, path), "home", C.FILE_ORDER).collect()] == ["u"]


def test_the_first_row_of_the_files_wins(spark, tmp_path):
    put(tmp_path, "2.csv", "date,rank,country,title,artist,streams\n2020-01-01,1,Home,T,A,300\n")
    put(tmp_path, "1.csv", "date,rank,country,title,artist,streams\n" + "".join(f"2020-01-01,1,Home,t,a,{i}\n" for i in range(100, 140)))
    row, = M.chart_filter(C.charts_from_csv(spark, str(tmp_path)).repartition(5), "home", C.FILE_ORDER).collect()
    assert row.streams == 100


def test_features_and_weather(spark, tmp_path):
    path = put(tmp_path, "f.csv", "Track Name;Artists;Valence;Energy;uri\nx;a;0.5;bad;spotify:track:1\ny;b;;0.25;\n")
    rows = C.features_from_csv(spark, path, sep=";").orderBy(*C.FILE_ORDER).collect()
    assert [(r.track_name, r.artists, r.valence, r.energy, r.track_url, r.track_genre, r.tempo) for r in rows] == [
        ("x", "a", 0.5, None, "spotify:track:1", "unknown", None), ("y", "b", None, 0.25, None, "unknown", None)]
    put(tmp_path, "w1.csv", "timestamp,PRECIP_QUANTITY,sun_duration,code\n2020-01-01T00:00:00,1.5,60, 6447 \n2020-02-31,1,1,6447\n")
    put(tmp_path, "w2.csv", "code,timestamp,sun_duration,precip_quantity\n6447,2021-01-01,,0\n")
    rows = C.station_weather_from_csv(spark, [str(tmp_path / "w1.csv"), str(tmp_path / "w2.csv")]).orderBy(*C.FILE_ORDER).collect()
    assert [(r.station, r.date, r.prcp, r.tsun) for r in rows] == [
        ("6447", dt.date(2020, 1, 1), 1.5, 60.0), ("6447", None, 1.0, 1.0), ("6447", dt.date(2021, 1, 1), 0.0, None)]


def test_sinks_write_what_is_read_back(spark, tmp_path):
    df = spark.createDataFrame([(dt.date(2020, 1, i), i / 3, f"x{i}") for i in range(1, 6)], "date date, v double, g string")
    sinks.write_many(df, [("parquet", str(tmp_path / "p")), ("csv", str(tmp_path / "c"))])
    assert sorted(spark.read.parquet(str(tmp_path / "p")).collect()) == sorted(df.collect())
    back = spark.read.option("header", True).csv(str(tmp_path / "c")).orderBy("date").collect()
    assert [(r.date, float(r.v), r.g) for r in back] == [(f"2020-01-0{i}", i / 3, f"x{i}") for i in range(1, 6)]
    sinks.write_table(df, str(tmp_path / "by"), partition_by=["g"])
    assert spark.read.parquet(str(tmp_path / "by")).where("g = 'x3'").count() == 1
    paths = sinks.write_result_set({"one": df, "two": df.limit(2)}, str(tmp_path / "set"))
    assert [spark.read.parquet(p).count() for p in paths] == [5, 2]


def test_cache_appends_new_days_once(spark, tmp_path):
    cache = DailyCache(spark, str(tmp_path / "cache"))
    day = lambda i, v: (dt.date(2020, 1, i), v)
    frame = lambda rows: spark.createDataFrame(rows, "date date, prcp double")
    with pytest.raises(FileNotFoundError):
        cache.read_range("2020-01-01", "2020-01-31")
    assert cache.append(frame([day(1, 2.0), day(1, 1.0), day(2, 5.0), (None, 1.0)])) == 2
    assert cache.append(frame([day(2, 9.0), day(3, 7.0)])) == 1
    assert cache.append(frame([day(3, 9.0)])) == 0
    assert [(r.date.day, r.prcp) for r in cache.read_range("2020-01-01", "2020-01-31").orderBy("date").collect()] == [(1, 1.0), (2, 5.0), (3, 7.0)]
    assert cache.completeness("2020-01-01", "2020-01-04").first().complete
    assert not cache.completeness("2020-01-01", "2020-01-31").first().complete


def test_a_failing_read_is_not_an_empty_cache(spark, tmp_path):
    (tmp_path / "cache").mkdir()
    put(tmp_path / "cache", "part-0.parquet", "this is no parquet")
    with pytest.raises(Exception) as e:
        DailyCache(spark, str(tmp_path / "cache")).append(spark.createDataFrame([(dt.date(2020, 1, 1), 1.0)], "date date, v double"))
    assert not isinstance(e.value, AnalysisException) or e.value.getCondition() != "PATH_NOT_FOUND"


def test_a_cluster_needs_a_shared_folder():
    session.require_local("local[4]")
    session.require_local("local")
    for master in ("yarn", "k8s://x", "spark://h:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            session.require_local(master)


def test_new_data_under_the_same_path_is_seen(spark, tmp_path):
    path = str(tmp_path / "t")
    build = lambda: spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n"))
    spark.range(3).write.parquet(path)
    assert session.materialize_once(spark, ("probe",), build, (path,)).first().n == 3
    first = session.materialize_once(spark, ("probe",), build, (path,))
    assert first is session.materialize_once(spark, ("probe",), build, (path,))
    spark.range(5).write.mode("overwrite").parquet(path)
    assert session.materialize_once(spark, ("probe",), build, (path,)).first().n == 5


def test_csv_sink_keeps_text_as_it_is(spark, tmp_path):
    rows = [(1, " lead"), (2, "trail "), (3, 'say "hi", you'), (4, "back\\slash"), (5, None), (6, "a\nb")]
    sinks.write_table(spark.createDataFrame(rows, "i int, t string"), str(tmp_path / "c"), "csv")
    assert sorted((int(r.i), r.t) for r in C.read_text_csv(spark, str(tmp_path / "c")).select("i", "t").collect()) == rows
