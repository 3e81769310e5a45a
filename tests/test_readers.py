"""Lenient dates, the header catalogue, the sample and the comparison guard."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from skytune.functions import datetext as DX
from skytune.operators import weather as W
from skytune.operators.sample import bottom_k
from skytune.sources import csv as C

D = dt.date(2020, 3, 4)
SAME = ["2020-03-04", " 2020/3/4 ", "2020.03.04", "20200304", "4 March 2020", "4 Mar 2020", "4th mar. 2020", "March 4, 2020", "Mar 4 2020", "MARCH 4th, 2020",
        "4-Mar-2020", "4-Mar-20", "2020-Mar-04", "Wed, 4 Mar 2020", "Wednesday, March 4, 2020", "2020-03-04T10:20:30Z", "2020-03-04 10:20:30.123456+02:00",
        "2020-03-04 10:20", "2020-03-04 10:20 PM", "4 Mar 2020 at noon"]


def parsed(spark, texts, **how):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(3)
    return [r.date for r in DX.with_dates(df, "t", **how).orderBy("i").collect()]


def test_spellings_of_a_day(spark):
    assert parsed(spark, SAME) == [D] * (len(SAME) - 1) + [None]


def test_the_column_votes_on_day_and_month(spark):
    both = "03/04/2020"
    assert parsed(spark, [both]) == [dt.date(2020, 3, 4)]
    assert parsed(spark, [both], tie_dayfirst=True) == [dt.date(2020, 4, 3)]
    assert parsed(spark, [both, "25/12/2020", "26.12.20"]) == [dt.date(2020, 4, 3), dt.date(2020, 12, 25), dt.date(2020, 12, 26)]
    # a text that fits one order only is read by that, whatever the vote
    assert parsed(spark, [both, "12/25/2020", "12-26-2020", "27/12/2020"]) == [D, dt.date(2020, 12, 25), dt.date(2020, 12, 26), dt.date(2020, 12, 27)]


def test_centuries_and_what_is_no_date(spark):
    texts = ["1/2/68", "1/2/69", "2020-02-30", "31/31/2020", "13 Foo 2020", "Ma 4 2020", "0/1/2020", "tomorrow", "", None, "2020", "1e5", "12:30"]
    assert parsed(spark, texts) == [dt.date(2068, 1, 2), dt.date(1969, 1, 2)] + [None] * 11
    assert parsed(spark, []) == []


def put(folder, name, data):
    (folder / name).write_bytes(data.encode() if isinstance(data, str) else data)


def test_headers_of_many_files_in_one_job(spark, tmp_path):
    for i in range(40):
        put(tmp_path, f"a{i:02}.csv", "x,y\n1,2\n3,4\n" if i % 2 else "\n \ny,x,z\r\n1,2,3\r\n")
    put(tmp_path, "empty.csv", "")
    put(tmp_path, "quoted.csv", '"a,b","two\nlines","say ""hi"""\n1,2,3\n')
    put(tmp_path, "odd.csv", b"\xef\xbb\xbfk,,k\n1,2,3\n")
    got = C.headers(spark, str(tmp_path))
    assert {h: len(f) for h, f in got.items()} == {("x", "y"): 20, ("y", "x", "z"): 20, ("a,b", "two\nlines", 'say "hi"'): 1, ("k0", "_c1", "k2"): 1}
    rows = C.read_text_csv(spark, [str(tmp_path / f"a{i:02}.csv") for i in range(40)], embedded_newlines=False)
    assert rows.groupBy("x", "y", "z").count().where("z IS NULL").agg(F.sum("count")).first()[0] == 40
    assert rows.where("z = '3'").count() == 20
    with pytest.raises(FileNotFoundError):
        C.read_text_csv(spark, str(tmp_path / "empty.csv"))


def test_a_header_is_found_in_the_first_block_only(spark, tmp_path):
    put(tmp_path, "big.csv", "a,b\n" + "1,2\n" * 50_000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert list(C.headers(spark, str(tmp_path))) == [("a", "b")]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_sample_does_not_follow_the_layout(spark):
    df = spark.range(5000).select(F.col("id"), (F.col("id") % 7).alias("g"))
    got = [sorted(r.id for r in bottom_k(df.repartition(p), ["id"], 50).collect()) for p in (1, 7, 200)]
    assert got[0] == got[1] == got[2] and len(set(got[0])) == 50
    assert len({i * 10 // 5000 for i in got[0]}) >= 8                 # spread over the table
    assert [r.id for r in bottom_k(df.repartition(9), ["id"], 3, order=["id"]).collect()] == [0, 1, 2]
    assert bottom_k(df.limit(0), ["id"], 5).collect() == [] and bottom_k(df.where("id < 3"), ["id"], 5).count() == 3
    same = spark.createDataFrame([(None, 1)] * 9, "k string, v int").repartition(3)
    assert bottom_k(same, ["k"], 4).count() == 4


def test_a_comparison_needs_its_groups(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "extreme_group string, v int")
    assert W.compared(df).count() == 2
    with pytest.raises(ValueError, match="1 of 2 groups"):
        W.compared(df.where("v <> 2"))
    with pytest.raises(ValueError, match="no day"):
        W.compared(df.where("v = 3"))


def test_a_date_text_is_read_once(spark):
    texts = ["03/04/2020", "25/04/2020", None, "no date", "2020-01-05T10:00:00"]
    df = spark.createDataFrame([(i, texts[i % 5]) for i in range(100)], "i int, t string")
    out = DX.with_dates(df, "t")
    assert out.columns == ["i", "t", "date"] and out.count() == 100
    want = {"03/04/2020": dt.date(2020, 4, 3), "25/04/2020": dt.date(2020, 4, 25), "2020-01-05T10:00:00": dt.date(2020, 1, 5)}
    assert {(r.t, r.date) for r in out.collect()} == {(t, want.get(t)) for t in texts}
    assert "RLIKE" not in out._jdf.queryExecution().optimizedPlan().toString()
