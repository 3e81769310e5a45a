import datetime as dt
import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from skytune.operators import daily as D
from skytune.operators import daystate as DS

SCHEMA = "date date, rank int, streams double, valence double, energy double"


def rows_of(seed, n=600):
    rnd = random.Random(seed)
    maybe = lambda x, p: None if rnd.random() < p else x
    return [(maybe(dt.date(2020, rnd.choice([1, 4, 7]), rnd.randint(1, 3)), 0.02), maybe(rnd.randint(1, 200), 0.1), maybe(rnd.uniform(-5, 100), 0.1),
             maybe(1e6 + rnd.random(), 0.2), maybe(rnd.random(), 0.2)) for _ in range(n)]


def by_date(df):
    return {r.date: r.asDict() for r in df.collect()}


def same(got, want, but=("median_valence",)):
    assert set(got) == set(want)
    for d, w in want.items():
        for c, v in w.items():
            if c not in but:
                assert got[d][c] == (pytest.approx(v, rel=1e-9, abs=1e-9) if isinstance(v, float) else v), (d, c)


def test_extracts_add_up_to_a_full_run(spark, tmp_path):
    df = spark.createDataFrame(rows_of(1), SCHEMA)
    store = DS.DayStates(spark, str(tmp_path / "s"), DS.summary_spec(["energy"]))
    with pytest.raises(FileNotFoundError):
        store.states()
    parts = [df.where(F.pmod(F.hash(*df.columns), F.lit(3)) == i) for i in range(3)]
    store.add("a", parts[0])
    store.add("b", parts[1])
    store.add("b", parts[1])                     # a repeated load counts once
    store.add("c", parts[2])
    same(by_date(DS.summary(store.states(), ["energy"])), by_date(D.daily_summary(df, ["energy"])))


def test_a_failed_load_is_left_out_and_repeated(spark, tmp_path):
    df = spark.createDataFrame(rows_of(2), SCHEMA)
    spec = DS.stream_spec()
    rows = D.stream_rows(df)
    store = DS.DayStates(spark, str(tmp_path / "s"), spec)
    store.add("old", rows.where("streams < 50"))
    store.add("new", rows.where("streams >= 50"))
    os.remove(tmp_path / "s" / "extract=new" / "_SUCCESS")           # killed before it ended
    assert store.extracts()[0].endswith("extract=old") and len(store.extracts()) == 1
    store.add("new", rows.where("streams >= 50"))
    same(by_date(DS.stream_metrics(store.states(), ["date"])), by_date(D.daily_stream_metrics(df)))


def test_a_new_extract_does_not_read_the_old_ones(spark, tmp_path):
    df = spark.createDataFrame(rows_of(3), SCHEMA)
    old, new = str(tmp_path / "old"), str(tmp_path / "new")
    df.where("rank <= 100").write.parquet(old)
    df.where("rank > 100").write.parquet(new)
    store = DS.DayStates(spark, str(tmp_path / "s"), DS.stream_spec())
    store.add("old", D.stream_rows(spark.read.parquet(old)))
    shutil.copytree(old, tmp_path / "kept")
    for f in os.listdir(old):
        if f.endswith(".parquet"):
            (tmp_path / "old" / f).write_text("gone")
    store.add("new", D.stream_rows(spark.read.parquet(new)))
    same(by_date(DS.stream_metrics(store.states(), ["date"])), by_date(D.daily_stream_metrics(df.where("rank IS NOT NULL"))))


def test_states_merge_to_seasons_without_cancelling(spark):
    """Values near 1e6 that differ by less than 1: moments keep their digits."""
    df = spark.createDataFrame(rows_of(4), SCHEMA).where("date IS NOT NULL")
    spec = {"valence": ("moments", F.col("valence")), "low": ("least", F.col("valence")), "med": ("sketch", F.col("valence"))}
    days = DS.states_of(df, ["date"], spec)
    got = {r.m: r for r in DS.merged(days.withColumn("m", F.month("date")), ["m"], spec).select(
        "m", "valence_n", DS.spread("valence").alias("sd"), "low", DS.approximate_median("med").alias("median")).collect()}
    for r in df.groupBy(F.month("date").alias("m")).agg(F.count("valence").alias("n"), F.stddev_samp("valence").alias("sd"), F.min("valence").alias("low"),
                                                        F.median("valence").alias("median")).collect():
        assert (got[r.m].valence_n, got[r.m].low) == (r.n, r.low)
        assert got[r.m].sd == pytest.approx(r.sd, rel=1e-6) and abs(got[r.m].median - r.median) < 0.1


def test_empty_and_all_null_days(spark):
    df = spark.createDataFrame([(dt.date(2020, 1, 1), 1, 5.0, None, None)], SCHEMA)
    spec = DS.summary_spec(["energy"])
    same(by_date(DS.summary(DS.merged(DS.states_of(df, ["date"], spec), ["date"], spec), ["energy"])), by_date(D.daily_summary(df, ["energy"])), but=())
    assert DS.states_of(df.limit(0), ["date"], spec).count() == 0
