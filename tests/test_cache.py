import datetime as dt
import os

import pytest

from skytune.sources.cache import DailyCache

DAYS = [dt.date(2020, 1, 30) + dt.timedelta(i) for i in range(70)]          # four months


def frame(spark, rows):
    return spark.createDataFrame(rows, "date date, prcp double")


def held(cache):
    return sorted((r.date, r.prcp) for r in cache.read_range("2000-01-01", "2100-01-01").collect())


def spoil(root, month):
    """Leave no readable file in a month."""
    for folder, _, names in os.walk(root / f"month={month}"):
        for n in names:
            if n.endswith(".parquet"):
                with open(os.path.join(folder, n), "w") as f:
                    f.write("no parquet")


def test_only_the_months_of_a_range_are_read(spark, tmp_path):
    cache = DailyCache(spark, str(tmp_path / "c"))
    assert cache.append(frame(spark, [(d, float(d.day)) for d in DAYS])) == 70
    spoil(tmp_path / "c", "2020-01")
    bounds = spark.createDataFrame([(dt.date(2020, 2, 10), dt.date(2020, 3, 5))], "start date, end date")
    got = cache.read_between(bounds)
    assert sorted(r.date for r in got.collect()) == [d for d in DAYS if dt.date(2020, 2, 10) <= d <= dt.date(2020, 3, 5)]
    assert "dynamicpruning" in got._jdf.queryExecution().executedPlan().toString().lower()
    assert cache.read_range("2020-02-28", "2020-03-01").count() == 3
    assert cache.completeness_between(bounds).first().complete


def test_an_append_reads_and_writes_its_months_only(spark, tmp_path):
    cache = DailyCache(spark, str(tmp_path / "c"))
    cache.append(frame(spark, [(d, 1.0) for d in DAYS if d.day != 15]))
    before = {m: os.listdir(tmp_path / "c" / f"month={m}") for m in ("2020-02", "2020-03")}
    spoil(tmp_path / "c", "2020-01")
    assert cache.append(frame(spark, [(dt.date(2020, 3, 15), 2.0), (dt.date(2020, 3, 16), 9.0)])) == 1
    assert os.listdir(tmp_path / "c" / "month=2020-02") == before["2020-02"]
    assert [r.prcp for r in cache.read_range("2020-03-15", "2020-03-16").orderBy("date").collect()] == [2.0, 1.0]


@pytest.mark.parametrize("step", ["staged", "half"])
def test_a_killed_write_neither_doubles_nor_loses_days(spark, tmp_path, step, monkeypatch):
    cache = DailyCache(spark, str(tmp_path / "c"))
    old = [(d, 1.0) for d in DAYS[::2]]
    cache.append(frame(spark, old))
    more = frame(spark, [(d, 2.0) for d in DAYS])
    plain = DailyCache._commit

    def killed(self, stage):
        if step == "half":                       # one month renamed, then the end
            fs, root, path = self._fs()
            month = "month=2020-02"
            fs.rename(path(f"{stage}/{month}"), path(f"{self.path}/{month}/version=2"))
        raise KeyboardInterrupt

    monkeypatch.setattr(DailyCache, "_commit", killed)
    with pytest.raises(KeyboardInterrupt):
        cache.append(more)
    days = [d for d, _ in held(cache)]
    assert len(days) == len(set(days)) and {d for d, _ in old} <= set(days)
    monkeypatch.setattr(DailyCache, "_commit", plain)
    cache.append(more)
    want = sorted(dict([(d, 2.0) for d in DAYS] + old).items())
    assert held(cache) == want
    assert cache.append(more) == 0 and held(cache) == want
    assert not [n for n in os.listdir(tmp_path / "c") if n.startswith("_staging")]


def test_empty_appends_and_new_columns(spark, tmp_path):
    cache = DailyCache(spark, str(tmp_path / "c"))
    assert cache.append(frame(spark, [])) == 0 and cache.append(frame(spark, [(None, 1.0)])) == 0
    assert cache.append(frame(spark, [(DAYS[0], 1.0)])) == 1
    assert cache.append(frame(spark, [(DAYS[0], 1.0)]).limit(0)) == 0
    assert held(cache) == [(DAYS[0], 1.0)]
