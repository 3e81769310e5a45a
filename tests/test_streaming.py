import datetime as dt
import uuid

import pytest

from skytune.operators.daily import daily_stream_metrics
from skytune.streaming import current_days, start_daily_stream

SCHEMA = "date date, streams double, valence double"


def run(spark, src, sink, name):
    q = start_daily_stream(spark, str(src), spark.createDataFrame([], SCHEMA).schema, str(sink), name,
                           files_per_trigger=1, available_now=True)
    q.awaitTermination(300)
    assert q.exception() is None
    return {r.date: r for r in current_days(spark, str(sink)).collect()}


def same(got, songs):
    want = {r.date: r for r in daily_stream_metrics(songs).collect()}
    assert set(got) == set(want)
    for d, e in want.items():
        for c, x in got[d].asDict().items():
            assert x == pytest.approx(e[c]) if isinstance(x, float) and e[c] is not None else x == e[c], (d, c)


def test_files_out_of_order_count_once_each(spark, tmp_path):
    """1 January, 1 March, 1 March, 1 January: the late file is no different."""
    day = {1: dt.date(2020, 1, 1), 3: dt.date(2020, 3, 1)}
    name, src, sink = f"days_{uuid.uuid4().hex[:8]}", tmp_path / "src", tmp_path / "sink"
    rows = []
    for i, m in enumerate((1, 3, 3, 1)):
        new = [(day[m], 10.0 * (i + 1) + j, None if j == 3 else j / 5) for j in range(5)] + [(day[m], None, 0.1), (None, 5.0, 0.2), (day[m], -1.0, 0.3)]
        rows += new
        spark.createDataFrame(new, SCHEMA).coalesce(1).write.mode("append").parquet(str(src))
        got = run(spark, src, sink, name)
        same(got, spark.createDataFrame(rows, SCHEMA))
    assert got[day[1]].song_rows == 10 and got[day[3]].song_rows == 10
