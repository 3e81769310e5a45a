import datetime as dt

import pytest

from skytune.operators import daily as D

SCHEMA = "date date, rank double, streams double, valence double, energy double"
D1, D2, D3 = dt.date(2020, 1, 1), dt.date(2020, 1, 2), dt.date(2020, 1, 3)


def by_date(df):
    return {r["date"]: r for r in df.collect()}


def test_daily_summary_stream_weights_and_quirks(spark):
    rows = [(D1, 1.0, 100.0, 0.30, 0.40), (D1, 2.0, 300.0, 0.80, None), (D1, 3.0, -5.0, 0.20, 0.10),
            (D1, 4.0, None, None, 0.9),
            (D2, 1.0, 50.0, None, 0.2)]            # a day without valence keeps its coverage
    out = by_date(D.daily_summary(spark.createDataFrame(rows, SCHEMA)))
    a = out[D1]
    assert a.top200_rows == 4 and a.tracks_with_valence == 3
    assert a.valence_coverage == pytest.approx(0.75)
    assert a.sad_songs_count == 2 and a.share_sad_songs == pytest.approx(2 / 3)
    # negative streams are nulled: weights 100 and 300 only
    assert a.weighted_avg_valence == pytest.approx((0.3 * 100 + 0.8 * 300) / 400)
    assert a.weighted_share_sad == pytest.approx(100 / 400)
    assert a.weighted_share_low_energy == pytest.approx(100 / 400)   # missing energy -> not low
    assert a.total_streams == 400 and a.sad_streams == 100
    assert a.share_sad_streams == pytest.approx(0.25)
    assert a.weight_source == "streams" and a.main_sad_share_label.startswith("streamgewogen")
    b = out[D2]
    assert b.top200_rows == 1 and b.tracks_with_valence == 0
    assert b.avg_valence is None and b.sad_songs_count is None and b.weight_source is None


def test_daily_summary_falls_back_to_rank_weight(spark):
    rows = [(D1, 1.0, None, 0.30, 0.4), (D1, 200.0, None, 0.90, 0.9), (D2, 250.0, 0.0, 0.1, 0.1)]
    out = by_date(D.daily_summary(spark.createDataFrame(rows, SCHEMA)))
    a = out[D1]
    assert a.weight_source == "rank_weight"
    assert a.weighted_avg_valence == pytest.approx((0.3 * 200 + 0.9 * 1) / 201)
    assert a.total_streams is None and a.main_sad_share_metric == pytest.approx(200 / 201)
    assert out[D2].weighted_avg_valence == pytest.approx(0.1)      # rank 250 -> weight floor 1
    assert out[D2].analysis_weight_total == 1


def test_one_row_day_has_null_sd(spark):
    out = by_date(D.daily_summary(spark.createDataFrame([(D3, 1.0, 10.0, 0.5, 0.5)], SCHEMA)))
    assert out[D3].std_valence is None and out[D3].median_valence == 0.5


def test_stream_metrics_drop_negatives_and_strict_sad(spark):
    rows = [(D1, 1.0, 100.0, 0.40, 0.1), (D1, 2.0, -1.0, 0.1, 0.1), (D1, 3.0, 50.0, 0.39, None),
            (D1, 4.0, None, 0.1, None)]
    r = D.daily_stream_metrics(spark.createDataFrame(rows, SCHEMA)).collect()[0]
    assert r.song_rows == 2 and r.sad_songs_count == 1            # 0.40 is not < 0.40
    assert r.share_sad_streams == pytest.approx(50 / 150)
    assert r.weighted_avg_valence == pytest.approx((0.4 * 100 + 0.39 * 50) / 150)


def test_stream_metrics_all_zero_streams(spark):
    r = D.daily_stream_metrics(spark.createDataFrame([(D1, 1.0, 0.0, 0.2, None)], SCHEMA)).collect()[0]
    assert r.stream_coverage is None and r.share_sad_streams is None and r.share_sad_songs == 1.0


def test_early_totals(spark):
    rows = [(D1, 1.0, 100.0, 0.30, None), (D1, 2.0, 300.0, 0.35, None)]
    r = D.daily_totals_early(spark.createDataFrame(rows, SCHEMA)).collect()[0]
    assert r.sad_songs_count == 1 and r.share_sad_streams == pytest.approx(0.25) and r.share_sad_songs == 0.5
