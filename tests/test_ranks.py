import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from skytune.operators import daily as D
from skytune.operators import profile as PR
from skytune.operators import quantiles as Q
from skytune.operators import ranks as RK


def _rows(seed, n=900):
    rnd = random.Random(seed)
    out = [("hot", 1.0 if rnd.random() < 0.6 else rnd.choice([0.0, -0.0, 2.0, rnd.random()])) for _ in range(n)]
    out += [("spread", rnd.random()) for _ in range(n // 2)] + [(None, float(rnd.randint(0, 3))) for _ in range(50)] + [("one", 7.0)]
    rnd.shuffle(out)
    return out


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_positions_whatever_the_number_of_ranges(spark, parts):
    rows = _rows(parts)
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    for down in (False, True):
        got = RK.positions(df, ["k"], "v", descending=down, parts=parts).collect()
        assert len(got) == len(rows)
        for k in {r[0] for r in rows}:
            mine = [v for key, v in rows if key == k]
            for r in [r for r in got if r.k == k][:60]:
                assert r._before == sum(v > r.v if down else v < r.v for v in mine)
                assert r._ties == sum(v == r.v for v in mine)


def test_a_hot_value_spans_many_ranges(spark):
    df = spark.range(4000).select(F.lit("k").alias("k"), F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id").cast("double")).alias("v"))
    got = RK.positions(df, ["k"], "v", parts=20)
    sizes = [r["count"] for r in got.groupBy("_part").count().collect()]
    assert max(sizes) < 3 * 4000 / 20
    assert got.where("v = 5.0").select("_before", "_ties").distinct().collect() == [(3, 1335)]


def test_positions_without_keys_and_of_nothing(spark):
    df = spark.createDataFrame([(3.0,), (1.0,), (3.0,)], "v double")
    assert sorted((r.v, r._before, r._ties) for r in RK.positions(df, [], "v", parts=3).collect()) == [(1.0, 0, 1), (3.0, 1, 2), (3.0, 1, 2)]
    assert RK.positions(df.limit(0), [], "v", parts=3).collect() == []


@pytest.mark.parametrize("accuracy", [40, 400, 10_000])
def test_bracket_refinement_equals_percentile(spark, accuracy):
    rnd = random.Random(accuracy)
    rows = [("normal", rnd.gauss(0, 1)) for _ in range(3000)] + [("few", float(rnd.randint(0, 4))) for _ in range(2000)]
    rows += [("skew", rnd.random() ** 9 * 1e9) for _ in range(1501)] + [("two", 1.0), ("two", 2.0), ("none", None), (None, 4.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    qs = {"low": 0.0, "q25": 0.25, "q33": 0.33, "median": 0.5, "q75": 0.75, "high": 1.0}
    got = {r.k: r for r in Q.exact_quantiles(df, ["k"], "v", qs, accuracy).collect()}
    want = {r.k: r for r in df.where("k IS NOT NULL AND v IS NOT NULL").groupBy("k").agg(*[F.percentile("v", q).alias(n) for n, q in qs.items()]).collect()}
    assert set(got) - {None} == set(want)
    for k, r in want.items():
        assert [got[k][n] for n in qs] == pytest.approx([r[n] for n in qs], rel=1e-12, abs=1e-12)


def test_settled_days_are_not_read_again(spark):
    """Few rows a day: the sketch answers, and the second pass is cut away."""
    df = spark.createDataFrame([(dt.date(2020, 1, 1 + i % 3), 5.0, float(i), 1) for i in range(60)],
                               "date date, streams double, valence double, rank int")
    out = D.daily_stream_metrics(df)
    got = {r.date.day: r.median_valence for r in out.collect()}
    assert got == {1 + d: statistics.median(range(d, 60, 3)) for d in range(3)}
    out.write.format("noop").mode("overwrite").save()


def test_describe_of_many_columns(spark):
    rnd = random.Random(5)
    rows = [(rnd.random(), None if i % 5 == 0 else float(i % 7), None) for i in range(4001)]
    got = {r.column: r for r in PR.describe(spark.createDataFrame(rows, "a double, b double, c double"), ["a", "b", "c"]).collect()}
    for i, c in enumerate("ab"):
        v = [r[i] for r in rows if r[i] is not None]
        q = statistics.quantiles(v, n=4, method="inclusive")
        assert [got[c].q25, got[c].median, got[c].q75] == pytest.approx(q)
        assert got[c].n_values == len(v) and got[c].std == pytest.approx(statistics.stdev(v)) and (got[c].min, got[c].max) == (min(v), max(v))
    assert got["c"].n_values == 0 and got["c"].median is None


def test_weighted_positions(spark):
    rnd = random.Random(8)
    rows = [(rnd.choice("ab"), float(rnd.randint(0, 9)), rnd.randint(0, 5), int(rnd.random() < 0.5)) for _ in range(700)]
    df = spark.createDataFrame(rows, "k string, v double, w long, m long").repartition(3)
    for r in RK.positions(df, ["k"], "v", parts=9, weights=["w", "m"]).collect():
        mine = [x for x in rows if x[0] == r.k]
        less, same = [x for x in mine if x[1] < r.v], [x for x in mine if x[1] == r.v]
        assert (r._before, r._ties) == (len(less), len(same))
        assert (r._before0, r._ties0) == (sum(x[2] for x in less), sum(x[2] for x in same))
        assert (r._before1, r._ties1) == (sum(x[3] for x in less), sum(x[3] for x in same))


def test_target_correlations_equal_the_pairwise_tests(spark):
    from skytune.operators import stattests as S
    rnd = random.Random(2)
    maybe = lambda x, p: None if rnd.random() < p else x
    rows = [(maybe(float(rnd.randint(0, 6)), 0.2), maybe(rnd.random(), 0.1), 3.0, None, maybe(float(rnd.randint(1, 30)), 0.05), maybe(rnd.random() ** 2, 0.3))
            for _ in range(400)]
    df = spark.createDataFrame(rows, "a double, b double, flat double, none double, p double, q double").repartition(3)
    got = {(r.feature, r.target): r for r in S.target_correlations(df, ["a", "b", "flat", "none"], ["p", "q"], min_n=30, parts=5).collect()}
    assert len(got) == 8
    for (f, t), r in got.items():
        want = S.correlation_tests(df.select(F.lit("k").alias("k"), F.col(f).alias("x"), F.col(t).alias("y")), ["k"], "x", "y", min_n=30).first()
        assert r.n == want.n
        for c in ("pearson_r", "pearson_p", "spearman_rho", "spearman_p"):
            assert (r[c] is None) == (want[c] is None) and (r[c] is None or r[c] == pytest.approx(want[c], abs=1e-12)), (f, t, c)


def test_target_correlations_sort_distinct_values_only(spark, monkeypatch):
    from skytune.operators import stattests as S
    df = spark.range(600).selectExpr("CAST(id % 7 AS double) AS a", "CASE WHEN id % 3 > 0 THEN CAST(id % 11 AS double) END AS b", "CAST(id % 5 AS double) AS y")
    sizes, plain = [], S.positions
    monkeypatch.setattr(S, "positions", lambda rows, *args, **named: sizes.append(rows.count()) or plain(rows, *args, **named))
    got = {r.feature: r for r in S.target_correlations(df, ["a", "b"], ["y"], min_n=30, parts=3).collect()}
    assert sizes == [5, 18]                 # values of y; of a and of b
    for f in ("a", "b"):
        want = S.correlation_tests(df.selectExpr("'k' AS k", f"{f} AS x", "y"), ["k"], "x", "y", min_n=30).first()
        assert got[f].n == want.n
        assert abs(got[f].pearson_r - want.pearson_r) < 1e-12 and abs(got[f].spearman_rho - want.spearman_rho) < 1e-12
