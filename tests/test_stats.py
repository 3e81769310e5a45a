import math
import random

import pytest
from pyspark.sql import functions as F

from skytune.operators import ranks as RK
from skytune.operators import stattests as S


def _pearson(x, y):
    n = len(x)
    mx, my = sum(x) / n, sum(y) / n
    sxy = sum((a - mx) * (b - my) for a, b in zip(x, y))
    sx = math.sqrt(sum((a - mx) ** 2 for a in x))
    sy = math.sqrt(sum((b - my) ** 2 for b in y))
    return sxy / (sx * sy)


def _avg_ranks(v):
    order = sorted(range(len(v)), key=lambda i: v[i])
    r = [0.0] * len(v)
    i = 0
    while i < len(v):
        j = i
        while j + 1 < len(v) and v[order[j + 1]] == v[order[i]]:
            j += 1
        for k in range(i, j + 1):
            r[order[k]] = (i + j) / 2 + 1
        i = j + 1
    return r


def test_pearson_spearman_and_guards(spark):
    rnd = random.Random(7)
    x = [rnd.random() for _ in range(40)]
    y = [a * 2 + rnd.random() for a in x]
    rows = [("g", a, b) for a, b in zip(x, y)] + [("const", 1.0, float(i)) for i in range(40)] \
        + [("small", 1.0, 2.0), ("small", 2.0, 3.0)] + [("g", None, 1.0)]
    t = {r.k: r for r in S.correlation_tests(spark.createDataFrame(rows, "k string, x double, y double"),
                                             ["k"], "x", "y", min_n=10).collect()}
    assert t["g"].n == 40
    assert t["g"].pearson_r == pytest.approx(_pearson(x, y), abs=1e-12)
    assert t["g"].spearman_rho == pytest.approx(_pearson(_avg_ranks(x), _avg_ranks(y)), abs=1e-12)
    assert 0 <= t["g"].pearson_p < 1e-6
    assert t["const"].pearson_r is None and t["const"].n == 40       # constant column: NULL, no error
    assert t["small"].pearson_r is None and t["small"].n == 2


def test_spearman_invariant_under_monotone_map(spark):
    rnd = random.Random(3)
    rows = [(rnd.random(), rnd.random()) for _ in range(30)]
    df = spark.createDataFrame([("a", x, y) for x, y in rows] + [("b", math.exp(5 * x), y ** 3) for x, y in rows],
                               "k string, x double, y double")
    t = {r.k: r.spearman_rho for r in S.correlation_tests(df, ["k"], "x", "y").collect()}
    assert t["a"] == pytest.approx(t["b"], abs=1e-12)


def test_global_rank_equals_window_rank(spark):
    rnd = random.Random(1)
    rows = [("m", float(rnd.randint(0, 50))) for _ in range(500)] + [("n", rnd.random()) for _ in range(300)] \
        + [("c", 1.0)] * 5
    df = spark.createDataFrame(rows, "k string, v double")
    a = sorted((r.k, r.v, r.r) for r in RK.average_rank(df, ["k"], "v", "r").collect())
    b = sorted((r.k, r.v, r.r) for r in RK.average_rank_global(df, ["k"], "v", "r", buckets=16).collect())
    assert a == b


def test_two_group_properties(spark):
    a = [1.0, 2.0, 2.0, 5.0, 7.0, 8.0]
    b = [2.0, 3.0, 3.0, 4.0]
    rows = [("k", "A", v) for v in a] + [("k", "B", v) for v in b] + [("k", "C", 99.0), ("k", None, 1.0)]
    r = S.two_group_tests(spark.createDataFrame(rows, "k string, g string, v double"), ["k"], "g", "v", "A", "B").collect()[0]
    ranks = _avg_ranks(a + b)
    u_a = sum(ranks[:len(a)]) - len(a) * (len(a) + 1) / 2
    assert r.mannwhitney_u == pytest.approx(u_a)
    rows2 = [("k", "A", v) for v in b] + [("k", "B", v) for v in a]
    r2 = S.two_group_tests(spark.createDataFrame(rows2, "k string, g string, v double"), ["k"], "g", "v", "A", "B").collect()[0]
    assert r.mannwhitney_u + r2.mannwhitney_u == pytest.approx(len(a) * len(b))
    ma, mb = sum(a) / len(a), sum(b) / len(b)
    va = sum((x - ma) ** 2 for x in a) / (len(a) - 1)
    vb = sum((x - mb) ** 2 for x in b) / (len(b) - 1)
    assert r.welch_t == pytest.approx((ma - mb) / math.sqrt(va / len(a) + vb / len(b)))
    assert r.median_a == 3.5 and r.n_a == 6 and r.n_b == 4
    assert 0 < r.welch_p < 1 and 0 < r.mannwhitney_p <= 1


def test_two_group_empty_side_and_all_keys(spark):
    rows = [("k", "A", 1.0), ("k", "A", 2.0), ("j", "B", 1.0)]
    t = {r.k: r for r in S.two_group_tests(spark.createDataFrame(rows, "k string, g string, v double"),
                                           ["k"], "g", "v", "A", "B").collect()}
    assert t["k"].n_b == 0 and t["k"].mean_a is None and t["k"].welch_p is None
    assert t["j"].n_a == 0


def test_anova_kruskal_against_formulas(spark):
    groups = {"w": [1.0, 2.0, 3.0, 3.0], "s": [2.0, 4.0, 6.0], "u": [5.0, 7.0, 9.0, 9.0, 10.0], "x": [4.0]}
    rows = [("m", g, v) for g, vs in groups.items() for v in vs]
    r = S.anova_kruskal(spark.createDataFrame(rows, "k string, g string, v double"), ["k"], "g", "v").collect()[0]
    assert r.n_total == 13 and r.groups == 4
    valid = {g: v for g, v in groups.items() if len(v) >= 2}
    allv = [x for v in valid.values() for x in v]
    n, k = len(allv), len(valid)
    gm = sum(allv) / n
    ssb = sum(len(v) * (sum(v) / len(v) - gm) ** 2 for v in valid.values())
    ssw = sum(sum((x - sum(v) / len(v)) ** 2 for x in v) for v in valid.values())
    assert r.anova_f == pytest.approx((ssb / (k - 1)) / (ssw / (n - k)))
    ranks = _avg_ranks(allv)
    pos, rs = 0, []
    for v in valid.values():
        rs.append(sum(ranks[pos:pos + len(v)]) ** 2 / len(v))
        pos += len(v)
    h = 12 / (n * (n + 1)) * sum(rs) - 3 * (n + 1)
    ties = {}
    for x in allv:
        ties[x] = ties.get(x, 0) + 1
    c = 1 - sum(t ** 3 - t for t in ties.values()) / (n ** 3 - n)
    assert r.kruskal_h == pytest.approx(h / c)


def test_bh_monotone_and_nulls(spark):
    ps = [0.01, 0.04, 0.03, None, 0.2, 0.5]
    df = spark.createDataFrame([("f", i, p) for i, p in enumerate(ps)], "fam string, i int, p double")
    out = sorted((r.i, r.p, r.q) for r in S.bh_adjust(df, ["fam"], "p", "q").collect())
    vals = [(p, q) for _, p, q in out if p is not None]
    assert all(q >= p for p, q in vals)
    srt = sorted(vals)
    assert all(srt[i][1] <= srt[i + 1][1] for i in range(len(srt) - 1))
    assert out[3][2] is None
    assert dict((i, q) for i, _, q in out)[0] == pytest.approx(0.01 * 5 / 1)
    allnull = spark.createDataFrame([("f", None), ("f", None)], "fam string, p double")
    assert [r.q for r in S.bh_adjust(allnull, ["fam"], "p", "q").collect()] == [None, None]


def test_conclusion_labels(spark):
    df = spark.createDataFrame([(0.01, None), (0.2, 0.01), (None, None), (0.01, 0.3)], "p double, a double")
    got = [r[0] for r in df.select(S.conclusion(F.col("p"), F.col("a"))).collect()]
    assert got == ["SIGNIFICANT", "SIGNIFICANT", "GEEN TEST", "NIET SIGNIFICANT"]


def test_exact_quantiles_match_percentile(spark):
    rnd = random.Random(11)
    rows = [("a", float(rnd.randint(0, 20))) for _ in range(301)] + [("b", rnd.random()) for _ in range(50)] \
        + [("c", 5.0)] + [("d", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    qs = {"q25": 0.25, "median": 0.5, "q75": 0.75, "q67": 0.67}
    got = {r.k: r for r in RK.exact_quantiles(df, ["k"], "v", qs, buckets=8).collect()}
    exp = {r.k: r for r in df.groupBy("k").agg(*[F.percentile("v", q).alias(n) for n, q in qs.items()]).collect()}
    assert set(got) == {"a", "b", "c"}
    for k in got:
        for n in qs:
            assert got[k][n] == pytest.approx(exp[k][n], abs=1e-12)
