"""Tails against closed forms, tables and asymptotic expansions."""

import math

import pytest

from skytune.functions import tails


def values(spark, with_tail, rows, *names):
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], ["i", *names])
    return [r.p for r in with_tail(df, *names, "p").orderBy("i").collect()]


def expansion(t, nu):
    """P(|T| >= t) from the normal tail, Fisher's expansion in 1 / nu."""
    phi = math.exp(-t * t / 2) / math.sqrt(2 * math.pi)
    return math.erfc(t / math.sqrt(2)) + 2 * phi * ((t**3 + t) / (4 * nu) + (3 * t**7 - 7 * t**5 - 5 * t**3 - 3 * t) / (96 * nu**2))


@pytest.mark.parametrize("nu", [1e6, 1e9, 1e11, 1e12])
def test_t_with_many_degrees_of_freedom(spark, nu):
    ts = [0.1, 1.0, 1.96, 3.0, 6.0]
    for t, p in zip(ts, values(spark, tails.with_t_two_sided, [(t, nu) for t in ts], "t", "nu")):
        assert p == pytest.approx(expansion(t, nu), rel=2e-9), t


def test_t_closed_forms(spark):
    ts = [0.0, 0.3, 1.0, 4.0, 25.0]
    for t, p in zip(ts, values(spark, tails.with_t_two_sided, [(t, 2) for t in ts], "t", "nu")):
        assert p == pytest.approx(1 - t / math.sqrt(2 + t * t), rel=1e-8)
    # published two-sided 5 % and 1 % points
    for nu, t, p in ((10, 2.228138852, 0.05), (30, 2.042272456, 0.05), (10, 3.169272673, 0.01), (120, 2.617421145, 0.01)):
        assert values(spark, tails.with_t_two_sided, [(t, nu)], "t", "nu")[0] == pytest.approx(p, rel=1e-8)


def test_normal_tail_far_out(spark):
    zs = [0.0, 0.5, 1.959963984540054, 5.0, 10.0]
    for z, p in zip(zs, values(spark, tails.with_norm_two_sided, [(z,) for z in zs], "z")):
        assert p == pytest.approx(math.erfc(z / math.sqrt(2)), rel=2e-9)


def test_f_closed_forms(spark):
    # d1 = 2: P = (1 + 2 f / d2) ** (-d2 / 2)
    cases = [(f, 2, d2) for f in (0.1, 1.0, 3.5, 9.0) for d2 in (4, 50, 10_000, 10**9)]
    for (f, _, d2), p in zip(cases, values(spark, tails.with_f_upper, cases, "f", "d1", "d2")):
        assert p == pytest.approx(math.exp(-d2 / 2 * math.log1p(2 * f / d2)), rel=2e-8), (f, d2)
    assert values(spark, tails.with_f_upper, [(2.866081402, 4, 20)], "f", "d1", "d2")[0] == pytest.approx(0.05, rel=1e-7)


def test_chi2_closed_forms(spark):
    # k = 2: exp(-h / 2); k = 4: (1 + h / 2) exp(-h / 2)
    hs = [0.5, 2.0, 10.0, 60.0]
    for h, p in zip(hs, values(spark, tails.with_chi2_upper, [(h, 2) for h in hs], "h", "k")):
        assert p == pytest.approx(math.exp(-h / 2), rel=1e-8)
    for h, p in zip(hs, values(spark, tails.with_chi2_upper, [(h, 4) for h in hs], "h", "k")):
        assert p == pytest.approx((1 + h / 2) * math.exp(-h / 2), rel=1e-8)
