"""Tail probabilities (Student t, F, chi-square, normal) as SQL expressions.

No scipy and no Python UDF: each tail is a regularised incomplete beta or
gamma integral written as a composite Simpson sum over 2 000 steps
(``aggregate(sequence(...))`` in Spark, ``list_sum(list_transform(range(...)))``
in DuckDB).  The same text generator serves the Spark Column and the oracle
SQL, so both engines evaluate the same arithmetic.  These run on *result*
rows (one per test), never on row-grain data.

ln Gamma is Stirling's series shifted by 8 (Spark has no lgamma).  Nothing here
may cancel when the degrees of freedom are a row count: powers of sines and
cosines go through ln(1 + tan^2), and the constant of the beta integral
through a difference of Stirling series (see ``lbeta_sql``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STEPS = 2000


def _some(x: str) -> str:
    """As ``_d``; no degrees of freedom (0) make the result NULL."""
    return f"nullif({_d(x)}, 0.0)"


def _d(x: str) -> str:
    """Inputs as DOUBLE: literals such as 2.0 are DECIMAL in both dialects."""
    return f"CAST(({x}) AS DOUBLE)"


def lgamma_sql(x: str) -> str:
    x = _d(x)
    z = f"(({x}) + 8.0)"
    shift = " * ".join(f"(({x}) + {k}.0)" for k in range(8))
    series = (f"(({z} - 0.5) * ln({z}) - {z} + 0.5 * ln(2.0 * pi())"
              f" + 1.0 / (12.0 * {z}) - 1.0 / (360.0 * pow({z}, 3))"
              f" + 1.0 / (1260.0 * pow({z}, 5)) - 1.0 / (1680.0 * pow({z}, 7)))")
    return f"({series} - ln({shift}))"


def log1p_sql(x: str, dialect: str) -> str:
    """ln(1 + x); DuckDB has no log1p (its oracle sees small tables only)."""
    return f"log1p({x})" if dialect == "spark" else f"ln(1.0 + ({x}))"


def lbeta_sql(a: str, b: str, dialect: str) -> str:
    """ln B(a, b) = ln Gamma(b) - [ln Gamma(a + b) - ln Gamma(a)], the bracket
    as one difference of (shifted) Stirling series: with z = a + 8,
    (z - 1/2) ln(1 + b / z) + b ln(z + b) - b + s(z + b) - s(z), less the
    difference of the shifts.  Exact to the last digits for any a >> b."""
    a, b = _d(a), _d(b)
    z = f"({a} + 8.0)"
    series = lambda x: f"(1.0 / (12.0 * {x}) - 1.0 / (360.0 * pow({x}, 3)) + 1.0 / (1260.0 * pow({x}, 5)))"
    shift = " + ".join(log1p_sql(f"{b} / ({a} + {k}.0)", dialect) for k in range(8))
    rise = (f"(({z} - 0.5) * {log1p_sql(f'{b} / {z}', dialect)} + {b} * ln({z} + {b}) - {b}"
            f" + {series(f'({z} + {b})')} - {series(z)} - ({shift}))")
    return f"({lgamma_sql(b)} - {rise})"


def simpson_sql(lo: str, hi: str, integrand, dialect: str, steps: int = STEPS) -> str:
    """Composite Simpson rule of ``integrand(x_text)`` on [lo, hi]."""
    h = f"((CAST(({hi}) AS DOUBLE) - CAST(({lo}) AS DOUBLE)) / {float(steps)!r})"
    x = f"(({lo}) + i * {h})"
    w = f"(CASE WHEN i = 0 OR i = {steps} THEN 1.0 WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END)"
    term = f"{w} * ({integrand(x)})"
    if dialect == "spark":
        total = f"aggregate(sequence(0, {steps}), CAST(0 AS DOUBLE), (acc, i) -> acc + {term})"
    else:
        total = f"list_sum(list_transform(range(0, {steps + 1}), lambda i: {term}))"
    return f"({h} / 3.0 * {total})"


def _clip01(e: str) -> str:
    return f"least(1.0, greatest(0.0, {e}))"


def _cos_power(x: str, exponent: str, dialect: str) -> str:
    """cos(x) ** exponent for 0 <= x <= pi / 2."""
    return f"exp(-0.5 * ({exponent}) * {log1p_sql(f'tan({x}) * tan({x})', dialect)})"


def _angle(ratio: str) -> str:
    """Angle of the tail's begin, for its squared tangent."""
    return f"atan(sqrt({ratio}))"


def _span(lo: str, nu: str, size: str) -> str:
    """End of the integral: where the integrand is below 1e-17 of its begin."""
    return f"least(pi() / 2.0, {lo} + 12.0 / (sqrt({nu}) * (1.0 + ({size}) / 5.0)))"


def t_two_sided_sql(t: str, nu: str, dialect: str) -> str:
    """P(|T_nu| >= |t|) = 2/B(nu/2, 1/2) * int_{theta0}^{pi/2} cos^(nu-1)."""
    t, nu = _d(t), _some(nu)
    lo = _angle(f"({t}) * ({t}) / ({nu})")
    integral = simpson_sql(lo, _span(lo, nu, f"abs({t})"), lambda x: _cos_power(x, f"({nu}) - 1.0", dialect), dialect)
    return _clip01(f"2.0 * exp(-{lbeta_sql(f'({nu}) / 2.0', '0.5', dialect)}) * {integral}")


def f_upper_sql(f: str, d1: str, d2: str, dialect: str) -> str:
    """P(F_{d1,d2} >= f) = 2/B(d2/2, d1/2) * int_{psi0}^{pi/2} cos^(d2-1) sin^(d1-1)."""
    f, d1, d2 = _d(f), _some(d1), _some(d2)
    lo = _angle(f"({d1}) * ({f}) / ({d2})")
    hi = f"least(pi() / 2.0, {lo} + (12.0 + sqrt({d1})) / sqrt({d2}))"
    integral = simpson_sql(lo, hi, lambda x: f"{_cos_power(x, f'({d2}) - 1.0', dialect)} * pow(greatest(sin({x}), 0.0), ({d1}) - 1.0)", dialect)
    return _clip01(f"2.0 * exp(-{lbeta_sql(f'({d2}) / 2.0', f'({d1}) / 2.0', dialect)}) * {integral}")


def _chi_end(lo: str, k: str) -> str:
    peak = f"sqrt(greatest(({k}) - 1.0, 0.0))"
    return f"(greatest({lo}, {peak}) + 12.0 / (1.0 + greatest({lo} - {peak}, 0.0) / 5.0))"


def chi2_upper_sql(h: str, k: str, dialect: str) -> str:
    """P(X2_k >= h) = 2/(2^(k/2) Gamma(k/2)) * int_{sqrt h}^inf s^(k-1) e^(-s^2/2)."""
    h, k = _d(h), _some(k)
    lo = f"sqrt(greatest({h}, 0.0))"
    integral = simpson_sql(lo, _chi_end(lo, k), lambda x: f"pow({x}, ({k}) - 1.0) * exp(-({x}) * ({x}) / 2.0)", dialect)
    norm = f"exp(ln(2.0) - (({k}) / 2.0) * ln(2.0) - {lgamma_sql(f'({k}) / 2.0')})"
    return _clip01(f"{norm} * {integral}")


def norm_two_sided_sql(z: str, dialect: str) -> str:
    """P(|Z| >= |z|) (chi-square with one degree of freedom at z^2)."""
    return chi2_upper_sql(f"(({z}) * ({z}))", "1.0", dialect)


# -- Spark: staged DataFrame helpers ------------------------------------------
# The bounds and the normalising constant are projected first as short-named
# columns, so the 2 000-step lambda only references column names (a small
# expression tree for Catalyst).  The arithmetic is the same as the *_sql text.

def _staged(df, out: str, stages: dict[str, str], final: str):
    from pyspark.sql import functions as F
    tmp = list(stages)
    df = df.withColumns({k: F.expr(v) for k, v in stages.items()})
    return df.withColumn(out, F.expr(final)).drop(*tmp)


def with_t_two_sided(df, t: str, nu: str, out: str):
    t, nu = _d(t), _some(nu)
    lo = _angle(f"({t}) * ({t}) / ({nu})")
    stages = {"_tl": f"CAST(({lo}) AS DOUBLE)", "_th": f"CAST(({_span(lo, nu, f'abs({t})')}) AS DOUBLE)",
              "_tn": f"CAST(({nu}) AS DOUBLE)", "_tc": f"2.0 * exp(-{lbeta_sql(f'({nu}) / 2.0', '0.5', 'spark')})"}
    integral = simpson_sql("_tl", "_th", lambda x: _cos_power(x, "(_tn) - 1.0", "spark"), "spark")
    return _staged(df, out, stages, _clip01(f"_tc * {integral}"))


def with_f_upper(df, f: str, d1: str, d2: str, out: str):
    f, d1, d2 = _d(f), _some(d1), _some(d2)
    lo = _angle(f"({d1}) * ({f}) / ({d2})")
    stages = {"_fl": f"CAST(({lo}) AS DOUBLE)",
              "_fh": f"CAST((least(pi() / 2.0, {lo} + (12.0 + sqrt({d1})) / sqrt({d2}))) AS DOUBLE)",
              "_f1": f"CAST(({d1}) AS DOUBLE)", "_f2": f"CAST(({d2}) AS DOUBLE)",
              "_fc": f"2.0 * exp(-{lbeta_sql(f'({d2}) / 2.0', f'({d1}) / 2.0', 'spark')})"}
    integral = simpson_sql("_fl", "_fh", lambda x: f"{_cos_power(x, '(_f2) - 1.0', 'spark')} * pow(greatest(sin({x}), 0.0), (_f1) - 1.0)", "spark")
    return _staged(df, out, stages, _clip01(f"_fc * {integral}"))


def with_chi2_upper(df, h: str, k: str, out: str):
    h, k = _d(h), _some(k)
    lo = f"sqrt(greatest({h}, 0.0))"
    stages = {"_cl": f"CAST(({lo}) AS DOUBLE)", "_ch": f"CAST(({_chi_end(lo, k)}) AS DOUBLE)", "_ck": f"CAST(({k}) AS DOUBLE)",
              "_cc": f"exp(ln(2.0) - (({k}) / 2.0) * ln(2.0) - {lgamma_sql(f'({k}) / 2.0')})"}
    integral = simpson_sql("_cl", "_ch", lambda x: f"pow({x}, (_ck) - 1.0) * exp(-({x}) * ({x}) / 2.0)", "spark")
    return _staged(df, out, stages, _clip01(f"_cc * {integral}"))


def with_norm_two_sided(df, z: str, out: str):
    return with_chi2_upper(df, f"(({z}) * ({z}))", "1.0", out)
