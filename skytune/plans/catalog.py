"""Query catalogue: name -> (Spark plan builder, DuckDB oracle SQL).

Every query reads the driver's whole tables (through the fixture views) and
returns a report DataFrame whose DOUBLE columns are rounded to 10 significant digits; the
oracle is wrapped the same way (see ``oracle_sql``).
"""

from __future__ import annotations

import importlib
import json
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.nulls import SIG_DIGITS, round_abs, round_abs_sql, round_doubles, round_sig_sql
from . import oracle as O

QueryFn = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, QueryFn] = {}
_SQL: dict[str, str] = {}
DIGITS = SIG_DIGITS
#: In the order in which their oracle parts build on each other.
MODULES = ("q_daily", "q_weather", "q_analysis", "q_entity", "q_match", "q_profile", "q_states", "q_sources")
_SCHEMA_FILE = os.path.join(os.path.dirname(__file__), "report_doubles.json")


def _near_zero(column: str) -> bool:
    """Differences of z-scores and correlations cancel to noise near zero: such
    columns are compared at 1e-10."""
    return column.startswith("weather_score_") or any(x in column for x in ("pearson_r", "pearson_correlation", "spearman_rho", "abs_best_corr"))


def query(name: str, sql: str | None):
    def deco(fn: QueryFn) -> QueryFn:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = fn(spark, sf_dir)
            out = out.withColumns({c: round_abs(c) for c in out.columns if _near_zero(c)})
            return round_doubles(out, DIGITS)
        run.__name__ = name
        run.__doc__ = fn.__doc__
        _QUERIES[name] = run
        if sql is not None:
            _SQL[name] = sql
        return fn
    return deco


def queries() -> dict[str, QueryFn]:
    _load()
    return dict(_QUERIES)


def _doubles() -> dict[str, list[str]]:
    try:
        with open(_SCHEMA_FILE) as fh:
            return json.load(fh)
    except FileNotFoundError:
        return {}


def oracle_sql() -> dict[str, str]:
    """Oracle text per query, DOUBLE columns rounded like the Spark report."""
    _load()
    dbl = _doubles()
    out = {}
    for name, sql in _SQL.items():
        cols = dbl.get(name, [])
        if cols:
            quoted = {c: f'"{c}"' for c in cols}
            rep = ", ".join(f'{round_sig_sql(round_abs_sql(q) if _near_zero(c) else q, DIGITS)} AS {q}' for c, q in quoted.items())
            out[name] = f"SELECT * REPLACE ({rep}) FROM (\n{sql}\n) q"
        else:
            out[name] = sql
    return out


def _load() -> None:
    for module in MODULES:
        importlib.import_module(f"{__package__}.{module}")


__all__ = ["query", "queries", "oracle_sql", "O", "F"]
