"""Date text normalisation and calendar fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nulls import col_of

YMD = r"^(\d{4})[/-](\d{1,2})[/-](\d{1,2})$"
DMY = r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4})$"


def clean_raw_date(c: str | Column) -> Column:
    """Trim, cut at 'T', cut at the first space; blank -> NULL."""
    s = F.regexp_replace(col_of(c).cast("string"), r"^\s+|\s+$", "")
    s = F.regexp_replace(F.split(s, "T", 2).getItem(0), r"^\s+|\s+$", "")
    s = F.split(s, " ", 2).getItem(0)
    return F.nullif(s, F.lit(""))


def _iso(y: Column, m: Column, d: Column) -> Column:
    ok = m.between(1, 12) & d.between(1, 31)
    iso = F.concat(F.lpad(y.cast("string"), 4, "0"), F.lit("-"), F.lpad(m.cast("string"), 2, "0"),
                   F.lit("-"), F.lpad(d.cast("string"), 2, "0"))
    return F.when(ok, iso)


def normalize_date_text(c: str | Column, slash_order: str | Column = "dayfirst",
                        cleaned: bool = False) -> Column:
    """Y-M-D, Y/M/D, D/M/Y or M/D/Y text -> 'YYYY-MM-DD' text, else NULL.

    Only month 1-12 and day 1-31 are checked (2020-02-31 survives as text and
    becomes NULL in ``to_date_lenient``).  ``slash_order`` may be a Column
    (e.g. the one-row vote of ``date_order_vote`` joined in).  With
    ``cleaned=True`` the input is already ``clean_raw_date`` output (project
    it once in a prior ``select`` so it is not re-evaluated per branch).
    The shape is checked with two anchored patterns; the numbers come from
    one split on the separators.
    """
    s = col_of(c) if cleaned else clean_raw_date(c)
    order = F.lit(slash_order) if isinstance(slash_order, str) else slash_order
    parts = F.split(F.translate(s, "/", "-"), "-")  # single-char split: no regex per row
    p0, p1, p2 = (parts.getItem(i).try_cast("int") for i in range(3))
    ymd = _iso(p0, p1, p2)
    dmy = F.when(order == "dayfirst", _iso(p2, p1, p0)).otherwise(_iso(p2, p0, p1))
    return (F.when(s.rlike(YMD), ymd)
            .when(s.rlike(DMY), dmy))


def slash_votes(c: str | Column, rows: str | Column | None = None) -> tuple[Column, Column]:
    """X21 aggregate parts: (dayfirst votes, monthfirst votes); ``rows`` is how
    many rows a text stands for, one if not given."""
    s = clean_raw_date(c)
    a = F.regexp_extract(s, DMY, 1).try_cast("int")
    b = F.regexp_extract(s, DMY, 2).try_cast("int")
    m = s.rlike(DMY)
    day, month = m & (a > 12) & (b <= 12), m & (b > 12) & (a <= 12)
    if rows is None:
        return F.count_if(day), F.count_if(month)
    return tuple(F.coalesce(F.sum(F.when(v, col_of(rows))), F.lit(0).cast("long")) for v in (day, month))


def vote_label(day_votes: Column, month_votes: Column) -> Column:
    return F.when(day_votes >= month_votes, "dayfirst").otherwise("monthfirst")


def to_date_lenient(c: str | Column) -> Column:
    """First 10 characters as yyyy-MM-dd; invalid dates -> NULL."""
    return F.try_to_date(F.substring(col_of(c).cast("string"), 1, 10), "yyyy-MM-dd")


# Fixed season names (month -> season) and their order.
SEASON_ORDER = ("winter", "spring", "summer", "autumn")


def season(month: str | Column) -> Column:
    """Meteorological season from the month number."""
    m = col_of(month)
    return (F.when(m.isin(12, 1, 2), "winter")
            .when(m.isin(3, 4, 5), "spring")
            .when(m.isin(6, 7, 8), "summer")
            .otherwise("autumn"))


def season_order(s: str | Column) -> Column:
    x = col_of(s)
    out = None
    for i, name in enumerate(SEASON_ORDER, start=1):
        out = (F.when(x == name, i) if out is None else out.when(x == name, i))
    return out


def calendar_fields(date: str | Column) -> list[Column]:
    """Year, month, month name, season, season order."""
    d = col_of(date)
    return [F.year(d).alias("year"), F.month(d).alias("month"),
            F.date_format(d, "MMMM").alias("month_name"),
            season(F.month(d)).alias("season"),
            season_order(season(F.month(d))).cast("int").alias("season_order")]
