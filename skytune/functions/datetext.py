"""Dates in any usual spelling (X7, the lenient form).

Numbers (year first, or last with two or four digits, any of ``- / .`` or a space
between them), eight digits, and English month names in either order are read;
a weekday before and a time after the date are dropped.  Whether 03/04/2020 is
in March or April is decided by the column: texts that fit only one order vote
(a distinct text with the number of its rows), a text that fits only one order is
read by that.  Distinct texts are read once, and joined back.
Anything else, and days that do not exist, are NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .nulls import col_of

MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
CENTURY_FROM = 69                 # fixed value: two digits from here on are of the 1900s, below of the 2000s

_WEEKDAY = r"^(?i)(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+"
_TIME = r"(?i)(?:T|,?\s+)\d{1,2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?(?:\s*[ap]\.?m\.?)?(?:\s*(?:Z|UTC|GMT|[+-]\d{2}:?\d{2}))?$"
_SEP, _YEAR, _DAY, _NAME = r"[-/. ]", r"(\d{4}|\d{2})", r"(\d{1,2})(?:st|nd|rd|th)?", r"([A-Za-z]{3,9})\.?"
YEAR_FIRST = rf"^(\d{{4}}){_SEP}(\d{{1,2}}){_SEP}(\d{{1,2}})$"
EIGHT_DIGITS = r"^(\d{4})(\d{2})(\d{2})$"
YEAR_LAST = rf"^(\d{{1,2}}){_SEP}(\d{{1,2}}){_SEP}{_YEAR}$"
DAY_NAME = rf"^{_DAY}{_SEP}+{_NAME},?{_SEP}*{_YEAR}$"
NAME_DAY = rf"^{_NAME}{_SEP}+{_DAY},?{_SEP}+{_YEAR}$"
YEAR_NAME = rf"^(\d{{4}}){_SEP}+{_NAME}{_SEP}+(\d{{1,2}})$"


def date_part(c: str | Column) -> Column:
    """The text without blanks around it, a weekday before and a time after."""
    s = F.regexp_replace(col_of(c).cast("string"), r"^\s+|\s+$", "")
    return F.regexp_replace(F.regexp_replace(s, _WEEKDAY, ""), _TIME, "")


def _number(s: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(s, pattern, group).try_cast("int")


def _year(text: Column) -> Column:
    y = text.try_cast("int")
    return F.when(F.length(text) == 4, y).when(y >= CENTURY_FROM, 1900 + y).otherwise(2000 + y)


def _month(name: Column) -> Column:
    """1 to 12 for the name of a month or the beginning of one."""
    n = F.lower(name)
    out = F.when(n == "sept", 9)
    for i, full in enumerate(MONTHS, start=1):
        out = out.when(F.lit(full).startswith(n), i)
    return out


def _date(y: Column, m: Column, d: Column) -> Column:
    return F.try_to_date(F.format_string("%04d-%02d-%02d", y, m, d), "yyyy-MM-dd")


def order_votes(c: str | Column, rows: str | Column | None = None) -> tuple[Column, Column]:
    """Aggregates: texts that can only be day first, and only month first;
    ``rows`` is how many rows a text stands for, one if not given."""
    s = date_part(c)
    a, b = _number(s, YEAR_LAST, 1), _number(s, YEAR_LAST, 2)
    day, month = (a > 12) & b.between(1, 12), (b > 12) & a.between(1, 12)
    if rows is None:
        return F.count_if(day), F.count_if(month)
    return tuple(F.coalesce(F.sum(F.when(v, col_of(rows))), F.lit(0).cast("long")) for v in (day, month))


def parse_date_text(c: str | Column, dayfirst: bool | Column = False) -> Column:
    """The date of a text; ``dayfirst`` settles those that fit both orders."""
    s = date_part(c)
    get = lambda pattern, group: F.regexp_extract(s, pattern, group)
    num = lambda pattern, group: _number(s, pattern, group)
    a, b, year = num(YEAR_LAST, 1), num(YEAR_LAST, 2), _year(get(YEAR_LAST, 3))
    first = F.lit(dayfirst) if isinstance(dayfirst, bool) else dayfirst
    day_first = F.when(a > 12, True).when(b > 12, False).otherwise(first)
    return (F.when(s.rlike(YEAR_FIRST), _date(num(YEAR_FIRST, 1), num(YEAR_FIRST, 2), num(YEAR_FIRST, 3)))
            .when(s.rlike(YEAR_LAST), _date(year, F.when(day_first, b).otherwise(a), F.when(day_first, a).otherwise(b)))
            .when(s.rlike(EIGHT_DIGITS), _date(num(EIGHT_DIGITS, 1), num(EIGHT_DIGITS, 2), num(EIGHT_DIGITS, 3)))
            .when(s.rlike(DAY_NAME), _date(_year(get(DAY_NAME, 3)), _month(get(DAY_NAME, 2)), num(DAY_NAME, 1)))
            .when(s.rlike(NAME_DAY), _date(_year(get(NAME_DAY, 3)), _month(get(NAME_DAY, 1)), num(NAME_DAY, 2)))
            .when(s.rlike(YEAR_NAME), _date(num(YEAR_NAME, 1), _month(get(YEAR_NAME, 2)), num(YEAR_NAME, 3))))


def with_dates(df: DataFrame, text: str, out: str = "date", tie_dayfirst: bool = False) -> DataFrame:
    """``df`` with the dates of a text column; the order of day and month by
    the vote of all its rows (``tie_dayfirst`` where it is even)."""
    c = F.col(f"`{text}`")
    # stored: their number decides whether the join is a broadcast
    texts = cut_lineage(df.where(c.isNotNull()).groupBy(c.alias("_text")).agg(F.count(F.lit(1)).alias("_rows")))
    day, month = order_votes("_text", "_rows")
    wins = (day >= month) if tie_dayfirst else (day > month)
    first = texts.select(wins.alias("first")).scalar()
    dates = cut_lineage(texts.select("_text", parse_date_text("_text", first).alias("_date")))
    return df.join(dates, c == F.col("_text"), "left").withColumn(out, F.col("_date")).drop("_text", "_date")
