"""Matching keys for titles, artists and track ids (pure Column expressions).

Spark has no Unicode normaliser, so compatibility folding (NFKD, combining
marks removed) is driven by a map *generated* from ``unicodedata`` over all
code points.  Characters that fold to at most one character are one
``translate``; those that fold to several (ligatures, fractions, units) are
rare, so only texts that hold one go through a second step, a lookup per
character in a literal map.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nulls import col_of


def _fold(ch: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))


@functools.lru_cache(maxsize=1)
def accent_fold_map() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """(matching, replacement, several-letter pairs) derived by rule: every
    code point whose folded form is another text that holds an ASCII letter or
    digit, and every combining mark (no counterpart: ``translate`` deletes it)."""
    src, dst, several, marks = [], [], [], []
    for cp in range(0x80, sys.maxunicode + 1):
        ch = chr(cp)
        if unicodedata.combining(ch):
            marks.append(ch)
            continue
        folded = _fold(ch)
        if folded == ch or not re.search("[A-Za-z0-9]", folded):
            continue
        if len(folded) == 1:
            src.append(ch)
            dst.append(folded)
        else:
            several.append((ch, folded))
    return "".join(src + marks), "".join(dst), tuple(several)


@functools.lru_cache(maxsize=1)
def _several_class() -> str:
    """Regex class of the characters that fold to several, as ranges."""
    codes = sorted(ord(c) for c, _ in accent_fold_map()[2])
    runs: list[list[int]] = []
    for c in codes:
        if runs and c == runs[-1][1] + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "[" + "".join(f"\\x{{{lo:x}}}-\\x{{{hi:x}}}" for lo, hi in runs) + "]"


def strip_accents(c: str | Column) -> Column:
    """Compatibility folding (NFKD, combining marks removed)."""
    x = col_of(c)
    matching, replacement, several = accent_fold_map()
    table = F.str_to_map(F.lit("\x01".join(f"{ch}\x02{to}" for ch, to in several)), F.lit("\x01"), F.lit("\x02"))
    spelled = F.array_join(F.transform(F.split(x, ""), lambda ch: F.coalesce(F.try_element_at(table, ch), ch)), "")
    folded = F.translate(F.when(F.rlike(x, F.lit(_several_class())), spelled).otherwise(x), matching, replacement)
    return F.when(F.rlike(x, F.lit(r"[^\x00-\x7F]")), folded).otherwise(x)          # most texts need nothing


def _strip(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


# Fixed patterns of the matching keys: what stands for nothing in a title or
# artist, in the order of removal (each becomes a space).
NOISE = (r"\(.*?\)", r"\[.*?\]", r"\bfeat\.?\b.*", r"\bfeaturing\b.*", r"\bft\.?\b.*")
#: What is left over, and what it becomes, by variant of the key.
REST = {
    "standard": ((r"[^a-z0-9 ]+", " "), (r"\s+", " ")),
    "compact": ((r"\s+", " "), (r"[^a-z0-9 ]+", "")),
}


def clean_key(c: str | Column, variant: str = "standard") -> Column:
    """Normalised title/artist key; NULL becomes ''.

    ``standard``: symbols become spaces, then spaces are squeezed.  ``compact``
    (older order): spaces are squeezed first and symbols deleted."""
    x = F.replace(strip_accents(_strip(F.lower(col_of(c)))), F.lit("&"), F.lit(" and "))
    for pattern, by in [*((p, " ") for p in NOISE), *REST[variant]]:
        x = F.regexp_replace(x, pattern, by)
    return F.coalesce(_strip(x), F.lit(""))


# Fixed separator pattern for the first artist (applied to the cleaned key).
FIRST_ARTIST_SPLIT = r"\s*(?:,|;|/| x | and )\s*"


def first_artist(c: str | Column, variant: str = "standard") -> Column:
    """Part of the cleaned artist key before the first separator."""
    return first_of_key(clean_key(c, variant))


def first_of_key(key: str | Column) -> Column:
    """X3 of a key that is cleaned already (a projected column)."""
    return _strip(F.split(col_of(key), FIRST_ARTIST_SPLIT, 2).getItem(0))


def strip_blanks(c: str | Column) -> Column:
    """``_strip`` without a regex, for columns of every row."""
    return F.trim(col_of(c), F.lit(" \t\n\x0b\f\r"))


def first_artist_simple(c: str | Column) -> Column:
    """Lower-cased text before the first comma, trimmed."""
    return strip_blanks(F.substring_index(F.lower(col_of(c)), ",", 1))


# Fixed track-id patterns, tried in this order.
TRACK_ID_PATTERNS = (
    r"open\.spotify\.com/track/([A-Za-z0-9]{22})",
    r"spotify:track:([A-Za-z0-9]{22})",
    r"\b([A-Za-z0-9]{22})\b",
)


def track_id(c: str | Column) -> Column:
    """22-character track id from a URL, URI or free text; else NULL."""
    x = col_of(c)
    return F.coalesce(*[F.nullif(F.regexp_extract(x, p, 1), F.lit("")) for p in TRACK_ID_PATTERNS])


def uri_tail(c: str | Column) -> Column:
    """Last '/' segment (trailing slashes removed), then last ':' segment."""
    x = F.regexp_replace(_strip(col_of(c).cast("string")), "/+$", "")
    seg = F.element_at(F.split(x, "/"), -1)
    return F.element_at(F.split(seg, ":"), -1)


def norm_text_key(c: str | Column) -> Column:
    """Trim + lower for equality keys (country, station)."""
    return F.lower(_strip(col_of(c).cast("string")))
