"""Secrets in texts: three fixed patterns, and strings that pass a battery of
randomness tests.  DataFrame functions alone.

Base spans, leftmost and not overlapping per kind: ``assign`` (a credential
name, a separator, a value of 12 characters or more), ``access`` (an access key
id of 18 or more), ``hex`` (a run of 16 or more lower-case hex digits).

Battery, over every run of 20 or more ``[A-Za-z0-9+/_-]`` outside base spans.
The encoding is inferred (the smallest alphabet of k characters that holds the
run).  Null hypothesis: the run is made like words or names, so the tests look
for evidence *of* randomness:

* chi-squared: Pearson's statistic against a uniform alphabet; words exceed
  it by (n - 1) * excess(k); z is how far the statistic stays below that;
* runs: changes between digits, capitals, small letters and the rest; words
  change class at most at a rate of ``CHANGE_RATE``;
* serial correlation: the lag-1 correlation of places in the alphabet; words
  have at least ``CORRELATION`` in size, random strings about 0.

The three z are combined (Stouffer), p = exp(-z^2 / 2) / 2, an upper bound of
the normal tail.  All three gain power with the length.  False discoveries are
controlled per class of length (Benjamini-Hochberg at ``FDR``), so that many
short runs do not pay for few long ones; p goes in steps of a tenth of a
decade, rounded up, so the step-up runs on a small histogram and never sorts
the corpus.

Spans are code points, end exclusive.  A null text is empty; an empty table
gives an empty table; repeated rows each give a row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

# Fixed patterns of the base kinds, in the order in which ties are listed.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "random")
MIN_VALUE = 12
RUN = r"[A-Za-z0-9+/_-]{20,}"
ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_-"
#: (pattern, characters in the alphabet, excess of chi-squared per character in words)
ENCODINGS = [
    (r"^([0-9a-f]+|[0-9A-F]+)$", 16, 0.6),
    (r"^[A-Z2-7]+$", 32, 1.1),
    (r"^([a-z0-9]+|[A-Z0-9]+)$", 36, 1.4),
    (r"^[A-Za-z0-9]+$", 62, 3.1),
    (r"", 64, 3.3),
]
CHANGE_RATE = 0.25
CORRELATION = 0.3
FDR = 0.001
LENGTH_CLASSES = (32, 64, 128)
_STEPS = 3000
_BLOCK = 256


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _positions(steps: Column) -> Column:
    """``array<struct(gap, size)>`` of text between matches and matches ->
    ``array<struct(s, e)>``.  Summed in blocks: linear, not quadratic."""
    empty = F.expr("cast(array() as array<struct<s:int,e:int>>)")
    starts = F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / F.lit(_BLOCK)).cast("int"))
    blocks = F.transform(starts, lambda b: F.slice(steps, b * _BLOCK + 1, F.lit(_BLOCK)))

    def walk(block):
        return F.aggregate(
            block, F.struct(F.lit(0).alias("at"), empty.alias("out")),
            lambda acc, x: F.struct((acc["at"] + x["gap"] + x["size"]).alias("at"), F.array_append(
                acc["out"], F.struct((acc["at"] + x["gap"]).alias("s"), (acc["at"] + x["gap"] + x["size"]).alias("e"))).alias("out")))

    nested = F.expr("cast(array() as array<array<struct<s:int,e:int>>>)")
    return F.flatten(F.aggregate(
        F.transform(blocks, walk), F.struct(F.lit(0).alias("at"), nested.alias("out")),
        lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.array_append(acc["out"], F.transform(
            x["out"], lambda y: F.struct((y["s"] + acc["at"]).alias("s"), (y["e"] + acc["at"]).alias("e")))).alias("out")),
        lambda acc: acc["out"]))


def _matches(text: Column, pattern: str, group: int = 0) -> Column:
    """``array<struct(s, e, v)>``: span of each match and the group's text."""
    p = F.lit(pattern)

    def found(all_):
        return _let(F.split(text, pattern, -1), lambda gaps: _let(
            _positions(F.transform(all_, lambda m, i: F.struct(
                F.length(F.get(gaps, i)).alias("gap"), F.length(m).alias("size")))),
            lambda at: F.zip_with(at, F.regexp_extract_all(text, p, F.lit(group)),
                                  lambda a, v: F.struct(a["s"].alias("s"), a["e"].alias("e"), v.alias("v")))))

    none = F.expr("cast(array() as array<struct<s:int,e:int,v:string>>)")
    return F.when(F.rlike(text, p), _let(F.regexp_extract_all(text, p, F.lit(0)), found)).otherwise(none)


def _spans(text: Column) -> Column:
    """Base spans as ``array<struct(s, k, e)>``, in order."""
    kept = F.concat(
        F.transform(F.filter(_matches(text, ASSIGN, 2), lambda m: F.length(m["v"]) >= MIN_VALUE),
                    lambda m: F.struct(m["s"].alias("s"), F.lit(0).alias("k"), m["e"].alias("e"))),
        F.transform(_matches(text, ACCESS), lambda m: F.struct(m["s"].alias("s"), F.lit(1).alias("k"), m["e"].alias("e"))),
        F.transform(_matches(text, HEX), lambda m: F.struct(m["s"].alias("s"), F.lit(2).alias("k"), m["e"].alias("e"))))
    return F.sort_array(kept)


def _class_of(c: Column) -> Column:
    return (F.when((c >= "0") & (c <= "9"), 0).when((c >= "A") & (c <= "Z"), 1)
            .when((c >= "a") & (c <= "z"), 2).otherwise(3))


def battery(run: Column) -> Column:
    """-10 log10 of the combined p-value of one run, as a whole number."""

    def tested(chars):
        n = F.size(chars).cast("double")
        k = F.coalesce(*[F.when(F.rlike(run, F.lit(p)), F.lit(float(k))) for p, k, _ in ENCODINGS])
        excess = F.coalesce(*[F.when(F.rlike(run, F.lit(p)), F.lit(x)) for p, _, x in ENCODINGS])
        squares = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc + F.pow(
            n - F.length(F.replace(run, c, F.lit(""))), F.lit(2.0)))
        chi = k / n * squares - n
        z_chi = (chi - (k - 1) - (n - 1) * excess) / F.sqrt(2 * (k - 1) + 4 * (n - 1) * excess)
        zero = F.lit(0.0)
        walk = F.aggregate(
            chars, F.struct(F.lit(-1).alias("kind"), zero.alias("last"), zero.alias("first"), zero.alias("changes"),
                            zero.alias("x"), zero.alias("xx"), zero.alias("xy")),
            lambda acc, c: _let(F.struct(_class_of(c).alias("kind"), _place(c).alias("at")), lambda now: F.struct(
                now["kind"].alias("kind"), now["at"].alias("last"),
                F.when(acc["kind"] < 0, now["at"]).otherwise(acc["first"]).alias("first"),
                (acc["changes"] + F.when((acc["kind"] >= 0) & (acc["kind"] != now["kind"]), 1.0).otherwise(0.0)).alias("changes"),
                (acc["x"] + now["at"]).alias("x"), (acc["xx"] + now["at"] * now["at"]).alias("xx"),
                (acc["xy"] + F.when(acc["kind"] < 0, 0.0).otherwise(acc["last"] * now["at"])).alias("xy"))))

        def combined(w):
            z_runs = (CHANGE_RATE * (n - 1) - w["changes"]) / F.sqrt(CHANGE_RATE * (1 - CHANGE_RATE) * (n - 1))
            mean = w["x"] / n
            spread = w["xx"] - n * mean * mean
            r = F.when(spread > 1e-9, (w["xy"] - mean * (2 * w["x"] - w["first"] - w["last"]) + (n - 1) * mean * mean) / spread).otherwise(1.0)
            z_serial = (F.abs(r) - CORRELATION) * F.sqrt(n)
            z = (z_chi + z_runs + z_serial) / math.sqrt(3)
            logp = F.when(z < 0, math.log10(0.5) - z * z / 2 / math.log(10)).otherwise(0.0)
            return F.least(F.lit(_STEPS), F.floor(-10 * logp)).cast("int")

        return _let(walk, combined)

    return _let(F.split(run, ""), lambda c: tested(F.filter(c, lambda x: x != "")))


def _place(c: Column) -> Column:
    """Place of a character in ALPHABET, from its code (ASCII runs only)."""
    code = F.ascii(c)
    return (F.when((c >= "0") & (c <= "9"), code - 48).when((c >= "A") & (c <= "Z"), code - 55)
            .when((c >= "a") & (c <= "z"), code - 61).otherwise(F.lit(62))).cast("double")


def length_class(n: Column) -> Column:
    return sum((F.when(n >= x, 1).otherwise(0) for x in LENGTH_CLASSES), F.lit(0))


def scan_secrets(df: DataFrame, text: str = "text", doc_id: str = "doc_id", fdr: float = FDR) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base`` and ``found``: base spans,
    and all spans, as ``array<struct(s, k, e)>`` (k: place in ``KINDS``)."""
    t = F.coalesce(F.col("text"), F.lit(""))
    rows = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    with_base = rows.select("doc_id", _spans(t).alias("base"), _matches(t, RUN).alias("runs"))
    outside = F.filter("runs", lambda m: ~F.exists("base", lambda b: (b["s"] <= m["s"]) & (m["e"] <= b["e"])))
    scored = stored(with_base.select("doc_id", "base", F.transform(outside, lambda m: F.struct(
        m["s"].alias("s"), m["e"].alias("e"), length_class(m["e"] - m["s"]).alias("size"),
        battery(m["v"]).alias("step"))).alias("runs")))
    hist = (scored.select(F.explode("runs").alias("r")).groupBy("r.size", "r.step").agg(F.count(F.lit(1)).alias("n")))
    w = Window.partitionBy("size")
    cut = (hist.withColumn("tail", F.sum("n").over(w.orderBy(F.desc("step"))))
           .withColumn("all", F.sum("n").over(w))
           .where(F.col("all") * F.pow(F.lit(10.0), -F.col("step") / F.lit(10.0)) <= F.lit(fdr) * F.col("tail"))
           .groupBy("size").agg(F.min("step").alias("cut"))
           .agg(F.map_from_entries(F.collect_list(F.struct("size", "cut"))).alias("cuts")))
    random = F.transform(
        F.filter("runs", lambda r: r["step"] >= F.coalesce(F.try_element_at(F.col("cuts"), r["size"]), F.lit(_STEPS + 1))),
        lambda r: F.struct(r["s"].alias("s"), F.lit(3).alias("k"), r["e"].alias("e")))
    count = lambda k: F.size(F.filter("base", lambda b: b["k"] == k)).cast("long")
    return scored.crossJoin(F.broadcast(cut)).select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), "base",
        F.sort_array(F.concat("base", random)).alias("found"))


def joined(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", F.get(kinds, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")
