"""Quality rules with risk-controlled cutoffs, in DataFrame functions alone.

Base counts come from each whole text; ``SIGNALS`` are integers per mille made
of them.  A rule rejects a document whose signal is above the rule's cutoff in
its stratum (its ``lang``).  Cutoffs are not set by hand: on labelled
documents, each cutoff of a fixed grid is tested against H0 "it rejects more
than ALPHA / number of rules of the good documents of this stratum", with the
exact binomial p-value P(Bin(n, a) <= k) for k of n good documents rejected.

Multiple testing: the grid of one rule is walked from the most lenient cutoff
on and stops at the first that fails (fixed-sequence testing, no correction
needed inside a grid); rules and strata are corrected by Bonferroni.  So with
probability 1 - DELTA every certified cutoff of every stratum holds its share
of ALPHA, and together the rules reject at most ALPHA of a stratum's good
documents.  Among the certified ones the cutoff that best parts bad from good
(share of bad less share of good rejected) is taken, the most lenient on ties;
where none parts them, or too few labels certify any, the rule is off.

Strata: every language with labels is its own; null and languages without any
share one.  (``max_strata`` makes the smaller ones share it too.)  A rule needs
hundreds of good labels to be certified, so the cutoff table holds a small part
of the number of labels; Spark broadcasts it where its size allows.

Defined results: null or empty text: all counts 0, base_failed.  Labels with a
null quality or doc_id are left out; of several labels of a document the lowest
counts.  Without labels only the base rules act.  Repeated rows each give a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, stored

ALPHA = 0.05
DELTA = 0.05
MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"
SHARES = [5, 10, 20, 40, 60, 80, 100, 150, 200, 250, 300, 400, 500, 600, 700, 800, 900]
LENGTHS = [4000, 5000, 6000, 7000, 8000, 9000, 10000, 12000, 15000, 20000, 30000]
#: signal -> (numerator, denominator, grid of cutoffs)
SIGNALS = {
    "symbols": ("n_symbols", "word_chars", SHARES),
    "repeats": ("n_repeat_words", "n_words", SHARES),
    "dup_lines": ("n_dup_lines", "n_lines", SHARES),
    "capitals": ("n_capitals", "word_chars", SHARES),
    "exclaims": ("n_exclaims", "word_chars", SHARES),
    "digits": ("n_digits", "word_chars", SHARES),
    "long_words": ("word_chars", "n_words", LENGTHS),
}
_EXACT_TERMS = 20_000


def _let(value: Column, body) -> Column:
    """``body(v)`` with ``value`` worked out once, inside nested lambdas too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _count(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def split_words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, BLANKS, " " * len(BLANKS)), " ", -1), "")


def repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more."""

    def covered(w):
        hashes = F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))),
                             lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
        return _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
            _let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), marked)))

    def marked(s):
        def same(x, i):
            near = F.get(s, i)["h"] == x["h"]
            return F.coalesce(near, F.lit(False))
        at = F.sort_array(F.transform(F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"]))
        return F.aggregate(
            at, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
            lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n")),
            lambda acc: acc["n"])

    return _let(words, covered).cast("long")


def base_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the base counts of ``text``."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    counts = df.withColumns({
        "n_repeat_words": F.coalesce(repeat_words(split_words(t)), F.lit(0).cast("long")),
        "n_words": F.size(split_words(t)).cast("long"),
        "word_chars": F.length(F.translate(t, BLANKS, "")).cast("long"),
        "n_symbols": _count(t, SYMBOLS),
        "n_capitals": _count(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "n_exclaims": _count(t, "!"),
        "n_digits": _count(t, "0123456789"),
        "_lines": _let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d"))),
    })
    return counts.withColumns({
        "n_lines": F.col("_lines.n").cast("long"), "n_dup_lines": F.col("_lines.d").cast("long"),
        "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
    }).drop("_lines")


def _signal(num: str, den: str) -> Column:
    return F.when(F.col(den) > 0, F.floor(1000 * F.col(num) / F.col(den))).otherwise(0).cast("long")


def _log_factorial(n: Column) -> Column:
    """ln n!: exact up to 20, Stirling's series (error below 1e-13) beyond."""
    x = n.cast("double") + 1
    series = ((x - 0.5) * F.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x * x * x)
              + 1 / (1260 * F.pow(x, F.lit(5.0))) - 1 / (1680 * F.pow(x, F.lit(7.0))))
    return F.when(n <= 20, F.log(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def binomial_cdf(k: Column, n: Column, a: float) -> Column:
    """P(Bin(n, a) <= k) for k <= a n; 1 above, where no test can reject.  The
    terms from k downwards fall at a growing rate; beyond ``_EXACT_TERMS`` the
    rest is replaced by a geometric bound, so the value is never too small."""
    odds = (1 - a) / a
    k_, n_ = k.cast("double"), n.cast("double")
    top = _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k_ * F.log(F.lit(a)) + (n_ - k_) * F.log(F.lit(1 - a))
    terms = F.least(k, F.lit(_EXACT_TERMS))
    steps = F.when(terms > 0, F.sequence(F.lit(1).cast("long"), F.greatest(terms, F.lit(1)))).otherwise(F.array().cast("array<long>"))

    def more(acc, i):
        t = acc["t"] * (k_ - i + 1) * odds / (n_ - k_ + i)
        return F.struct(t.alias("t"), (acc["s"] + t).alias("s"))

    def close(acc):
        rate = (k_ - terms) * odds / (n_ - k_ + terms + 1)
        return acc["s"] + F.when(k > terms, acc["t"] * rate / (1 - rate)).otherwise(0.0)

    one = F.lit(1.0)
    ratio = F.aggregate(steps, F.struct(one.alias("t"), one.alias("s")), more, close)
    return F.when((n > 0) & (k_ <= a * n_), F.least(one, F.exp(top) * ratio)).otherwise(one)


def certified_cutoffs(labelled: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """``labelled(stratum, good, <signals>)`` -> ``(stratum, signal, cutoff)``,
    a row for each rule that is on."""
    a = alpha / len(SIGNALS)
    per_signal = F.array(*[
        F.struct(F.lit(s).alias("signal"),
                 F.expr(f"size(filter(array({', '.join(map(str, grid))}), c -> c < `{s}`))").alias("above"))
        for s, (_, _, grid) in SIGNALS.items()])
    hist = (labelled.select("stratum", "good", F.explode(per_signal).alias("x"))
            .groupBy("stratum", "x.signal", "x.above")
            .agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad")))
    grid = F.array(*[F.struct(F.lit(s).alias("signal"), F.lit(j).alias("place"), F.lit(c).cast("long").alias("cutoff"))
                     for s, (_, _, g) in SIGNALS.items() for j, c in enumerate(g)])
    cuts = hist.select("stratum").distinct().select("stratum", F.explode(grid).alias("g")).select("stratum", "g.*")
    found = (cuts.join(hist, ["stratum", "signal"])
             .groupBy("stratum", "signal", "place", "cutoff")
             .agg(F.sum("good").alias("n_good"), F.sum("bad").alias("n_bad"),
                  F.sum(F.when(F.col("above") > F.col("place"), F.col("good")).otherwise(0)).alias("k_good"),
                  F.sum(F.when(F.col("above") > F.col("place"), F.col("bad")).otherwise(0)).alias("k_bad")))
    strata = hist.select("stratum").distinct().agg(F.count(F.lit(1)).alias("strata"))
    walk = Window.partitionBy("stratum", "signal").orderBy(F.col("cutoff").desc())
    passed = (found.crossJoin(F.broadcast(strata))
              .withColumn("p", binomial_cdf(F.col("k_good"), F.col("n_good"), a))
              .withColumn("ok", F.min((F.col("p") <= F.lit(delta) / (F.col("strata") * len(SIGNALS))).cast("int")).over(walk))
              .withColumn("gain", F.col("k_bad") * F.col("n_good") - F.col("k_good") * F.col("n_bad"))
              .where("ok = 1 AND gain > 0"))
    return passed.groupBy("stratum", "signal").agg(F.max_by("cutoff", F.struct("gain", "cutoff")).alias("cutoff"))


def score_quality(df: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang",
                  alpha: float = ALPHA, delta: float = DELTA, max_strata: int | None = None) -> DataFrame:
    """doc_id, the base counts, the signals, ``base_failed``, ``rejected_by``
    (names of the certified rules that reject) and ``kept``."""
    counted = base_counts(df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"),
                                    F.concat(F.lit("="), F.col(f"`{lang}`")).alias("stratum"))).drop("text")
    counted = stored(counted.withColumns({s: _signal(num, den) for s, (num, den, _) in SIGNALS.items()}))
    one_label = (labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
                 .groupBy("doc_id").agg(F.min(F.when(F.col("quality") > 0, 1).otherwise(0)).alias("good")))
    labelled = counted.where(~F.col("base_failed")).join(one_label, "doc_id")
    own = labelled.where("stratum IS NOT NULL").groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))
    if max_strata is not None:
        own = own.orderBy(F.desc("n"), "stratum").limit(max_strata)
    own = stored(own.select("stratum", F.col("stratum").alias("own")))
    labelled = labelled.join(own, "stratum", "left").withColumn("stratum", F.coalesce("own", F.lit("other")))
    cutoffs = (certified_cutoffs(labelled, alpha, delta).groupBy("stratum")
               .agg(F.map_from_entries(F.collect_list(F.struct("signal", "cutoff"))).alias("cuts")))
    cutoffs = stored(cutoffs)
    judged = (counted.join(own, "stratum", "left").drop("stratum").withColumn("stratum", F.coalesce("own", F.lit("other")))
              .join(cutoffs, "stratum", "left"))
    rejected = F.array_compact(F.array(*[
        F.when(F.col(s) > F.try_element_at("cuts", F.lit(s)), F.lit(s)) for s in SIGNALS]))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         *SIGNALS, F.array_join(rejected, ",").alias("rejected_by"),
                         (~F.col("base_failed") & (F.size(rejected) == 0)).alias("kept"))
