import math
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from skytune.llm import quality as Q

LABELS = "doc_id long, quality int, toxic int"


def brute_counts(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    n = Counter(grams)
    hit = {p for i, g in enumerate(grams) if n[g] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in Q.SYMBOLS for c in t or ""), len(lines) - len(set(lines)), len(hit))


def cdf(k, n, a):
    a = Fraction(a)
    return float(sum(math.comb(n, i) * a**i * (1 - a)**(n - i) for i in range(k + 1)))


def test_counts_against_brute_force(make, edge_rows):
    rng = np.random.default_rng(0)
    rows = [r[:2] for r in edge_rows] + [(100 + i, " ".join(rng.choice(["a", "bb", "c#", "d\n", "e\t"], rng.integers(0, 120)))) for i in range(40)]
    got = sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
                 if r.doc_id is not None else (-1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
                 for r in Q.base_counts(make([(*r, "en", "s") for r in rows], clash=True)).collect())
    assert got == sorted((-1 if d is None else d, *brute_counts(t)) for d, t in rows)


@pytest.mark.parametrize("a", [0.01, 0.2])
def test_binomial_is_exact(spark, a):
    cases = [(k, n) for n in (1, 5, 30, 200, 1000) for k in range(0, int(a * n) + 1, max(1, n // 100))]
    df = spark.createDataFrame(cases, "k long, n long")
    for r in df.withColumn("p", Q.binomial_cdf(F.col("k"), F.col("n"), a)).collect():
        assert r.p == pytest.approx(cdf(r.k, r.n, str(a)), rel=1e-10)
    far = spark.createDataFrame([(0, 0), (50, 60), (90_000, 10_000_000)], "k long, n long")
    assert [r.p for r in far.withColumn("p", Q.binomial_cdf(F.col("k"), F.col("n"), 0.01)).orderBy("n").collect()][:2] == [1.0, 1.0]


def corpus(seed=0, good=900, bad=300):
    rng = np.random.default_rng(seed)
    word = lambda n: ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 8))) for _ in range(n)]
    rows, labels = [], []
    for lang in ("en", "de"):
        for i in range(good + bad):
            d = len(rows)
            w = word(80)
            if i >= good:
                w = [x + "###" for x in w]
            rows.append((d, " ".join(w), lang, "s"))
            labels.append((d, int(i < good), 0))
    return rows, labels


def test_rules_part_good_from_bad(make, spark):
    rows, labels = corpus()
    out = Q.score_quality(make(rows), spark.createDataFrame(labels, LABELS)).collect()
    good = dict((d, q) for d, q, _ in labels)
    assert all(r.kept == bool(good[r.doc_id]) for r in out)
    assert all("symbols" in r.rejected_by for r in out if not r.kept)


def test_false_rejections_stay_within_alpha(make, spark):
    rng = np.random.default_rng(8)                  # overlapping classes: a greedy cutoff would reject good ones
    rows, labels = [], []
    for d in range(2500):
        g = int(rng.random() < 0.7)
        n = int(rng.binomial(80, 0.02 if g else 0.3))
        rows.append((d, " ".join("ab%d" % rng.integers(10**6) + ("#" if i < n else "") for i in range(80)), "en", "s"))
        labels.append((d, g, 0))
    out = {r.doc_id: r for r in Q.score_quality(make(rows), spark.createDataFrame(labels, LABELS)).collect()}
    good = [out[d] for d, g, _ in labels if g]
    assert sum(not r.kept for r in good) <= Q.ALPHA * len(good)
    assert sum(not out[d].kept for d, g, _ in labels if not g) > 0.5 * sum(not g for _, g, _ in labels)


def test_edges(make, spark, edge_rows):
    rows, labels = corpus(good=50, bad=20)
    few = Q.score_quality(make(rows), spark.createDataFrame(labels, LABELS)).collect()
    assert all(r.kept for r in few)                 # too few labels certify nothing
    odd = spark.createDataFrame([(None, 1, 0), (4, None, 0), (5, 0, None), (5, 1, 0), (77777, 1, 1)], LABELS)
    out = Q.score_quality(make(edge_rows, clash=True), odd).collect()
    assert len(out) == len(edge_rows)
    assert all(r.base_failed and not r.kept and r.n_words == 0 for r in out if r.doc_id in (1, 2, 3, 10))
    assert Q.score_quality(make([]), spark.createDataFrame([], LABELS)).count() == 0
    assert Q.score_quality(make(rows[:3]), spark.createDataFrame([], LABELS)).count() == 3


def test_more_languages_than_strata(make, spark):
    rows, labels = corpus(good=1000, bad=200)
    out = Q.score_quality(make(rows), spark.createDataFrame(labels, LABELS), max_strata=1).collect()
    good = dict((d, q) for d, q, _ in labels)
    assert all(r.kept == bool(good[r.doc_id]) for r in out)
