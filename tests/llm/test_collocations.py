import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skytune.llm import collocations as C

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, top, least):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            ws = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in (1, 2, 3):
                for i in range(len(ws) - k + 1):
                    f[lang, tuple(ws[i:i + k])] += 1
    found = {}
    for (lang, g), a in f.items():
        if len(g) > 1 and a >= least:
            score, k = min((10**6 * a * a // (f[lang, g[:k]] * f[lang, g[k:]]), k) for k in range(1, len(g)))
            found[lang, g] = (a, f[lang, g[:k]], f[lang, g[k:]], score)
    gone = {(lang, part) for (lang, g), (a, *_) in found.items() if len(g) == 3 for part in (g[:2], g[1:])
            if (lang, part) in found and 100 * a >= 50 * found[lang, part][0]}
    out = []
    for lang in n:
        best = sorted((-s, -a, " ".join(g).encode(), l, r) for (x, g), (a, l, r, s) in found.items() if x == lang and (x, g) not in gone)
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(best[:top])]
    return sorted(out)


def run(spark, rows, top, extra=False):
    df = spark.createDataFrame(rows, "text string, lang string")
    df = df.repartition(3) if rows else df
    if extra:
        df = df.withColumns({c: F.lit(f"own {c}") for c in ("h", "h1", "n", "a", "l", "r", "score", "word", "rank", "phrase")})
    out = C.collocations(df, top=top)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in out.collect())


def texts(seed, docs=120, words=60):
    rnd = random.Random(seed)
    vocab = ["Étoile", "the", "OF", "new", "York", "city", "a-b", "#1", "x", "|"] + [f"w{i}" for i in range(8)]
    weights = [1 / (i + 1) for i in range(len(vocab))]
    out = []
    for i in range(docs):
        ws = rnd.choices(vocab, weights, k=words)
        for _ in range(4):
            ws.insert(rnd.randrange(len(ws)), rnd.choice(["New York City", "san\tfrancisco bay", "bay area", "state of the art", "of the, end"]))
        out.append((rnd.choice([" ", "  ", "\n", ". "]).join(ws), rnd.choice(["en", "fr", None])))
    return out


@pytest.mark.parametrize("top", [2000, 7])
def test_equals_brute_force(spark, top, monkeypatch):
    if top == 7:                          # several rounds, small flushes
        monkeypatch.setattr(C, "FIRST", 1)
        monkeypatch.setattr(C, "WIDEN", 2)
        monkeypatch.setattr(C, "HELD", 500)
        monkeypatch.setattr(C, "SLICE", 300)
    rows = texts(top)
    assert run(spark, rows, top) == brute(rows, top, 10)


def test_more_rounds_follow_where_pairs_go(spark, monkeypatch):
    """The best pairs all lie inside phrases as frequent as they are, so the
    first thresholds do not settle the report."""
    monkeypatch.setattr(C, "FIRST", 1)
    monkeypatch.setattr(C, "WIDEN", 2)
    calls = []
    plain = C.count_phrases
    monkeypatch.setattr(C, "count_phrases", lambda *a: calls.append(a[2]) or plain(*a))
    rows = [(f"p{i} q{i} r{i}. " * 12, "en") for i in range(6)] + [("aa bb. " * 11 + "aa cc. " * 30 + "dd bb. " * 30 + "bb. cc. " * 5, "en")]
    assert run(spark, rows, 8) == brute(rows, 8, 10)
    assert calls.count(3) > 1


def test_edges(spark):
    rows = [(None, None), ("", "en"), (" \t ", "en"), ("\n.,;", None), ("one two " * 200_000, "long"), ("ß\x00é 漢 " * 12, "und"),
            ("ß\x00é 漢 " * 12, None), ("A b c " * 15, "x"), ("ties a. ties b. " * 20, "y"), ("ties a. ties b. " * 20, "y")]
    assert run(spark, rows, 5, extra=True) == brute(rows, 5, 10)
    assert run(spark, [], 5) == []


def test_slices_end_at_pieces(monkeypatch):
    text = ("alpha beta. gamma delta epsilon! " * 50).encode()
    raw, off = np.frombuffer(text, np.uint8), np.array([0, 100, 100, len(text)])
    want = [tuple(x.tolist() for x in (h, size, t)) for _, h, _, _, size, t in C.words_of(raw, off, np.zeros(3, np.uint64), C.letters(0))]
    monkeypatch.setattr(C, "SLICE", 40)
    parts = [(h.tolist(), size.tolist(), t.tolist()) for _, h, _, _, size, t in C.words_of(raw, off, np.zeros(3, np.uint64), C.letters(0))]
    assert len(parts) > 10 and [sum((p[i] for p in parts), []) for i in range(3)] == list(want[0])


def test_scores_are_exact(spark):
    a, l, r = 10**15 + 3, 3 * 10**15 + 7, 2 * 10**15 + 9
    got = spark.range(1).select(C.cut_score(F.lit(a), F.lit(l), F.lit(r)).alias("s")).first()["s"]
    assert got == 10**6 * a * a // (l * r)
