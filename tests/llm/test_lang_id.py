import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skytune.llm import lang_id as L

WORDS = {"en": "the of and that with from this which have been".split(), "de": "der die und das nicht mit eine auch sich werden".split(),
         "fr": "le les des une dans pour que qui sur avec".split(), "es": "el los las una para por con del como pero".split()}


def corpus(n=200, langs=("en", "de", "fr", "es")):
    rng = np.random.default_rng(0)
    return [(i, " ".join(rng.choice(WORDS[lang], 30)) + f" {i}", lang, "s") for i, lang in enumerate(rng.choice(langs, n))]


def test_held_out_accuracy(make):
    rows = corpus()
    df = make(rows)
    out = {r.doc_id: r for r in L.identify(df).withColumn("h", L.held_out(F.col("doc_id"))).collect()}
    assert all(r.h == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in out.items())
    assert np.mean([out[d].lang_pred == lang for d, _, lang, _ in rows if out[d].h]) > 0.98
    assert all(0 <= r.score <= 1 for r in out.values())


def test_only_text_of_training_rows_is_learned(make):
    rows = corpus()
    swapped = [(d, t, ("xx" if zlib.crc32(str(d).encode()) % 3 == 1 else lang), "other") for d, t, lang, _ in rows]
    get = lambda rs: {r.doc_id: (r.lang_pred, r.score) for r in L.identify(make(rs)).collect()}
    assert get(rows) == get(swapped)


@pytest.mark.parametrize("n", [2, 3, 4, 5, 9, 40])
def test_codewords_keep_their_distance(n):
    c = L.codewords(n)
    assert c.shape[0] == n and len({tuple(x) for x in c}) == n
    d = [(c[i] != c[j]).sum() for i in range(n) for j in range(i)]
    assert min(d) == max(d)


def test_one_wrong_bit_is_corrected():
    code = L.codewords(4)
    m = L.Model(list("abcd"), code, np.zeros((L.DIMENSIONS, code.shape[1])))
    for i in range(4):
        for b in range(code.shape[1]):
            bits = code[i].astype(float)
            bits[b] *= -1
            assert np.argmin(m.losses(bits)) == i


def test_a_mixed_text_is_ambiguous(make):
    rows = corpus(300, ("en", "de"))
    mixed = " ".join(WORDS["en"] * 10 + WORDS["de"] * 10)
    out = {r.doc_id: r for r in L.identify(make([*rows, (9000, mixed, None, "s")])).collect()}
    clear = [r.score for d, r in out.items() if d < 9000]
    assert out[9000].score < min(clear)


def test_edges(make, edge_rows):
    out = L.identify(make([*corpus(60), *[(d if d is None else d + 500, *r) for d, *r in edge_rows]], clash=True)).collect()
    assert len(out) == 60 + len(edge_rows)
    for r in out:
        if r.doc_id in (501, 502, 503, 510, 512):
            assert (r.lang_pred, r.score, r.ambiguous) == ("und", 0.0, True)
        else:
            assert r.lang_pred in {"en", "de", "fr", "es"}
    assert L.identify(make([])).count() == 0
    assert {(r.lang_pred, r.score) for r in L.identify(make([(i, "hello", None, "s") for i in range(5)])).collect()} == {("und", 0.0)}
    assert {(r.lang_pred, r.score) for r in L.identify(make([(i, "hello", "en", "s") for i in range(9)])).collect()} == {("en", 1.0)}


def test_pieces_of_a_long_text_count_like_the_whole():
    text = ("der die das und " * 20_000)
    assert abs(sum(len(L.ngrams(p)) for p in L._pieces(text)) - len(L.ngrams(text))) < 40


@pytest.mark.parametrize("n", [4, 50, 256])
def test_clear_texts_are_not_ambiguous_however_many_languages(n):
    code = L.codewords(n)
    m = L.Model([f"l{i:03}" for i in range(n)], code, np.zeros((1, code.shape[1])))
    for i in (0, n // 2, n - 1):
        m.margins = lambda text, i=i: code[i].astype(float)
        assert m.predict("clear")[::2] == (f"l{i:03}", False)
        m.margins = lambda text, i=i: (code[i] + code[(i + 1) % n]) / 2
        assert m.predict("half and half")[2]


def brute(train, texts):
    """The same classifier written out, one language and one n-gram at a time."""
    from collections import Counter
    from math import exp, log
    langs = sorted({lang for _, _, lang in train if len(L.ngrams_any(_text(train, lang)))})
    code = L.codewords(len(langs))
    counts = {x: Counter() for x in langs}
    for _, t, lang in train:
        if lang in counts:
            counts[lang].update(L.ngrams(t or "").tolist())
    share = lambda x, g: (counts[x][g] + L.SMOOTHING) / (sum(counts[x].values()) + L.SMOOTHING * L.DIMENSIONS)

    def margin(text, b):
        gs = L.ngrams(text).tolist()
        on, off = ([x for x, c in zip(langs, code) if (c[b] > 0) == side] for side in (True, False))
        w = {g: log(sum(share(x, g) for x in on) / len(on)) - log(sum(share(x, g) for x in off) / len(off)) for g in set(gs)}
        return sum(w[g] for g in gs) / len(gs)

    bits = range(code.shape[1])
    fitted = [(langs.index(lang), [margin(t, b) for b in bits]) for _, t, lang in train]
    spread = [max(sum(abs(m[b]) for _, m in fitted) / len(fitted), 1e-6) for b in bits]
    weight = []
    for b in bits:
        right = (sum((m[b] > 0) == (code[i][b] > 0) for i, m in fitted) + 1) / (len(fitted) + 2)
        weight.append(max(log(right / (1 - right)), 1e-3))
    out = []
    for t in texts:
        m = [max(-8, min(8, margin(t, b) / spread[b])) for b in bits]
        loss = [sum(weight[b] * exp(-c[b] * m[b]) for b in bits) / sum(weight) for c in code]
        p = [exp(min(loss) - x) for x in loss]
        out.append((langs[p.index(max(p))], max(p) / sum(p)))
    return out


def _text(train, lang):
    return " ".join(t or "" for _, t, x in train if x == lang)


@pytest.mark.parametrize("most", [256, 3])
def test_equals_a_version_written_out(make, monkeypatch, most):
    monkeypatch.setattr(L, "HADAMARD", most)
    monkeypatch.setattr(L, "RANDOM_BITS", 24)
    rows = corpus(36)
    train = [(d, t, lang) for d, t, lang, _ in rows if zlib.crc32(str(d).encode()) % 3 != 1]
    got = {r.doc_id: (r.lang_pred, r.score) for r in L.identify(make(rows)).collect()}
    for (d, t, _, _), (lang, score) in zip(rows, brute(train, [t for _, t, _, _ in rows])):
        assert got[d][0] == lang and got[d][1] == pytest.approx(score, rel=1e-4)


def test_every_language_is_learned(make, monkeypatch):
    """More languages than the Hadamard words serve, some with few rows."""
    monkeypatch.setattr(L, "HADAMARD", 8)
    monkeypatch.setattr(L, "RANDOM_BITS", 64)
    rng = np.random.default_rng(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = {f"l{i:02}": ["".join(rng.choice(list(letters), 6)) for _ in range(8)] for i in range(20)}
    rows = [(1000 * j + i, " ".join(rng.choice(words[x], 25)), x, "s") for j, x in enumerate(words) for i in range(6 if j % 2 else 12)]
    out = {r.doc_id: r for r in L.identify(make(rows)).collect()}
    held = [(d, x) for d, _, x, _ in rows if zlib.crc32(str(d).encode()) % 3 == 1]
    assert np.mean([out[d].lang_pred == x for d, x in held]) > 0.97 and {out[d].lang_pred for d, _ in held} == {x for _, x in held}
