import math
import os
from collections import Counter

import numpy as np
import pytest

from skytune.llm import sp_lattice as S

PIECES = ["▁", "a", "b", "ab", "ba", "▁a", "aba", "▁ab"]
TINY = S.Vocabulary(PIECES + [f"<{i}>" for i in range(256)], [True] * len(PIECES) + [False] * 256, len(PIECES))
needs_model = pytest.mark.skipif(not os.path.exists(S.MODEL), reason="model file not installed")


def all_segmentations(text):
    def of(w):
        if not w:
            return [((), 0.0)]
        return [((PIECES.index(w[:i]), *rest), TINY.weight[PIECES.index(w[:i])] + x)
                for i in range(1, len(w) + 1) if w[:i] in PIECES for rest, x in of(w[i:])]

    full = of("▁" + text.replace(" ", "▁"))
    z = math.log(sum(math.exp(x) for _, x in full))
    return {a: x - z for a, x in full}


@pytest.fixture(scope="module")
def draws():
    text, n = "ab aba", 6000
    return all_segmentations(text), [[(tuple(x.tolist()), p, i) for x, p, i in r]
                                     for r in S.segment(TINY, [text] * n, [S.row_key(i, 1) for i in range(n)], 3)]


def test_probabilities_are_exact_and_samples_distinct(draws):
    p, got = draws
    for r in got:
        assert len({x for x, _, _ in r}) == 3
        assert all(lp == pytest.approx(p[x], abs=1e-9) and li <= 0 for x, lp, li in r)


def test_first_draws_follow_the_distribution(draws):
    p, got = draws
    first = Counter(r[0][0] for r in got)
    for x, lp in p.items():
        q = math.exp(lp)
        assert abs(first[x] / len(got) - q) < 5 * math.sqrt(q / len(got))


def test_second_draws_are_without_replacement(draws):
    p, got = draws
    pairs = Counter((r[0][0], r[1][0]) for r in got)
    top = sorted(p, key=p.get)[-4:]
    for a in top:
        for b in top:
            if a != b:
                q = math.exp(p[a]) * math.exp(p[b]) / (1 - math.exp(p[a]))
                assert abs(pairs[a, b] / len(got) - q) < 5 * math.sqrt(q / len(got))


def test_inclusion_scores_give_unbiased_estimates(draws):
    p, got = draws
    total, length = Counter(), 0.0
    for r in got:
        for x, lp, li in r:
            total[x] += math.exp(lp - li) / len(got)
            length += math.exp(lp - li) * len(x) / len(got)
    for x in sorted(p, key=p.get)[-5:]:
        assert total[x] == pytest.approx(math.exp(p[x]), rel=0.1)
    assert length == pytest.approx(sum(math.exp(lp) * len(x) for x, lp in p.items()), rel=0.05)


def test_fewer_segmentations_than_asked_for():
    got = S.segment(TINY, ["a", "ab"], [1, 2], 50)
    for text, r in zip(["a", "ab"], got):
        assert {tuple(x.tolist()) for x, _, _ in r} == set(all_segmentations(text)) and all(i == 0 for _, _, i in r)


def test_noise_depends_on_the_row_alone():
    texts, keys = ["ab aba ab", "ba ba", "aba"], [5, 6, 7]
    together = S.segment(TINY, texts, keys, 2)
    for t, k, r in zip(texts, keys, together):
        alone, = S.segment(TINY, [t], [k], 2)
        assert [(x.tolist(), p) for x, p, _ in alone] == [(x.tolist(), p) for x, p, _ in r]


def test_fewer_samples_are_the_first_of_more():
    texts, keys = ["ab aba ab" * 30, "ba ba", "aba", "", None], [5, 6, 7, 8, 9]
    many = S.segment(TINY, texts, keys, 9)
    for k in (1, 2, 5):
        for a, b in zip(S.segment(TINY, texts, keys, k), many):
            assert (a is None) == (b is None) and [(x.tolist(), p) for x, p, _ in a or []] == [(x.tolist(), p) for x, p, _ in (b or [])[:k]]


def test_what_is_left_out_of_the_queue_is_never_needed(monkeypatch):
    texts, keys = ["ab aba ab " * n for n in range(1, 80, 6)], list(range(14))
    short = S.segment(TINY, texts, keys, 9)
    monkeypatch.setattr(S, "_HEAD", 2000)              # all siblings of a path at once, none cut off
    monkeypatch.setattr(S.Search, "floor", lambda self: -math.inf)
    for a, b in zip(short, S.segment(TINY, texts, keys, 9)):
        assert [x.tolist() for x, _, _ in a] == [x.tolist() for x, _, _ in b]
        assert [y for _, *y in a] == [pytest.approx(y) for _, *y in b]


def test_words_are_numbered_by_text():
    code, lengths, number, counts = S.distinct_words(["a  b ", None, "", " a", "▁ a\x00", "a\x00"])
    joined = code.tobytes().decode("utf-32-le", "surrogatepass")
    at = np.r_[0, np.cumsum(lengths)]
    words = [joined[a:b] for a, b in zip(at[:-1], at[1:])]
    assert [words[i] for i in number] == ["▁a", "▁▁b", "▁", "▁▁a", "▁\udc81", "▁a\x00", "▁a\x00"]
    assert len(set(words)) == len(words) and counts.tolist() == [3, 0, 0, 1, 2, 1]


@needs_model
def test_the_query_leaves_other_paths_than_the_first(spark, make, tmp_path):
    from skytune.llm.queries import op4_sentencepiece
    rows = [(i, f"the quick brown fox number {i} jumps over the lazy dog and runs away") for i in range(40)] + [(90, None), (91, ""), (92, "\n")]
    make(rows).write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r for r in op4_sentencepiece(spark, str(tmp_path)).collect()}
    assert len(out) == len(rows) and out[90].samples is None and len(out[91].samples) == 1
    assert all(len({s.ids_hash for s in out[i].samples}) == len(out[i].samples) == 8 and out[i].exact for i in range(40))
    other = 0
    for r in S.sample_segmentations(make(rows[:40])).collect():
        ids = [s.ids for s in r.samples]
        shared = [[len(os.path.commonprefix([a, b])) for b in ids[:i]] for i, a in enumerate(ids)]
        other += any(max(n) > n[0] for n in shared[2:])
    assert other > 10


def test_shares_of_arcs_from_plain_sums_and_from_logarithms(monkeypatch):
    letters, lengths, _, _ = S.distinct_words(["ab aba abba", "c" * 300, "aba\n" * 40, "b"])
    plain = S.Lattice(TINY, letters, lengths)                  # the word of 300 c is too unlikely for a double
    monkeypatch.setattr(S, "_PART", 1)
    alone = S.Lattice(TINY, letters, lengths)
    monkeypatch.setattr(S, "_SMALL", math.inf)
    logs = S.Lattice(TINY, letters, lengths)
    for a, b in ((plain, alone), (alone, logs)):
        assert a.piece.tolist() == b.piece.tolist() and a.to.tolist() == b.to.tolist()
        assert a.logp == pytest.approx(b.logp, abs=1e-9) and np.abs(a.below - b.below).max() <= 2
    for n in range(len(plain.last)):
        assert plain.below[plain.first[n]] == 0 and math.exp(plain.logp[plain.first[n]:plain.last[n] + 1].max()) <= 1 + 1e-9


def test_runs_of_texts_share_a_lattice(monkeypatch):
    texts, keys = ["ab aba ab", None, "", "ba ba " * 9, "aba", " ", "b a"] * 3, list(range(21))
    whole = S.segment(TINY, texts, keys, 8)
    monkeypatch.setattr(S, "_WORDS", 7)
    parts = [(lo, hi, drawn) for lo, hi, *_, drawn in S.draws(TINY, texts, keys, 8)]
    assert len(parts) > 3 and [lo for lo, *_ in parts[1:]] == [hi for _, hi, _ in parts[:-1]] and parts[-1][1] == 21
    assert all(sum(len((t or "").split()) for t in texts[lo:hi]) <= 7 + 18 for lo, hi, _ in parts)       # and one text
    for a, b in zip(whole, S.segment(TINY, texts, keys, 8), strict=True):
        assert (a is None) == (b is None) and [(x.tolist(), p, i) for x, p, i in a or []] == [(x.tolist(), p, i) for x, p, i in b or []]


@needs_model
def test_digests_are_compiled(spark, make, tmp_path):
    import contextlib
    import io
    import re

    from skytune.llm.queries import op4_sentencepiece
    make([(1, "a b c"), (2, None)]).write.parquet(f"{tmp_path}/documents.parquet")
    said = io.StringIO()
    with contextlib.redirect_stdout(said):
        op4_sentencepiece(spark, str(tmp_path)).explain("codegen")
    codes = said.getvalue().split("== Subtree ")[1:]
    hashed = [x for x in codes if "xxhash64" in x]
    assert hashed and all(int(re.search(r"maxMethodCodeSize:(\d+)", x)[1]) < 8000 for x in hashed)      # more is never compiled by the JVM


@needs_model
def test_round_trip_of_any_text():
    vocab = S.Vocabulary.load()
    rng = np.random.default_rng(0)
    texts = ["", " ", "  ", "a", " a ", "a  b\n\tc", "▁", " ▁ x▁", "漢字🙂\x00\x7f", "ﬁ²½", "<s> </s> <0x0A> <unk>", "a" * 20_000, " " * 3000,
             "".join(chr(c) for c in rng.integers(32, 0xD7FF, 2000))]
    for t, r in zip(texts, S.segment(vocab, texts, list(range(len(texts))), 3)):
        assert all(S.decode(vocab, x) == t for x, _, _ in r)
        assert all(0 <= i < vocab.size for x, _, _ in r for i in x.tolist())


@needs_model
def test_edges(make, edge_rows):
    df = make(edge_rows, clash=True)
    out = S.sample_segmentations(df).collect()
    assert len(out) == len(edge_rows)
    for r in out:
        if r.text is None:
            assert r.samples is None and r.exact is None
        else:
            assert r.exact and 1 <= len(r.samples) <= S.SAMPLES
            assert len({tuple(s.ids) for s in r.samples}) == len(r.samples)
    a, b = [r for r in out if r.doc_id == 7]
    assert a.samples == b.samples
    assert S.sample_segmentations(make([])).count() == 0


def test_a_lattice_is_not_held_twice_while_it_is_built(monkeypatch):
    import tracemalloc
    rng = np.random.default_rng(2)
    text = " ".join("".join(w) for w in rng.choice(list("ab"), size=(60_000, 14)))
    letters, lengths, _, _ = S.distinct_words([text])
    monkeypatch.setattr(S, "_PART", 1000)
    tracemalloc.start()
    lat = S.Lattice(TINY, letters, lengths)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    held = sum(x.nbytes for x in vars(lat).values() if isinstance(x, np.ndarray))
    assert peak < 1.36 * held
