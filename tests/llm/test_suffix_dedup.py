import hashlib

import numpy as np
import pytest

from skytune.llm import suffix_dedup as S


def brute(rows):
    first = {}
    big = 1 << 70
    docs = [(big if d is None else d, (t or "").encode()) for d, t in rows]
    for d, t in docs:
        for p in range(len(t) - 49):
            first[t[p:p + 50]] = min(d, first.get(t[p:p + 50], 2 * big))
    out = []
    for d, t in docs:
        gone = bytearray(len(t))
        for p in range(len(t) - 49):
            if first[t[p:p + 50]] < d:
                gone[p:p + 50] = b"\1" * 50
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((None if d == big else d, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest())
                   for r in S.remove_repeats(df).collect()), key=str)


@pytest.mark.parametrize("alphabet", ["ab", "abcdefgh ", "é漢a "])
def test_against_brute_force(make, alphabet):
    rng = np.random.default_rng(len(alphabet))
    base = ["".join(rng.choice(list(alphabet), 400)) for _ in range(6)]
    rows = []
    for i in range(40):
        a, b = rng.choice(base, 2)
        x, y = rng.integers(0, 350, 2)
        rows.append((int(rng.permutation(1000)[0]) * 100 + i, a[x:x + rng.integers(10, 200)] + "".join(rng.choice(list(alphabet), 5)) + b[y:y + 90]))
    rows += [(99, "a" * 49), (98, "a" * 50), (97, "a" * 51), (10**6, "a" * 300), (10**6 + 1, "ab" * 60), (10**6 + 2, "ba" * 60)]
    assert run(make(rows)) == brute(rows)


def test_edges(make, edge_rows):
    rows = [(d, t if t is None else t[:3000]) for d, t, *_ in edge_rows]
    assert run(make([(*r, "en", "s") for r in rows], clash=True)) == brute(rows)
    assert S.remove_repeats(make([])).count() == 0


def test_multikey_order_is_a_sort():
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 2, (500, 16)).astype(np.uint8)
    w = S.words_of(rows)
    order, new = S.multikey_order(w)
    as_bytes = [rows[i].tobytes() for i in order]
    assert as_bytes == sorted(r.tobytes() for r in rows)
    assert new.tolist() == [i == 0 or as_bytes[i] != as_bytes[i - 1] for i in range(500)]


def test_equal_windows_share_an_anchor():
    rng = np.random.default_rng(2)
    window = rng.integers(97, 123, 50).astype(np.uint8)
    hits = []
    for _ in range(20):
        a, b = rng.integers(0, 80, 2)
        raw = np.concatenate([rng.integers(97, 123, a), window, rng.integers(97, 123, b)]).astype(np.uint8)
        pos, _ = S.anchors(raw, np.array([0, len(raw)]))
        hits.append({int(p - a) for p in pos if a <= p <= a + 50 - S.GRAM})
    assert set.intersection(*hits)
