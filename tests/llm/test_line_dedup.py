from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from skytune.llm import line_dedup as L

HOT = "this very line is repeated in a great many documents"


def brute(rows, min_chars=40, min_docs=5):
    strip, low = " \t\n\x0b\x0c\r", str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(strip).translate(low)
    docs = Counter()
    last = {}
    for d, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= min_chars:
                docs[k] += 1
                last[k] = max(last.get(k, -10**30), -10**29 if d is None else d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if not (docs[key(x)] >= min_docs and last[key(x)] != (-10**29 if d is None else d))]
        out.append((d, "\n".join(stay) if t is not None or len(stay) < len(lines) else None, len(lines), len(lines) - len(stay)))
    return sorted(out, key=str)


def run(df):
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in L.dedup_lines(df).collect()), key=str)


def test_against_brute_force(make):
    rng = np.random.default_rng(3)
    pool = [f"line number {i} is long enough to be looked at by the filter" for i in range(30)] + ["short"] * 5
    rows = [(i, "\n".join(rng.choice(pool, rng.integers(1, 8)))) for i in range(60)]
    rows += [(100 + i, f"  {HOT.upper() if i % 2 else HOT}\t\nmine {i}\n{HOT}") for i in range(7)]
    rows += [(200 + i, "É" * 39) for i in range(6)] + [(300 + i, "É" * 40) for i in range(6)]
    assert run(make(rows)) == brute(rows)


def test_edges(make, edge_rows):
    rows = [r[:2] for r in edge_rows] + [(None, HOT)] + [(50 + i, HOT) for i in range(4)]
    df = make([(*r, "en", "s") for r in rows], clash=True)
    assert run(df) == brute(rows)
    out = L.dedup_lines(df)
    assert set(df.columns) <= set(out.columns) and out.where(F.col("chunk") != "own chunk").count() == 0
    assert L.dedup_lines(make([])).count() == 0


def test_bloom_holds_every_repeat():
    rng = np.random.default_rng(0)
    lists = [np.unique(rng.integers(0, 500, 200).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(4)]
    seen = Counter(x for h in lists for x in h.tolist())
    for h, (at, _) in zip(lists, L.suspects_by_bloom(lists, [np.ones(len(h), np.uint32) for h in lists])):
        assert {x for x in h.tolist() if seen[x] > 1} <= set(h[at].tolist())
