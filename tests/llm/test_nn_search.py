import numpy as np
import pytest
from pyspark.sql import functions as F

from skytune.llm import nn_search as N


def brute(rows, is_query, k=5):
    ok = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = []
    for i, v in sorted(ok):
        if not is_query(i):
            continue
        a = np.array(v, np.float64)
        a = a / np.abs(a).max()
        near = []
        for j, w in ok:
            if j != i and len(w) == len(v):
                b = np.array(w, np.float64)
                b = b / np.abs(b).max()
                near.append((-float(a @ b / np.sqrt((a @ a) * (b @ b))), j))
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(sorted(near)[:k])]
    return out


def run(spark, rows, k=5, every=5, extra=False, parts=3):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    df = df.repartition(parts) if rows else df
    if extra:
        df = df.withColumns({c: F.lit(f"own {c}") for c in ("id", "v", "ids", "dim", "block", "part", "qb", "row", "score", "rank", "codes")})
    out = N.nearest(df.where(F.col("vec_id") % every == 0), df, k=k)
    assert out.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(tuple(r) for r in out.collect())


def same(got, want):
    want = sorted(want)
    assert [(g[0], g[1]) for g in got] == [(w[0], w[1]) for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want], abs=1e-12)
    return [g[2] for g in got] == [w[2] for w in want]


def test_equals_brute_force_on_clustered_vectors(spark, monkeypatch):
    monkeypatch.setattr(N, "CANDIDATE_BLOCK", 16 * 40)
    monkeypatch.setattr(N, "QUERY_BLOCK", 16 * 15)
    monkeypatch.setattr(N, "FAN", 3)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 16))
    vecs = (centres[rng.integers(0, 6, 400)] + 0.01 * rng.normal(size=(400, 16))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(vecs)]
    assert same(run(spark, rows), brute(rows, lambda i: i % 5 == 0))


def test_bounds_hold_and_drop_pairs():
    rng = np.random.default_rng(2)
    for dim in (1, 3, 64, 2500):
        v = N.scaled(rng.normal(size=(60, dim)) * rng.choice([1e-30, 1.0, 1e30], (60, 1)))
        codes, scale, eps = N.quantise(v)
        row = {"ids": [[i] for i in range(60)], "codes": codes.tobytes(), "scale": scale.tobytes(), "eps": eps.tobytes(), "vecs": v.tobytes()}
        b = N.Block(row, dim)
        low, high = N.bounds(b, b, slice(0, 60), slice(0, 60))
        i, j = np.divmod(np.arange(3600), 60)
        exact = N.cosines(b, b, i, j).reshape(60, 60)
        assert (low <= exact).all() and (exact <= high).all()
        if dim == 64:
            assert (high - low).max() < 0.06


def test_copies_ties_and_edges(spark):
    one, two = [1.0, 0.0, 0.0], [0.5, 0.5, 0.0]
    rows = [(i, one) for i in range(40)] + [(i, two) for i in range(40, 50)] + [(7, one), (7, two), (5, one)]
    rows += [(None, one), (50, None), (51, []), (55, [0.0, 0.0, 0.0]), (60, [1.0, None, 0.0]), (65, [float("nan"), 1.0, 1.0]),
             (70, [float("inf"), 1.0, 1.0]), (75, [1.0, 1.0]), (80, [2.0, 1.0]), (85, [1e38, 1e38, -1e38]), (90, [1e-40, 0.0, 0.0])]
    want = brute([(i, v) for i, v in rows], lambda i: i % 5 == 0)
    got = run(spark, rows, extra=True)
    assert same(got, want)
    assert [g[2] for g in got if g[0] == 0] == [1, 2, 3, 4, 5]
    assert [g[2] for g in got if g[0] == 75] == [80]


def test_empty_table_and_more_neighbours_than_rows(spark):
    assert run(spark, []) == []
    rows = [(i, [1.0, float(i)]) for i in range(6)]
    assert len(run(spark, rows, k=50)) == 2 * 5


def test_double_vectors_keep_their_precision(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1e-9]), (2, [1.0, 2e-9])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = N.nearest(df.where("vec_id = 0"), df, k=2).collect()
    assert [(r.rank, r.vec_id) for r in got] == [(1, 1), (2, 2)]
