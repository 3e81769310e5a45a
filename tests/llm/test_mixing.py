import numpy as np
import pytest
from pyspark.sql import functions as F

from skytune.llm import mixing as M


@pytest.mark.parametrize("shares", [{"a": 1}, {"a": 3, "b": 2, "c": 1}, {"a": 500, "b": 499, "c": 1}, {f"s{i}": i + 1 for i in range(30)}])
def test_every_prefix_of_a_period_deviates_by_less_than_a_block(shares):
    slots, period = M.pfair_period(shares), sum(shares.values())
    assert sorted(t for s in slots.values() for t in s) == list(range(period))
    for s, at in slots.items():
        have = np.searchsorted(at, np.arange(1, period + 1), side="left")
        assert (abs(have - np.arange(1, period + 1) * shares[s] / period) < 1).all()
        for j, t in enumerate(at, 1):
            assert (j - 1) * period // shares[s] <= t < -(-j * period // shares[s])


def brute_schedule(blocks, shares):
    """Earliest deadline first, slot by slot, restarted whenever a source runs out."""
    left, done, out = {s: n for s, n in blocks.items() if n}, dict.fromkeys(blocks, 0), []
    while left:
        period, own, t = sum(shares[s] for s in left), dict.fromkeys(left, 0), 0
        while all(own[s] < left[s] for s in left):
            ready = [(-(-(own[s] + 1) * period // shares[s]), s) for s in left if own[s] * period // shares[s] <= t]
            _, s = min(ready)
            out.append((s, done[s] + own[s]))
            own[s] += 1
            t += 1
        for s in list(left):
            done[s] += own[s]
            left[s] -= own[s]
            if not left[s]:
                del left[s]
    return out


def rows_of(sizes):
    return [(1000 * i + j, f"text {j}", "en", s) for i, (s, n) in enumerate(sizes.items()) for j in range(n)]


def test_schedule_against_brute_force(make):
    sizes, weights = {"a": 90, "b": 40, "c": 7, None: 21}, {"a": 5, "b": 3, None: 1, "unseen": 9}
    out = M.mix_sources(make(rows_of(sizes), clash=True), weights, block_rows=4, range_rows=10).collect()
    key = lambda s: "null" if s is None else f"={s}"
    want = brute_schedule({key(s): -(-n // 4) for s, n in sizes.items()}, {"=a": 5, "=b": 3, "=c": 1, "null": 1})
    got = {}
    for r in out:
        got.setdefault(r.mix_slot, []).append((key(r.source), r.mix_block))
    assert [got[t][0] for t in sorted(got)] == want and sorted(got) == list(range(len(want)))
    assert all(len(set(v)) == 1 and len(v) <= 4 for v in got.values())
    assert len({r.mix_order for r in out}) == len(out) == sum(sizes.values())


def test_rows_in_order_and_complete(make):
    df = make(rows_of({"a": 300, "b": 30}))
    out = M.mixed_rows(df)
    assert out.columns == df.columns
    order = [r.doc_id for r in out.collect()]
    by_order = [r.doc_id for r in M.mix_sources(df).orderBy("mix_order").collect()]
    assert order == by_order and sorted(order) == sorted(r.doc_id for r in df.collect())


def test_tempered_shares():
    assert M.tempered_shares({"a": 100, "b": 400}, 0.5, 30) == {"a": 10, "b": 20}
    assert M.tempered_shares({"a": 1, "b": 10**12})["a"] == 1


def test_edges(make, edge_rows):
    df = make(edge_rows, clash=True)
    out = M.mix_sources(df)
    assert out.count() == len(edge_rows) and out.where(F.col("mix_order").isNull()).count() == 0
    assert M.mix_sources(make([])).count() == 0 and M.mixed_rows(make([])).count() == 0
