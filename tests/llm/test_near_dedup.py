import math
import re
from collections import Counter, defaultdict

import numpy as np

from skytune.llm import near_dedup as N
from skytune.llm.components import components


def brute(rows, power=N.IDF_POWER, similarity=N.SIMILARITY):
    """Classes by position of the row; equal texts are one class as well."""
    sets = []
    for _, t in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        sets.append(Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter())
    df = Counter(s for c in sets for s in c)
    weight = {s: (1 + math.log((len(rows) + 1) / (v + 1))) ** power for s, v in df.items()}
    holds = defaultdict(list)
    for i, c in enumerate(sets):
        for s in c:
            holds[s].append(i)
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in sorted({j for s in sets[i] for j in holds[s] if j < i}):
            shared = sum(min(v, sets[j][s]) * weight[s] for s, v in sets[i].items())
            whole = sum(max(sets[i][s], sets[j][s]) * weight[s] for s in sets[i] | sets[j])
            if shared >= similarity * whole - 1e-9:
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    ids = [d for d, _ in rows]
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(i)
    least = {g: min((ids[i] for i in m if ids[i] is not None), default=None) for g, m in groups.items()}
    return sorted(((ids[i], least[root(i)]) for i in range(len(rows))), key=str)


def texts(seed=5):
    rng = np.random.default_rng(seed)
    vocab = [f"w{i}" for i in range(300)]
    rows = []
    for g in range(12):
        base = list(rng.choice(vocab, rng.integers(40, 200)))
        for c in range(rng.integers(1, 8)):
            t = list(base)
            for _ in range(int(rng.choice([0, 1, 1, 2, 9]))):
                t[rng.integers(len(t))] = f"edit{rng.integers(10**6)}"
            rows.append((int(rng.integers(10**6)) * 1000 + len(rows), " ".join(t)))
    return rows


def test_against_brute_force(make):
    rows = texts()
    got = sorted(((r.doc_id, r.group_id) for r in N.near_duplicates(make(rows)).collect()), key=str)
    assert got == brute(rows)


def test_large_group_is_split_into_blocks(make, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_DOCS", 8)
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in rng.integers(0, 1000, 120)]
    rows = []
    for i in range(60):
        t = list(base)
        t[int(rng.integers(120))] = f"own{i}"
        rows.append((i, " ".join(t)))
    out = N.near_duplicates(make(rows)).collect()
    assert {r.group_id for r in out} == {0} and [r.doc_id for r in out if r.kept] == [0]


def test_edges(make, edge_rows):
    rows = [r[:2] for r in edge_rows]
    df = make([(*r, "en", "s") for r in rows], clash=True)
    out = N.near_duplicates(df).collect()
    assert sorted(((r.doc_id, r.group_id) for r in out), key=str) == brute(rows)
    for g in {r.group_id for r in out if r.n_shingles}:
        assert sum(r.kept for r in out if r.group_id == g and r.n_shingles) == 1
    kept = N.drop_near_duplicates(df)
    assert kept.columns == df.columns and kept.count() == sum(r.kept for r in out)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in out if r.kept)
    assert N.near_duplicates(make([])).count() == 0 and N.drop_near_duplicates(make([])).count() == 0


def test_samples_agree_as_often_as_the_sets_are_similar():
    rng = np.random.default_rng(4)
    h = np.sort(rng.integers(0, 2**63, 400).astype(np.uint64))
    wa = rng.uniform(0.5, 3, 400)
    wb = np.where(rng.random(400) < 0.2, rng.uniform(0.5, 3, 400), wa)
    a, b = (N.samples(h, w, np.array([0]), 6000) for w in (wa, wb))
    assert abs((a == b).mean() - np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()) < 0.02


def test_components(spark):
    rng = np.random.default_rng(9)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (250, 2))] + [(1000 + i, 1001 + i) for i in range(30)] + [(5000, 6000 + i) for i in range(50)]
    label = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: c for x, c in label.items() if x in got} and set(got) == {x for a, b in edges if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
