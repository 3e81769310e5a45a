import math

import numpy as np
import pytest

from skytune.llm import lm_score as L


def net(seed=0):
    rng = np.random.default_rng(seed)
    n = L.start_network(rng.random(L.PAD))
    return {k: (v + rng.normal(0, 0.2, v.shape)).astype(np.float32) for k, v in n.items()}


def brute(net, ids):
    """Sum of ln P of each token given the two on either side, one by one."""
    out = 0.0
    at = lambda i: ids[i] if 0 <= i < len(ids) else L.PAD
    for i, w in enumerate(ids):
        h = np.tanh(sum(net["scale"][p] * net["embed"][at(i + o)] for p, o in enumerate(L.PLACES)) + net["bias"])
        c, m = divmod(w, L.CLASSES)
        x, y = h @ net["to_class"] + net["class_bias"], h @ net["to_word"][c] + net["word_bias"][c]
        out += x[c] - math.log(np.exp(x).sum()) + y[m] - math.log(np.exp(y).sum())
    return out


def test_scores_against_brute_force(monkeypatch):
    monkeypatch.setattr(L, "BATCH", 7)                      # blocks must not lose neighbours
    n, vocab = net(), {b"a": 0, b"b": 40, b"c": 700}
    texts = ["a b c a zebra", "", None, "A  b\n" * 20, "c"]
    sizes, sums = L.document_scores(texts, vocab, n)
    ids = [L.token_ids(t, vocab) for t in texts]
    assert sizes == [len(i) for i in ids] == [5, 0, 0, 40, 1]
    assert sums == pytest.approx([brute(n, i) for i in ids], rel=1e-4, abs=1e-5)


def test_gradient():
    n = {k: v.astype(np.float64) for k, v in net(1).items()}
    rng = np.random.default_rng(2)
    context, target = rng.integers(0, 60, (4, 40)), rng.integers(0, 100, 40)
    order, slices = L.by_class(target)
    context, target = context[:, order], target[order]

    def value(m):
        return L.forward(m, L.places_table(m), context, target, slices)[0].mean()

    table = L.places_table(n)
    grad = L.backward(n, table, context, L.forward(n, table, context, target, slices)[1], slices)
    for k in n:
        for _ in range(6):
            i = tuple(rng.integers(0, s) for s in n[k].shape)
            if k == "embed":
                i = (int(context[rng.integers(4), rng.integers(40)]), i[1])
            more, less = ({**n, k: n[k].copy()} for _ in range(2))
            more[k][i] += 1e-3
            less[k][i] -= 1e-3
            assert grad[k][i] == pytest.approx((value(more) - value(less)) / 2e-3, rel=0.02, abs=2e-4), k


def corpus(n=300):
    rng = np.random.default_rng(0)
    pairs = [("new", "york"), ("hot", "dog"), ("ice", "cream"), ("big", "apple")]
    return [(i, " ".join(w for _ in range(60) for w in pairs[rng.integers(4)])) for i in range(n)]


def test_training_beats_the_unigram_model_and_sees_both_sides(make):
    rows = corpus()
    df = make(rows)
    plain = L.score(df, *L.train(df, "text", "doc_id", rounds=0)).collect()
    vocab, trained = L.train(df, "text", "doc_id")
    out = L.score(df, vocab, trained).collect()
    mean = lambda rs: sum(r.pll for r in rs) / sum(r.n_tokens for r in rs)
    assert mean(out) > mean(plain) + 0.3
    _, sums = L.document_scores(["new york hot dog ice cream", "york cream new dog hot ice"], vocab, trained)
    assert sums[0] > sums[1]


def test_edges(make, edge_rows):
    df = make(edge_rows, clash=True)
    out = L.score_documents(df).collect()
    assert len(out) == len(edge_rows)
    for r in out:
        assert r.n_tokens == len((r.text or "").encode().split())
        assert (r.pll, r.mean_pll) == (0.0, None) if not r.n_tokens else math.isfinite(r.pll) and r.pll < 0
    assert L.score_documents(make([])).count() == 0


def test_counts_cover_all_documents(make):
    got = {bytes(r.word): r.n for r in L.count_words(make([(1, "a b A"), (2, "a\tc"), (3, None)]), "text").collect()}
    assert got == {b"a": 3, b"b": 1, b"c": 1}


def test_words_of_a_bucket_are_told_apart(make):
    bucket = L.crc32(b"genuine") % L.RARE
    junk, odd = [w for i in range(9999) if L.crc32((w := f"x{i}").encode()) % L.RARE == bucket][:2]
    common = [f"f{i}" for i in range(L.TOP)]
    docs = [(i, " ".join(common)) for i in range(5)] + [(10 + i, "f1 genuine f2") for i in range(4)] + [(20, f"f1 {junk} f2")]
    df = make(docs)
    vocab, net = L.train(df, "text", "doc_id")
    out = {r.doc_id: r.pll for r in L.score(make([*docs, (30, f"f1 {odd} f2"), (31, f"f1 {odd} f2 genuine {odd}")]), vocab, net).collect()}
    assert out[10] - out[20] == pytest.approx(math.log(4), abs=1e-5)
    known, unseen = {bytes(r.word): r.inside for r in vocab.rare.collect()}, vocab.unseen[bucket]
    assert set(known) == {b"genuine", junk.encode()}                 # all words, not only the network's
    assert sum(map(math.exp, known.values())) + math.exp(unseen) == pytest.approx(1)
    spelt = unseen - math.log(224) - len(odd) * math.log(225)
    _, sums = L.document_scores(["f1 genuine f2", f"f1 {odd} f2 genuine {odd}"], vocab, net)
    assert out[30] == pytest.approx(sums[0] + spelt, abs=1e-5) and out[30] < out[20]
    assert out[31] == pytest.approx(sums[1] + 2 * spelt + known[b"genuine"], abs=1e-5)


def test_words_beyond_those_that_tasks_hold_score_alike(make, monkeypatch):
    rows = [(i, " ".join(f"w{j % 40}" for j in range(i, 60 + i)) + f" once{i} " + " ".join(f"u{i}x{j} v{i // 3}x{j}" for j in range(60))) for i in range(30)]
    df = make(rows)
    vocab, net = L.train(df, "text", "doc_id")
    assert len(vocab.near) > 0 and vocab.far.count() == 0
    monkeypatch.setattr(L, "NEAR", len(vocab.near) - 1)
    fewer, _ = L.train(df, "text", "doc_id", rounds=0)
    assert len(fewer.near) < len(vocab.near) and fewer.far.count() == vocab.rare.count() - len(fewer.near)
    new = make([*rows, (99, "never seen w1 once3 u29x59 v9x7 u29x59")])
    a, b = ({r.doc_id: r.pll for r in L.score(new, v, net).collect()} for v in (vocab, fewer))
    assert a == pytest.approx(b, abs=1e-9)
