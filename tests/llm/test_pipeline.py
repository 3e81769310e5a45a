import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from skytune.llm import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(SF), reason="driver tables not present")
def test_stages_on_the_smallest_tables(spark):
    from skytune.llm.common import stored, table
    docs = first = table(spark, SF, "documents")
    counts = {}
    for name, stage in P.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF))
        assert docs.columns == first.columns
        counts[name] = docs.count()
    assert list(counts) == ["language_id", "line_dedup", "near_dedup", "source_mixing"]
    assert counts["language_id"] == counts["line_dedup"] > counts["near_dedup"] == counts["source_mixing"]
    assert docs.where(F.col("n_chars") != F.length("text")).count() == 0
    out = P.sentencepiece(spark, docs, SF)
    assert out.count() == counts["near_dedup"] and out.where("NOT exact").count() == 0
    assert sorted(r.doc_id for r in P.run(spark, SF).collect()) == sorted(r.doc_id for r in docs.collect())


def test_stages_take_effect_and_stand_edges(spark, make, edge_rows):
    words = "the of and that with from this which have been are was for not you".split()
    rows = [(100 + i, " ".join(words[(i * 7 + j * j) % 15] for j in range(60 + i)), "en", "s") for i in range(30)]
    docs = make([*rows, (200, rows[0][1], "en", "s"), (201, "123 456", "en", "s"), *edge_rows])
    ids = []
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, "")
        ids.append({r.doc_id for r in docs.collect()})
    assert 201 not in ids[0] and not ids[0] & {1, 2, 3, 10} and 100 in ids[-1] and 200 not in ids[2]
    assert ids[1] == ids[0] and ids[3] == ids[2]
    empty = make([])
    for name, stage in P.STAGES:
        empty_out = stage(spark, empty, "")
        assert empty_out.count() == 0


def test_stages_hand_long_texts_on_some_mb_at_a_time(spark, make):
    import pyarrow as pa

    from skytune.llm.common import SMALL_BATCHES

    def sizes(batches):
        for b in batches:
            yield pa.record_batch({"n": pa.array([b.nbytes])})

    docs = make([(i, f"{i} " * 10_000) for i in range(400)], parts=1)
    before = {k: spark.conf.get(k, None) for k in SMALL_BATCHES}
    try:
        for _, stage in P.STAGES:
            for k in SMALL_BATCHES:
                spark.conf.unset(k)
            stage(spark, make([]), "")
            found = [r.n for r in docs.mapInArrow(sizes, "n long").collect()]
            assert max(found) < 4 << 20 and sum(found) > 12e6
        spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "77")          # the session's own choice stays
        P.source_mixing(spark, make([]), "")
        assert spark.conf.get("spark.sql.parquet.columnarReaderBatchSize") == "77"
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_a_query_for_each_operator():
    assert {int(n[2:].split("_")[0]) for n in Q.QUERIES if n.startswith("op")} == set(range(1, 14))
    assert set(Q.ORACLE_SQL) <= set(Q.QUERIES)


@pytest.mark.skipif(not os.path.exists(SF), reason="driver tables not present")
@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_queries_match_their_sql(spark, name):
    import duckdb
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    rel = con.execute(Q.ORACLE_SQL[name])
    cols = [d[0] for d in rel.description]
    df = Q.QUERIES[name](spark, SF)
    assert sorted(cols) == sorted(df.columns)
    assert sorted(map(repr, rel.fetchall())) == sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())


def test_the_schedule_outlives_the_stored_tables(spark, make, tmp_path, monkeypatch):
    from collections import Counter

    from skytune.llm import mixing as M
    rows = [(i, f"text {i}", "en", s) for s, lo, hi in (("a", 0, 400), ("b", 1000, 1100), ("c", 2000, 2030)) for i in range(lo, hi)]
    make(rows, parts=5).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(P, "STAGES", P.STAGES[-2:])          # the rows of other stages do not matter here
    out = sorted(P.run(spark, str(tmp_path)).select("doc_id", "source", "mix_order", "mix_slot").collect(), key=lambda r: r.mix_order)
    assert sorted(r.doc_id for r in out) == sorted(r[0] for r in rows)
    sizes = Counter(r[3] for r in rows)
    shares, blocks = M.tempered_shares(sizes), {s: -(-n // M.BLOCK_ROWS) for s, n in sizes.items()}
    source = {r.mix_slot: r.source for r in out}
    assert list(source) == list(range(sum(blocks.values()))) and len({r.mix_order for r in out}) == len(out)
    seen = Counter()
    for t, s in source.items():                               # until the first source runs out
        seen[s] += 1
        assert all(abs(seen[x] - (t + 1) * q / sum(shares.values())) < 1 for x, q in shares.items())
        if seen[s] == blocks[s]:
            break
    assert t > 3
