"""Near-duplicate documents: improved consistent weighted sampling (ICWS) over
TF-IDF weighted word shingles, banded, verified by weighted Jaccard.

A document's set: its shingles of ``WORDS`` consecutive words (runs of
characters that are not ASCII blanks, A-Z lower-cased; a shorter text is one
shingle), weight = tf * idf, idf = (1 + ln((N + 1) / (df + 1))) ** IDF_POWER
over all N documents.  The power damps the idf: a group of thousands of copies
raises the df of its own shingles, and with the plain logarithm a handful of
edited (hence unique) shingles would outweigh the text they sit in.

1. Document frequencies: chunks exchange distinct shingle hashes by range
   (``chunks.scatter`` / ``gather``); only df >= 2 is answered.
2. Each document draws BANDS * ROWS consistent samples: for weight w, hash k
   and shingle s, r, c ~ Gamma(2, 1) and b ~ U(0, 1) are functions of (s, k);
   t = floor(ln w / r + b), ln a = ln c - r (t - b + 1); the shingle with the
   least a is the sample, (s, t) its value.  Two documents agree on a sample
   with a probability equal to their weighted Jaccard similarity.
3. Equal texts become one class.  Class heads that share a band are candidates;
   candidates are grouped (``components``), a group is cut into blocks and
   each pair of blocks is verified exactly by matrix products.  A block pair
   returns a spanning forest of its links, never all pairs.  A group of any
   size is split, none is capped.
4. Connected links give the classes.

Result: one row per input row with ``group_id`` (smallest doc_id of the class)
and ``kept`` (the row with the smallest doc_id, a single one among repeated
rows).  Null, empty or blank texts have no shingles: they stay, each on its
own.  A null doc_id counts as larger than every other.  An empty table gives
an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunks as C
from .arrow_schema import to_arrow
from .common import ship, stored
from .components import components

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 12, 4
IDF_POWER = 0.1
DROP_BITS = 12
BLOCK_DOCS = 512
BLOCK_ITEMS = 1 << 21
TASK_ITEMS = 1 << 22
_SLICE = 1 << 20
_STEP = 1 << 14
_COLUMNS = 4096
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_LOWER += np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_JOIN = _powers(WORDS + 1, 0x9E3779B97F4A7C15)[1:]


def word_hashes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and offsets of the documents among the words."""
    blank = _BLANK[raw]
    solid = np.flatnonzero(~blank)
    if not len(solid):
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    begins = np.zeros(len(raw), bool)
    begins[1:] = blank[:-1]
    begins[0] = True
    begins[off[:-1][off[:-1] < off[1:]]] = True
    head = np.flatnonzero(begins[solid])
    size = np.diff(np.append(head, len(solid)))
    within = np.arange(len(solid)) - np.repeat(head, size)
    sums = np.add.reduceat(_LOWER[raw[solid]] * _powers(int(size.max()), 0xD6E8FEB86659FD93)[within], head)
    return _mix(sums), np.searchsorted(solid[head], off)


def shingles(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every shingle of every document, and the documents' offsets."""
    hs, ns = [], []
    docs = len(off) - 1
    cuts = np.flatnonzero(np.diff(off[:-1] // _SLICE)) + 1 if docs else []
    for lo, hi in zip([0, *cuts], [*cuts, docs]):
        w, at = word_hashes(raw[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
        n = np.diff(at)
        count = np.where(n >= WORDS, n - WORDS + 1, np.minimum(n, 1))
        first = np.repeat(at[:-1], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        last = np.repeat(at[1:], count)
        total = np.zeros(len(first), np.uint64)
        for j in range(WORDS):
            inside = first + j < last
            total += np.where(inside, w[np.minimum(first + j, max(len(w) - 1, 0))] if len(w) else 0, np.uint64(0)) * _JOIN[j]
        hs.append(_mix(total))
        ns.append(count)
    n = np.concatenate(ns) if ns else np.zeros(0, np.int64)
    return (np.concatenate(hs) if hs else np.zeros(0, np.uint64)), np.r_[0, np.cumsum(n)]


def shingle_sets(batch: pa.RecordBatch, text: str = "text") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, tf, document) of each document's distinct shingles, in order of
    document and hash."""
    h, off = shingles(*C.texts_of(batch, text))
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
        h[a:b].sort()
    new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]) if len(h) else np.zeros(0, np.int64)
    return h[new], np.diff(np.append(new, len(h))), doc[new]


def document_frequency(h: np.ndarray, reply: pa.Table, n: int) -> np.ndarray:
    sent, _ = C.sent_list(h, DROP_BITS)
    df = np.ones(len(sent), np.int64)
    at, v = C.read_reply(reply, sent, n)
    df[at] = v
    if not len(h):
        return df
    order = np.argsort(h)              # the sent list is the distinct prefixes of these, in order
    prefix = h[order] >> np.uint64(DROP_BITS)
    out = np.empty(len(h), np.int64)
    out[order] = df[np.cumsum(np.r_[False, prefix[1:] != prefix[:-1]])]
    return out


def idf(df: np.ndarray, docs: int, power: float) -> np.ndarray:
    return (1 + np.log((docs + 1) / (df + 1.0))) ** power


def samples(h: np.ndarray, weight: np.ndarray, start: np.ndarray, k: int) -> np.ndarray:
    """ICWS: k samples of each document; ``start`` is where the documents (all
    of them with items) begin."""
    out = np.empty((len(start), k), np.uint64)
    end = np.append(start[1:], len(h))
    unit, low = np.float32(2.0 ** -32), np.uint64(0xFFFFFFFF)
    log_w = np.log(weight).astype(np.float32)
    # whole documents, about _STEP items at a time
    cuts = np.flatnonzero(np.diff(start // _STEP)) + 1
    for lo, hi in zip([0, *cuts], [*cuts, len(start)]):
        a, b = start[lo], end[hi - 1]
        hh, lw, st = h[a:b], log_w[a:b], start[lo:hi] - a
        size = end[lo:hi] - start[lo:hi]
        for i in range(k):
            z = _mix(hh + np.uint64((0x9E3779B97F4A7C15 * (2 * i + 1)) & (2**64 - 1)))
            y = (z ^ (z >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
            y ^= y >> np.uint64(32)
            c = ((z >> np.uint64(32)).astype(np.float32) + np.float32(0.5)) * unit
            c *= ((z & low).astype(np.float32) + np.float32(0.5)) * unit
            log_c = np.log(np.maximum(-np.log(c), np.float32(1e-12)))
            r = ((y >> np.uint64(44)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0 ** -20)
            r *= (((y >> np.uint64(24)) & np.uint64(0xFFFFF)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0 ** -20)
            r = np.maximum(-np.log(r), np.float32(1e-6))
            beta = (y & np.uint64(0xFFFFFF)).astype(np.float32) * np.float32(2.0 ** -24)
            t = np.floor(lw / r + beta)
            log_a = log_c - r * (t - beta + np.float32(1))
            least = np.minimum.reduceat(log_a, st)
            hit = np.flatnonzero(log_a == np.repeat(least, size))
            who = np.searchsorted(st, hit, side="right") - 1
            one = hit[np.r_[True, who[1:] != who[:-1]]]
            out[lo:hi, i] = _mix(hh[one] ^ _mix(t[one].astype(np.int64).astype(np.uint64) + np.uint64(i << 40)))
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.zeros((len(sig), bands), np.uint64)
    for b in range(bands):
        for r in range(rows):
            keys[:, b] = _mix(keys[:, b] * np.uint64(0x9E3779B97F4A7C15) + sig[:, b * rows + r])
    return keys.view(np.int64)


def unfold(h: np.ndarray, tf: np.ndarray, df: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A shingle found tf times as tf items of weight idf: weighted Jaccard is
    then that of sets."""
    extra = np.repeat(np.arange(len(h)), tf - 1)
    if not len(extra):
        return h, df
    size = (tf - 1)[tf > 1]
    nth = np.arange(len(extra)) - np.repeat(np.cumsum(size) - size, size) + 1
    return (np.concatenate([h, _mix(h[extra] + nth.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))]),
            np.concatenate([df, df[extra]]))


def linked(items: list[np.ndarray], weights: list[np.ndarray], similarity: float,
           first: np.ndarray, second: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links (weighted Jaccard >= similarity) between
    the documents numbered in ``first`` and those in ``second``."""
    n = len(items)
    item, doc, w = np.concatenate(items), np.repeat(np.arange(n), [len(x) for x in items]), np.concatenate(weights)
    order = np.argsort(item, kind="stable")
    item, doc, w = item[order], doc[order], w[order]
    new = np.r_[True, item[1:] != item[:-1]]
    col = np.cumsum(new) - 1
    size = np.bincount(col)
    several = size[col] > 1
    col, doc, w = col[several], doc[several], w[several]
    total = np.array([x.sum() for x in weights])
    shared = np.zeros((len(first), len(second)))
    if len(col):
        seq = np.cumsum(np.r_[True, col[1:] != col[:-1]]) - 1
        row_of, col_of = np.full(n, -1), np.full(n, -1)
        row_of[first], col_of[second] = np.arange(len(first)), np.arange(len(second))
        for lo in range(0, int(seq[-1]) + 1, _COLUMNS):
            a, b = np.searchsorted(seq, [lo, lo + _COLUMNS])
            width = int(seq[b - 1]) - lo + 1
            left, right = np.zeros((len(first), width)), np.zeros((len(second), width))
            d, s = doc[a:b], seq[a:b] - lo
            in_l, in_r = row_of[d] >= 0, col_of[d] >= 0
            left[row_of[d[in_l]], s[in_l]] = w[a:b][in_l]
            right[col_of[d[in_r]], s[in_r]] = 1
            shared += left @ right.T
    union = total[first][:, None] + total[second][None, :] - shared
    link = np.zeros((n, n), bool)
    link[np.ix_(first, second)] = shared >= (similarity - 1e-12) * union
    link |= link.T
    np.fill_diagonal(link, False)
    return forest(link)


def forest(link: np.ndarray) -> list[tuple[int, int]]:
    out, fresh = [], link.any(axis=1)
    while fresh.any():
        todo = [int(np.argmax(fresh))]
        fresh[todo[0]] = False
        while todo:
            i = todo.pop()
            for j in np.flatnonzero(link[i] & fresh).tolist():
                fresh[j] = False
                out.append((i, j))
                todo.append(j)
    return out


# ---- the operator ------------------------------------------------------------

def _classes(df: DataFrame, text: str, doc_id: str, similarity: float, bands: int, rows: int, power: float) -> tuple[DataFrame, DataFrame]:
    """The chunks, and a row ``(chunk, rid, doc_id, n_shingles, group_id,
    kept)`` for each input row."""
    spark = df.sparkSession
    ship(spark)
    chunks = stored(C.pack(df, text))

    docs = int(chunks.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0])
    n = C.buckets_for(C.total_bytes(chunks) / 6)
    replies = stored(C.gather(C.scatter(chunks, lambda b: shingle_sets(b, text)[0], n, DROP_BITS), C.repeated))

    def sign(chunk, batch, reply):
        h, tf, doc = shingle_sets(batch, text)
        weight = tf * idf(document_frequency(h, reply, n), docs, power)
        start = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, np.int64)
        keys = band_keys(samples(h, weight, start, bands * rows), bands, rows) if len(start) else np.zeros((0, bands), np.int64)
        has = doc[start]
        raw, off = C.texts_of(batch, text)
        digest, band, items = [None] * batch.num_rows, [None] * batch.num_rows, np.zeros(batch.num_rows, np.int64)
        items[has] = np.add.reduceat(tf, start) if len(start) else items[has]
        for i, k in zip(has.tolist(), keys.tolist()):
            digest[i] = hashlib.blake2b(raw[off[i]:off[i + 1]].tobytes(), digest_size=16).digest()
            band[i] = k
        return pa.table({"chunk": pa.array([chunk] * batch.num_rows, pa.int64()),
                         "rid": pa.array(chunk + np.arange(batch.num_rows)),
                         "doc_id": batch.column(doc_id).cast(pa.int64()), "n_shingles": pa.array(items),
                         "digest": pa.array(digest, pa.binary()), "bands": pa.array(band, pa.list_(pa.int64()))})

    signed = stored(C.answer(chunks, replies, sign,
                             "chunk long, rid long, doc_id long, n_shingles long, digest binary, bands array<long>"))
    place = F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("doc_id"), F.col("rid").alias("rid"))
    heads = stored(signed.where("digest is not null").groupBy("digest")
                   .agg(F.min_by(F.struct("chunk", "rid", "n_shingles", "bands"), place).alias("h"))
                   .select("digest", "h.*"))
    banded = heads.select("rid", F.posexplode("bands").alias("band", "key"))
    roots = banded.groupBy("band", "key").agg(F.min("rid").alias("root"), F.count(F.lit(1)).alias("n")).where("n > 1")
    pairs = banded.join(roots.select("band", "key", "root"), ["band", "key"]).where("rid <> root")
    group = stored(components(pairs.select(F.col("rid").alias("a"), F.col("root").alias("b"))))
    member = heads.select("chunk", "rid", "n_shingles").join(group.withColumnRenamed("id", "rid"), "rid")
    cut = (group.join(heads.select(F.col("rid").alias("id"), "n_shingles"), "id").groupBy("component")
           .agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_DOCS),
                           F.ceil(F.sum("n_shingles") / BLOCK_ITEMS)).cast("int").alias("blocks")))
    wanted = stored(member.join(cut, "component").select(
        "chunk", "rid", "component", "blocks", "n_shingles",
        F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int").alias("block")))
    items = int(wanted.agg(F.coalesce(F.sum(F.col("n_shingles") * F.col("blocks")), F.lit(0))).first()[0])
    tasks = max(C.MIN_BUCKETS, -(-items // TASK_ITEMS))
    asked = (replies.select("chunk", "bucket", "payload", *[F.lit(None).cast(t).alias(c) for c, t in
                                                            (("rid", "long"), ("component", "long"), ("blocks", "int"), ("block", "int"))])
             .join(wanted.select("chunk").distinct(), "chunk", "left_semi")
             .unionByName(wanted.select("chunk", F.lit(-1).alias("bucket"), F.lit(None).cast("binary").alias("payload"),
                                        "rid", "component", "blocks", "block")))
    vector_schema = "task int, component long, one int, two int, block int, rid long, items binary, df binary"
    vector_arrow = to_arrow(spark, vector_schema)

    def vectors(chunk, batch, reply):
        mine = np.array(reply.column("bucket").to_pylist()) == -1
        if not mine.any():
            return vector_arrow.empty_table()
        h, tf, doc = shingle_sets(batch, text)
        df_ = document_frequency(h, reply.filter(pa.array(~mine)), n)
        out = []
        for x in reply.filter(pa.array(mine)).to_pylist():
            a, b = np.searchsorted(doc, [x["rid"] - chunk, x["rid"] - chunk + 1])
            it, d = unfold(h[a:b], tf[a:b], df_[a:b])
            it, d = it.tobytes(), d.astype(np.uint32).tobytes()
            for j in range(x["blocks"]):
                one, two = min(j, x["block"]), max(j, x["block"])
                task = int(_mix(np.array([(x["component"] * 1000003 + one * 1009 + two) & (2**64 - 1)], np.uint64))[0] % np.uint64(tasks))
                out.append((task, x["component"], one, two, x["block"], x["rid"], it, d))
        cols = list(zip(*out)) if out else [[]] * len(vector_arrow)
        return pa.table([pa.array(list(c), f.type) for c, f in zip(cols, vector_arrow)], schema=vector_arrow)

    def verify(t: pa.Table) -> pa.Table:
        t = t.sort_by([("component", "ascending"), ("one", "ascending"), ("two", "ascending"), ("rid", "ascending")])
        keys = np.stack([t.column(c).to_numpy() for c in ("component", "one", "two")], axis=1).astype(np.int64)
        block, rid = t.column("block").to_numpy(), t.column("rid").to_numpy()
        it, d = t.column("items"), t.column("df")
        cut_at = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)]) if len(keys) else []
        a, b = [], []
        for lo, hi in zip(cut_at, [*cut_at[1:], len(keys)]):
            if hi - lo < 2:
                continue
            side = block[lo:hi] == keys[lo, 1]
            first = np.flatnonzero(side)
            second = first if keys[lo, 1] == keys[lo, 2] else np.flatnonzero(~side)
            if not len(first) or not len(second):
                continue
            got = [np.frombuffer(it[i].as_py(), np.uint64) for i in range(lo, hi)]
            w = [idf(np.frombuffer(d[i].as_py(), np.uint32), docs, power) for i in range(lo, hi)]
            for i, j in linked(got, w, similarity, first, second):
                a.append(int(rid[lo + i]))
                b.append(int(rid[lo + j]))
        C.give_back()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    links = (C.answer(chunks, asked, vectors, vector_schema).repartition("task").groupBy("task").applyInArrow(verify, "a long, b long"))
    found = components(links)
    label = (signed.where("digest is not null").select("chunk", "rid", "doc_id", "n_shingles", "digest")
             .join(heads.select("digest", F.col("rid").alias("head")), "digest").drop("digest")
             .join(found.withColumnRenamed("id", "head"), "head", "left")
             .withColumn("label", F.coalesce("component", "head")).drop("head", "component")
             .unionByName(signed.where("digest is null").select("chunk", "rid", "doc_id", "n_shingles", F.col("rid").alias("label"))))
    label = stored(label)
    best = label.groupBy("label").agg(F.min(place).alias("p")).select(
        "label", F.col("p.doc_id").alias("group_id"), F.col("p.rid").alias("best"))
    return chunks, label.join(best, "label").select(
        "chunk", "rid", "doc_id", "n_shingles", "group_id", (F.col("rid") == F.col("best")).alias("kept"))


def near_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id", similarity: float = SIMILARITY,
                    bands: int = BANDS, rows: int = ROWS, power: float = IDF_POWER) -> DataFrame:
    """``doc_id, n_shingles, group_id, kept`` for each row of ``df``."""
    df = df.select(F.col(f"`{doc_id}`"), F.col(f"`{text}`"))
    _, out = _classes(df, text, doc_id, similarity, bands, rows, power)
    return out.select("doc_id", "n_shingles", "group_id", "kept")


def drop_near_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id", similarity: float = SIMILARITY,
                         bands: int = BANDS, rows: int = ROWS, power: float = IDF_POWER) -> DataFrame:
    """The rows of ``df``, all columns, that ``near_duplicates`` keeps."""
    chunks, out = _classes(df, text, doc_id, similarity, bands, rows, power)
    gone = out.where("not kept").select("chunk", "rid")

    def keep(chunk, batch, reply):
        stay = np.ones(batch.num_rows, bool)
        stay[reply.column("rid").to_numpy() - chunk] = False
        return pa.Table.from_batches([batch]).filter(pa.array(stay))

    return C.answer(chunks, gone, keep, df.schema)
