"""Exact removal of repeated byte strings with a distributed suffix sort.

Every byte covered by a string of ``SPAN`` bytes that also starts in a
document with a smaller doc_id is removed; strings are judged on the input.

Method.  Sorting every suffix of a corpus means moving each byte dozens of
times, so the suffix array is sparse: suffixes start at *anchors*, the
positions whose ``GRAM`` leading bytes have the smallest hash in some window
of ``SPAN`` bytes.  The choice depends on the window's content alone, so equal
windows hold equal anchors at equal places, and two windows are equal only if
the suffixes (and the bytes just before) at their anchors are.

1. Chunks exchange the hashes of their anchors' grams; anchors whose gram no
   other document holds are out (``chunks.scatter`` / ``gather``).
2. Sampled splitters cut the range of leading grams; each chunk sends the
   suffixes at its other anchors (``SPAN`` bytes, with the bytes before that
   a window can reach) to the part its gram lies in.  Equal suffixes of one
   chunk go once, with the smallest doc_id.
3. A part sorts its suffixes by multikey quicksort (eight bytes at a time,
   only rows still tied go on) and compares neighbours.  Equal neighbours:
   every window over that anchor repeats.  Neighbours that share the gram
   but differ somewhere are expanded into their windows, sorted and compared
   in the same way.  A splitter is a whole gram, so equal grams never lie on
   both sides of a boundary and no comparison across it is missed.
4. Each chunk gets its verdicts back and cuts its texts.

Defined results: a null text is empty; a null doc_id counts as larger than
every other; rows with the same doc_id do not remove each other's bytes; an
empty table gives an empty table; texts are never cut short.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from . import chunks as C
from .arrow_schema import to_arrow
from .common import ship, stored

SPAN = 50
GRAM = 24
LEFT = SPAN - GRAM                # bytes before an anchor that a window reaches
DROP_BITS = 20
PART_BYTES = 16 << 20             # input per part
SAMPLED_CHUNKS = 32               # bound of the sample that sets the splitters
SAMPLED_GRAMS = 2048              # per sampled chunk
WHOLE = np.uint32(1 << 31)
_BLOCK = 1 << 16
_ROW = 80                         # suffix, bytes before, two lengths, padding
NO_ID = (1 << 63) - 1


# ---- anchors ---------------------------------------------------------------

def _mix(h: np.ndarray, m: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(m)
    return h ^ (h >> np.uint64(32))


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A hash (never 0) of the GRAM = 16 + 8 bytes from each position on."""
    h = raw.astype(np.uint64) + np.uint64(1)
    for step, m in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F), (4, 0x165667B19E3779F9)):
        h = h[:-step] * np.uint64(m) + h[step:]
        h ^= h >> np.uint64(31)
    long = h[:-8] * np.uint64(0xD6E8FEB86659FD93) + h[8:]
    long ^= long >> np.uint64(31)
    return _mix(long[:-8] * np.uint64(0xA0761D6478BD642F) + h[16:], 0xE7037ED1A0B428DB) | np.uint64(1)


def _slide(a: np.ndarray, width: int, op) -> np.ndarray:
    """op over every ``width`` neighbours, by doubling."""
    have, done = a, 1
    while done * 2 <= width:
        have = op(have[:-done], have[done:])
        done *= 2
    rest = width - done
    return op(have[:len(have) - rest], have[rest:]) if rest else have


def anchors(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the anchors of all windows inside documents, their hashes."""
    n, width = len(raw), SPAN - GRAM + 1
    last = n - SPAN                       # of window starts
    if last < 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    valid = np.ones(n, bool)
    ends = off[1:]
    for e, s in zip(ends.tolist(), off[:-1].tolist()):
        valid[max(s, e - SPAN + 1):e] = False
    at, hs = [], []
    for lo in range(0, n - GRAM + 1, _BLOCK):
        hi = min(lo + _BLOCK, n - GRAM + 1)              # gram starts of this block
        w_lo, w_hi = max(0, lo - width + 1), min(hi, last + 1)
        g_hi = min(n - GRAM + 1, max(hi, w_hi + width - 1))
        h = gram_hashes(raw[w_lo:g_hi + GRAM - 1])
        if w_hi <= w_lo:
            continue
        least = _slide(h[:w_hi - w_lo + width - 1], width, np.minimum)
        least[~valid[w_lo:w_hi]] = 0
        padded = np.zeros(hi - lo + width - 1, np.uint64)
        start = w_lo - (lo - width + 1)
        padded[start:start + len(least)] = least
        own = h[lo - w_lo:hi - w_lo]
        found = np.flatnonzero(_slide(padded, width, np.maximum) == own)
        at.append(found + lo)
        hs.append(own[found])
    return (np.concatenate(at), np.concatenate(hs)) if at else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def _owner(pos: np.ndarray, off: np.ndarray) -> np.ndarray:
    return np.searchsorted(off, pos, side="right") - 1


def spread(h: np.ndarray) -> np.ndarray:
    """Anchors have the least hashes of their windows, so these crowd at the
    lower end; mixed again they fill all buckets alike."""
    return _mix(h, 0x9FB21C651E98DF25)


def doc_anchor_hashes(batch: pa.RecordBatch) -> np.ndarray:
    """One hash for each document and distinct gram at its anchors."""
    raw, off = C.texts_of(batch)
    pos, h = anchors(raw, off)
    return _distinct_by_doc(spread(h), np.searchsorted(pos, off))


def _distinct_by_doc(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    if not len(h):
        return h
    h, new = h.copy(), np.ones(len(h), bool)
    for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
        h[a:b].sort()
    new[1:] = h[1:] != h[:-1]
    new[off[:-1][off[:-1] < off[1:]]] = True
    return h[new]


# ---- sorting ---------------------------------------------------------------

def words_of(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes (a multiple of eight each) as big-endian numbers."""
    return np.ascontiguousarray(rows).view(">u8").astype(np.uint64)


def multikey_order(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort: order of the rows, and True at the first of each
    run of equal rows.  Word by word; only rows tied so far are sorted on."""
    n, k = words.shape
    order = np.argsort(words[:, 0], kind="stable")
    new = np.ones(n, bool)
    col = words[order, 0]
    new[1:] = col[1:] != col[:-1]
    for c in range(1, k):
        idx = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(idx):
            break
        run = np.cumsum(new)[idx]
        sub = order[idx]
        key = words[sub, c]
        o = np.lexsort((key, run))
        order[idx], key = sub[o], key[o]
        new[idx[1:]] |= key[1:] != key[:-1]
    return order, new


def _lowest(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Minimum of each run, for every row."""
    return np.repeat(np.minimum.reduceat(values, first), np.diff(np.append(first, len(values))))


# ---- records of a chunk ------------------------------------------------------

class Records:
    """The suffixes at a chunk's shared anchors, equal ones as one class."""

    def __init__(self, batch: pa.RecordBatch, ids: np.ndarray, reply: pa.Table, n: int):
        raw, off = C.texts_of(batch)
        self.raw, self.off = raw, off
        pos, h = anchors(raw, off)
        doc = _owner(pos, off)
        h = spread(h)
        sent, _ = C.sent_list(_distinct_by_doc(h, np.searchsorted(pos, off)), DROP_BITS)
        at, _ = C.read_reply(reply, sent, n)
        shared = np.zeros(len(sent), bool)
        shared[at] = True
        keep = shared[np.searchsorted(sent, h & ~np.uint64((1 << DROP_BITS) - 1))] if len(sent) else np.zeros(0, bool)
        self.pos, doc = pos[keep], doc[keep]
        self.ids = ids[doc] if len(doc) else np.zeros(0, np.int64)
        self.left = np.minimum(LEFT, self.pos - off[doc])
        self.right = np.minimum(SPAN, off[doc + 1] - self.pos) if len(doc) else self.left
        self.rows = self._rows()
        self.order, new = multikey_order(words_of(self.rows)) if len(self.pos) else (np.zeros(0, np.int64), np.zeros(0, bool))
        self.first = np.flatnonzero(new)
        self.klass = np.empty(len(self.pos), np.int64)
        self.klass[self.order] = np.cumsum(new) - 1
        self.lowest = np.minimum.reduceat(self.ids[self.order], self.first) if len(self.first) else self.ids

    def _rows(self) -> np.ndarray:
        rows = np.zeros((len(self.pos), _ROW), np.uint8)
        if len(self.pos):
            padded = np.concatenate([np.zeros(LEFT, np.uint8), self.raw, np.zeros(SPAN, np.uint8)])
            view = sliding_window_view(padded, LEFT + SPAN)
            got = view[self.pos]
            rows[:, :SPAN], rows[:, SPAN:SPAN + LEFT] = got[:, LEFT:], got[:, :LEFT]
            for i in np.flatnonzero(self.right < SPAN):
                rows[i, self.right[i]:SPAN] = 0
            for i in np.flatnonzero(self.left < LEFT):
                rows[i, SPAN:SPAN + LEFT - self.left[i]] = 0
            rows[:, SPAN + LEFT], rows[:, SPAN + LEFT + 1] = self.left, self.right
        return rows


def judge_part(rows: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For every record: WHOLE if each window over its anchor also starts in a
    document with a smaller id, else a bit for each such window (bit o: the
    window that starts o bytes before the anchor)."""
    if not len(rows):
        return np.zeros(0, np.uint32)
    w = words_of(rows)
    order, new = multikey_order(w)
    first = np.flatnonzero(new)
    lowest = np.minimum.reduceat(ids[order], first)
    klass = np.cumsum(new) - 1
    grams = w[order[first]][:, :GRAM // 8]
    gram_new = np.r_[True, (grams[1:] != grams[:-1]).any(axis=1)]
    several = np.flatnonzero(~(gram_new & np.append(gram_new[1:], True)))     # classes
    mask = np.zeros(len(first), np.uint32)
    if len(several):
        rep, low = rows[order[first[several]]], lowest[several]
        run = np.cumsum(gram_new)[several].astype(np.uint64)
        text = np.concatenate([rep[:, SPAN:SPAN + LEFT], rep[:, :SPAN]], axis=1)
        left, right = rep[:, SPAN + LEFT], rep[:, SPAN + LEFT + 1]
        for o in range(LEFT + 1):
            at = np.flatnonzero((left >= o) & (right >= SPAN - o))
            if not len(at):
                continue
            # the gram itself is equal within a run: the bytes around it decide
            wide = np.zeros((len(at), -(-(SPAN - GRAM) // 8) * 8), np.uint8)
            wide[:, :o] = text[at, LEFT - o:LEFT]
            wide[:, o:SPAN - GRAM] = text[at, LEFT + GRAM:LEFT + SPAN - o]
            o_order, o_new = multikey_order(np.concatenate([run[at, None], words_of(wide)], axis=1))
            sub = at[o_order]
            less = _lowest(low[sub], np.flatnonzero(o_new)) < low[sub]
            mask[several[sub[less]]] |= np.uint32(1 << o)
    out = np.empty(len(rows), np.uint32)
    out[order] = np.where(ids[order] > lowest[klass], WHOLE, mask[klass])
    return out


def merged(start: np.ndarray, end: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of overlapping or touching spans within a document:
    (document, start, end), in order."""
    if not len(start):
        return (np.zeros(0, np.int64),) * 3
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    doc = _owner(start, off)
    first = np.flatnonzero(np.r_[True, (start[1:] > end[:-1]) | (doc[1:] != doc[:-1])])
    return doc[first], start[first], end[np.append(first[1:], len(start)) - 1]


# ---- the operator ------------------------------------------------------------

def _splitters(chunks: DataFrame, parts: int) -> np.ndarray:
    """Quantiles of the grams at the anchors of a bounded sample of chunks."""
    n = chunks.count()
    step = max(1, n // SAMPLED_CHUNKS)

    def run(batches):
        for b in batches:
            for blob in b.column("blob"):
                raw, off = C.texts_of(C.decode_batch(blob.as_buffer()))
                pos, _ = anchors(raw, off)
                pos = pos[:: max(1, len(pos) // SAMPLED_GRAMS + 1)]
                if len(pos):
                    g = sliding_window_view(raw, GRAM)[pos]
                    yield pa.record_batch({"grams": pa.array([g.tobytes()], pa.binary())})

    sample = chunks.where(F.pmod(F.xxhash64("chunk"), F.lit(step)) == 0).select("blob")
    got = b"".join(bytes(r[0]) for r in sample.mapInArrow(run, "grams binary").limit(4 * SAMPLED_CHUNKS).collect())
    if not got:
        return np.zeros(0, f"S{GRAM}")
    grams = np.sort(np.frombuffer(got, f"S{GRAM}"))
    return np.unique(grams[np.linspace(0, len(grams) - 1, parts + 1).astype(int)[1:-1]])


def remove_repeats(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` (binary), a row for each
    row of ``df``; other columns are left out."""
    spark = df.sparkSession
    ship(spark)
    chunks = stored(C.pack(df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))))
    total = C.total_bytes(chunks)
    n = C.buckets_for(total / 12)
    replies = stored(C.gather(C.scatter(chunks, doc_anchor_hashes, n, DROP_BITS), C.repeated))
    parts = max(C.MIN_BUCKETS, -(-total // PART_BYTES))
    splitters = _splitters(chunks, parts)

    def ids_of(batch):
        return np.array([NO_ID if v is None else v for v in batch.column("doc_id").to_pylist()], np.int64)

    def send(chunk, batch, reply):
        r = Records(batch, ids_of(batch), reply, n)
        rep = r.rows[r.order[r.first]] if len(r.first) else r.rows
        out = []
        if len(rep):
            grams = np.ascontiguousarray(rep[:, :GRAM]).view(f"S{GRAM}").ravel()
            part = np.searchsorted(splitters, grams, side="right") if len(splitters) else np.zeros(len(grams), int)
            cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(part)]):
                out.append((int(part[lo]), lo, C.put_parts(
                    C.put_array(rep[lo:hi].reshape(-1)), C.put_array(r.lowest[lo:hi]))))
        return pa.table({"part": pa.array([x[0] for x in out], pa.int32()),
                         "chunk": pa.array([chunk] * len(out), pa.int64()),
                         "start": pa.array([x[1] for x in out], pa.int64()),
                         "payload": pa.array([x[2] for x in out], pa.binary())})

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        got = [C.get_parts(p) for p in pdf.payload]
        rows = [C.get_array(a, np.uint8).reshape(-1, _ROW) for a, _ in got]
        verdict = judge_part(np.concatenate(rows), np.concatenate([C.get_array(b, np.int64) for _, b in got]))
        out, i = [], 0
        for c, start, one in zip(pdf.chunk, pdf.start, rows):
            v = verdict[i:i + len(one)]
            i += len(one)
            at = np.flatnonzero(v)
            if len(at):
                out.append((c, C.put_parts(C.put_array(at + start), C.put_array(v[at]))))
        C.give_back()
        return pd.DataFrame(out, columns=["chunk", "payload"]).astype({"chunk": "int64"})

    sent = C.answer(chunks, replies, send, "part int, chunk long, start long, payload binary")
    verdicts = sent.groupBy("part").applyInPandas(judge, "chunk long, payload binary")
    both = (replies.select("chunk", "bucket", "payload")
            .unionByName(verdicts.select("chunk", F.lit(-1).alias("bucket"), "payload")))
    schema = StructType([StructField("doc_id", LongType()), StructField("n_bytes", LongType()),
                         StructField("n_removed", LongType()), StructField("n_spans", LongType()),
                         StructField("kept", BinaryType())])
    target = to_arrow(spark, schema)

    def cut(chunk, batch, reply):
        is_verdict = np.array(reply.column("bucket").to_pylist()) == -1
        r = Records(batch, ids_of(batch), reply.filter(pa.array(~is_verdict)), n)
        mask = np.zeros(len(r.first), np.uint32)
        for p in reply.filter(pa.array(is_verdict)).column("payload").to_pylist():
            at, v = C.get_parts(p)
            mask[C.get_array(at, np.int64)] = C.get_array(v, np.uint32)
        m = mask[r.klass] if len(mask) else np.zeros(0, np.uint32)
        if len(m):
            m = np.where(r.ids > r.lowest[r.klass], WHOLE, m)
        from_o = np.maximum(0, SPAN - r.right)
        w = np.flatnonzero((m & WHOLE) != 0)
        w = w[r.left[w] >= from_o[w]]
        starts, ends = [r.pos[w] - r.left[w]], [r.pos[w] - from_o[w] + SPAN]
        some = np.flatnonzero((m & WHOLE) == 0)
        some = some[m[some] != 0]
        for o in range(LEFT + 1):
            at = r.pos[some[(m[some] >> np.uint32(o)) & np.uint32(1) == 1]] - o
            starts.append(at)
            ends.append(at + SPAN)
        off = r.off
        doc, begin, end = merged(np.concatenate(starts), np.concatenate(ends), off)
        removed = np.bincount(doc, weights=end - begin, minlength=len(off) - 1).astype(np.int64)
        spans = np.bincount(doc, minlength=len(off) - 1)
        kept, at = [], 0
        for i, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
            pieces = []
            for j in range(at, at + spans[i]):
                pieces.append(r.raw[a:begin[j]])
                a = end[j]
            at += spans[i]
            kept.append(b"".join(p.tobytes() for p in [*pieces, r.raw[a:b]]))
        return pa.table([batch.column("doc_id"), pa.array(np.diff(off)), pa.array(removed), pa.array(spans),
                         pa.array(kept, pa.binary())], names=target.names).cast(target)

    return C.answer(chunks, both, cut, schema)
