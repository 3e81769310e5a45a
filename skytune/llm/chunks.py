"""Rows packed into chunks, and hash lists exchanged between chunks and buckets.

Three operators (line, suffix and MinHash de-duplication) have to know which
of their many small items (lines, anchors, shingles) occur anywhere else.
Shuffling one row per item costs tens of bytes an item; here

* ``pack`` writes the rows once as *chunks*: about ``CHUNK_BYTES`` of text,
  all columns kept, one zstd Arrow stream per chunk.  The ids of a chunk and
  of its rows are fixed once that table is written;
* ``scatter`` lets every chunk send the sorted distinct hashes of its items,
  cut into ranges (buckets), delta coded: 3 to 5 bytes an item;
* a bucket sees all chunks that hold a hash and answers each chunk with the
  places (in the list that was sent) that matter and one number each;
* ``answer`` brings these replies and the chunk together again.  A chunk
  works out the same sorted list anew, so places suffice.

An item found in a third of all rows is one entry per chunk and bucket.  The
number of buckets follows the input, a bucket holds about ``PER_BUCKET``
entries whatever the size of the corpus.  Nothing reaches the driver but
totals.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 4 << 20
ZSTD_LEVEL = 3
PER_BUCKET = 1 << 20
MIN_BUCKETS = 32
_SENT = "bucket int, chunk long, payload binary"
_REPLY = "chunk long, bucket int, payload binary"


# ---- chunks -------------------------------------------------------------

def give_back() -> None:
    """Return freed memory to the system: a worker that has seen a large chunk
    would otherwise hold on to it while other tasks run beside it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):          # not glibc
        pass


def encode_batch(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", ZSTD_LEVEL))) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def decode_batch(blob) -> pa.RecordBatch:
    with pa.ipc.open_stream(pa.py_buffer(blob)) as r:
        return r.read_next_batch()


def pack(df: DataFrame, text: str = "text") -> DataFrame:
    """Lazy frame ``(chunk, rows, bytes, blob)``; write it before use, ids are
    only fixed then.  ``chunk + i`` is the id of the i-th row of a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        for batch in batches:
            size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.cumsum(size) // CHUNK_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if hi > lo:
                    yield pa.record_batch({
                        "chunk": pa.array([base], pa.int64()), "rows": pa.array([hi - lo], pa.int64()),
                        "bytes": pa.array([int(size[lo:hi].sum())], pa.int64()),
                        "blob": pa.array([encode_batch(batch.slice(lo, hi - lo))], pa.binary())})
                    base += hi - lo

    return df.mapInArrow(run, "chunk long, rows long, bytes long, blob binary")


def texts_of(batch: pa.RecordBatch, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts of a chunk in one array, and the offsets
    (a null text is empty)."""
    col = batch.column(text)
    col = pc.fill_null(col, "") if col.null_count else col
    col = col.cast(pa.large_string()).cast(pa.large_binary())
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    off = off if len(off) else np.zeros(1, np.int64)
    return raw[off[0]:off[-1]], off - off[0]


# ---- sorted hash lists ---------------------------------------------------

def put_sorted(h: np.ndarray) -> bytes:
    """Sorted unsigned numbers, as differences, byte planes compressed."""
    d = np.diff(h, prepend=np.uint64(0)).astype("<u8")
    planes = np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T)
    return len(h).to_bytes(8, "little") + bytes(pa.compress(planes.tobytes(), "zstd", asbytes=True))


def get_sorted(b: bytes) -> np.ndarray:
    n = int.from_bytes(b[:8], "little")
    if not n:
        return np.zeros(0, np.uint64)
    planes = np.frombuffer(pa.decompress(b[8:], 8 * n, "zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def put_parts(*parts: bytes) -> bytes:
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def get_parts(b: bytes) -> list[bytes]:
    out, i = [], 0
    while i < len(b):
        n = int.from_bytes(b[i:i + 8], "little")
        out.append(b[i + 8:i + 8 + n])
        i += 8 + n
    return out


def put_array(a: np.ndarray) -> bytes:
    return len(a).to_bytes(8, "little") + (bytes(pa.compress(a.tobytes(), "zstd", asbytes=True)) if len(a) else b"")


def get_array(b: bytes, dtype) -> np.ndarray:
    n = int.from_bytes(b[:8], "little")
    size = n * np.dtype(dtype).itemsize
    return np.frombuffer(pa.decompress(b[8:], size, "zstd", asbytes=True), dtype) if n else np.zeros(0, dtype)


def buckets_for(items: float) -> int:
    return max(MIN_BUCKETS, int(-(-items // PER_BUCKET)))


def bucket_edges(n: int) -> np.ndarray:
    """First hash of every bucket: equal ranges of the 64-bit numbers."""
    return np.array([(i << 64) // n for i in range(n)], np.uint64)


def distinct_counts(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(h, return_counts=True)


def scatter(chunks: DataFrame, items: Callable[[pa.RecordBatch], np.ndarray], n: int, drop_bits: int) -> DataFrame:
    """``items(batch)`` gives one 64-bit hash per (document, distinct item);
    each chunk sends its sorted distinct hashes (the lowest ``drop_bits``
    left out) and how many of its documents hold each."""

    def run(batches):
        edges = bucket_edges(n)
        for batch in batches:
            for chunk, blob in zip(batch.column("chunk").to_pylist(), batch.column("blob")):
                h, count = sent_list(items(decode_batch(blob.as_buffer())), drop_bits)
                cut = np.append(np.searchsorted(h, edges), len(h))
                out = []
                for b in range(n):
                    lo, hi = cut[b], cut[b + 1]
                    if hi > lo:
                        out.append((b, chunk, put_parts(put_sorted((h[lo:hi] - edges[b]) >> np.uint64(drop_bits)),
                                                       put_array(np.minimum(count[lo:hi], 2**32 - 1).astype(np.uint32)))))
                if out:
                    bs, cs, ps = zip(*out)
                    yield pa.record_batch({"bucket": pa.array(bs, pa.int32()), "chunk": pa.array(cs, pa.int64()),
                                           "payload": pa.array(ps, pa.binary())})
                give_back()

    return chunks.select("chunk", "blob").mapInArrow(run, _SENT)


def sent_list(h: np.ndarray, drop_bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = ~np.uint64((1 << drop_bits) - 1)
    return distinct_counts(np.asarray(h, np.uint64) & mask)


def gather(sent: DataFrame, judge: Callable[[list[np.ndarray], list[np.ndarray]], list[tuple[np.ndarray, np.ndarray]]]) -> DataFrame:
    """Per bucket: ``judge(hash lists, counts)`` answers every list with
    (places, numbers)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        parts = [get_parts(p) for p in pdf.payload]
        replies = judge([get_sorted(p[0]) for p in parts], [get_array(p[1], np.uint32) for p in parts])
        out = [(c, b, put_parts(put_array(i.astype(np.uint32)), put_array(v.astype(np.uint32))))
               for c, b, (i, v) in zip(pdf.chunk, pdf.bucket, replies) if len(i)]
        del parts, replies
        give_back()
        return pd.DataFrame(out, columns=["chunk", "bucket", "payload"]).astype({"chunk": "int64", "bucket": "int32"})

    return sent.groupBy("bucket").applyInPandas(run, _REPLY)


def read_reply(replies: pa.Table, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in the whole sorted list ``h`` of a chunk, and the numbers."""
    starts = np.searchsorted(h, bucket_edges(n))
    at, val = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
    for b, p in zip(replies.column("bucket").to_pylist(), replies.column("payload").to_pylist()):
        i, v = get_parts(p)
        at.append(get_array(i, np.uint32).astype(np.int64) + starts[b])
        val.append(get_array(v, np.uint32))
    return np.concatenate(at), np.concatenate(val)


def answer(chunks: DataFrame, replies: DataFrame, fn: Callable[[int, pa.RecordBatch, pa.Table], pa.Table],
           schema: str) -> DataFrame:
    """``fn(chunk, batch, its replies)`` for every chunk."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [fn(c, decode_batch(blob.as_buffer()), right)
               for c, blob in zip(left.column("chunk").to_pylist(), left.column("blob"))]
        give_back()
        return pa.concat_tables(out) if out else empty

    from .arrow_schema import to_arrow
    empty = to_arrow(chunks.sparkSession, schema).empty_table()
    return (chunks.select("chunk", "blob").groupBy("chunk")
            .cogroup(replies.groupBy("chunk")).applyInArrow(run, schema))


def total_bytes(chunks: DataFrame) -> int:
    return int(chunks.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0])


def repeated(lists: list[np.ndarray], counts: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """A judge for ``gather``: the places of hashes that two documents or
    more hold, with the number of these documents."""
    h = np.concatenate(lists)
    order = np.argsort(h, kind="stable")
    s = h[order]
    first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, np.int64)
    c = np.concatenate(counts).astype(np.int64)[order]
    total = np.empty(len(h), np.int64)
    sums = np.add.reduceat(c, first) if len(s) else c
    total[order] = np.repeat(sums, np.diff(np.append(first, len(s))))
    out, i = [], 0
    for one in lists:
        t = total[i:i + len(one)]
        at = np.flatnonzero(t > 1)
        out.append((at, np.minimum(t[at], 2**32 - 1)))
        i += len(one)
    return out
