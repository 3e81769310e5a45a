"""Line de-duplication with a once-seen and a twice-seen Bloom filter.

A line's key is the line with ASCII blanks stripped at both ends and A-Z
lower-cased.  Keys of at least ``min_chars`` code points found in at least
``min_docs`` documents lose all their lines but those in the document with
the largest doc_id that holds them.

Method: every chunk of documents sends the hashes of its long keys to hash
ranges; a range sets each hash in a Bloom filter *once*, and in a second one,
*twice*, if the first held it already (or if one chunk has it in several
documents).  Filters of all ranges together grow with the corpus, one range
does not.  Only lines that the second filter holds ("suspects") are shuffled
as text: there the documents are counted exactly, on the whole key, and the
surviving document is chosen.

Defined results: a null or empty text is one empty line; a null doc_id counts
as a document of its own, below all others; of rows with the same doc_id each
counts as a document, and all keep their lines if that id survives; an empty
table gives an empty table; other columns pass unchanged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import chunks as C
from .arrow_schema import to_arrow
from .common import ship, stored

MIN_CHARS = 40
MIN_DOCS = 5
DROP_BITS = 0
BITS_PER_ITEM = 16
PROBES = 3
NO_ID = -(1 << 63)
_STRIP = b" \t\n\x0b\x0c\r"


def line_keys(text: bytes, min_chars: int) -> list[bytes | None]:
    """The key of each line, None where it is too short."""
    out = []
    for line in text.split(b"\n"):
        key = line.strip(_STRIP)
        n = len(key)
        if n < min_chars:
            out.append(None)
            continue
        if n < 4 * min_chars and not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars:
            out.append(None)
            continue
        out.append(key.lower())
    return out


def _doc_texts(batch: pa.RecordBatch, text: str):
    raw, off = C.texts_of(batch, text)
    raw = raw.tobytes()
    return [raw[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist())]


def _key_hash(key: bytes) -> int:
    return xxhash.xxh64_intdigest(key)


def suspects_by_bloom(lists: list[np.ndarray], counts: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For every chunk's hashes, the places that the twice-seen filter holds."""
    n = max(1, sum(map(len, lists)))
    bits = 1 << max(10, int(np.ceil(np.log2(n * BITS_PER_ITEM))))
    once, twice = np.zeros(bits, bool), np.zeros(bits, bool)

    def places(h):
        g = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        step = (g >> np.uint64(20)) | np.uint64(1)
        return [((g + step * np.uint64(i)) >> np.uint64(7)) & np.uint64(bits - 1) for i in range(PROBES)]

    for h, c in zip(lists, counts):
        at = places(h)
        again = np.logical_and.reduce([once[p] for p in at]) | (c > 1)
        for p in at:
            twice[p[again]] = True
            once[p] = True
    out = []
    for h in lists:
        held = np.flatnonzero(np.logical_and.reduce([twice[p] for p in places(h)]))
        out.append((held, np.ones(len(held), np.uint32)))
    return out


def dedup_lines(df: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
                text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """All rows and columns of ``df``, ``text`` without the dropped lines, and
    ``n_lines`` / ``n_dropped`` (names that ``df`` has already are replaced)."""
    ship(df.sparkSession)
    df = df.drop("n_lines", "n_dropped")
    chunks = stored(C.pack(df, text))
    n = C.buckets_for(C.total_bytes(chunks) / 64)

    def hashes(batch):
        out = []
        for t in _doc_texts(batch, text):
            out.extend({_key_hash(k) for k in line_keys(t, min_chars) if k is not None})
        return np.array(out, np.uint64)

    replies = C.gather(C.scatter(chunks, hashes, n, DROP_BITS), suspects_by_bloom)

    def ids(batch):
        return [NO_ID if v is None else v for v in batch.column(doc_id).to_pylist()]

    def suspects(chunk, batch, reply):
        h, _ = C.sent_list(hashes(batch), DROP_BITS)
        at, _ = C.read_reply(reply, h, n)
        wanted = set(h[at].tolist())
        found: dict[bytes, list[int]] = {}
        if wanted:
            for d, t in zip(ids(batch), _doc_texts(batch, text)):
                for k in {k for k in line_keys(t, min_chars) if k is not None and _key_hash(k) in wanted}:
                    v = found.setdefault(k, [0, d])
                    v[0] += 1
                    v[1] = max(v[1], d)
        return pa.table({"chunk": pa.array([chunk] * len(found), pa.int64()),
                         "key": pa.array(list(found), pa.binary()),
                         "docs": pa.array([v[0] for v in found.values()], pa.int64()),
                         "last": pa.array([v[1] for v in found.values()], pa.int64())})

    held = stored(C.answer(chunks, replies, suspects, "chunk long, key binary, docs long, last long"))
    confirmed = (held.groupBy("key").agg(F.sum("docs").alias("n"), F.max("last").alias("keep"))
                 .where(F.col("n") >= min_docs).select("key", "keep"))
    dropped = held.join(confirmed, "key").select("chunk", "key", "keep")
    schema = StructType([*df.schema.fields, StructField("n_lines", LongType()), StructField("n_dropped", LongType())])
    target = to_arrow(df.sparkSession, schema)
    at_text = df.columns.index(text)

    def rewrite(chunk, batch, reply):
        keep = dict(zip(reply.column("key").to_pylist(), reply.column("keep").to_pylist()))
        texts, n_lines, n_dropped = [], [], []
        was = batch.column(text)
        for i, (d, t) in enumerate(zip(ids(batch), _doc_texts(batch, text))):
            lines = t.split(b"\n")
            gone = 0
            if keep:
                keys = line_keys(t, min_chars)
                stay = [x for x, k in zip(lines, keys) if k is None or keep.get(k, d) == d]
                gone = len(lines) - len(stay)
            texts.append((None if was[i].as_py() is None else t.decode()) if not gone else b"\n".join(stay).decode())
            n_lines.append(len(lines))
            n_dropped.append(gone)
        arrays = [*batch.columns]
        arrays[at_text] = pa.array(texts, pa.string())
        return pa.table([*arrays, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
                        names=target.names).cast(target)

    return C.answer(chunks, dropped, rewrite, schema)
