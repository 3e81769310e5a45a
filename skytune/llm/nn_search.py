"""Nearest neighbours by cosine: a block matrix join on int8 tiles.

1. Equal vectors become one candidate that carries its ``k + 1`` smallest ids:
   no query can use more of them.
2. Candidates and queries are cut into blocks of a bounded number of
   components.  A block holds unit vectors as int8 codes with one scale each,
   and for each the length of what the code leaves out (eps).
3. Every pair of a query block and a candidate block of the same dimension is
   one task: the product of the code matrices gives all cosines up to
   ``eps_q + (1 + eps_q) * eps_c``.  A pair is dropped only if its upper bound
   lies below the (k + 1)-th largest lower bound of its tile, or below the k
   exact scores the query already has: no neighbour is lost, so recall is 1.
4. Surviving pairs are recomputed from the original vectors in double precision
   and go through one heap of ``k`` entries per query; the tiles' heaps are
   merged in Spark, ``FAN`` at a time.

Work is that of the stated queries against all rows; a row is sent once per
block of the other side, and no task holds more than two blocks.

Defined results: vectors that are null, empty, zero or hold a null or
non-finite component take no part, nor do rows whose id is null; vectors of
different length are not compared; an identical row (id and vector) counts
once; rows that share an id but not the vector are candidates of their own
(the id can be listed twice) and queries of their own; a query is never
compared with rows of its own id; ties go to the smaller id; fewer than ``k``
candidates give fewer rows; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import ship, stored

K = 5
CANDIDATE_BLOCK = 1 << 21         # components of a block: of candidates,
QUERY_BLOCK = 1 << 19             # and of queries
MIN_BLOCKS = 8                    # so that a small table still has as many tasks
FAN = 64                          # heaps merged at a time
SLAB = 1024                       # dimensions whose code products a float sums exactly
ROWS, COLUMNS = 1024, 4096        # of one tile of products inside a task
PAIRS = 1 << 17                   # recomputed at a time
SLACK = np.float32(2e-6)          # rounding of the bounds themselves
_BLOCK = "dim int, block int, ids array<array<bigint>>, codes binary, scale binary, eps binary, vecs binary"
_FOUND = "dim int, qb int, part int, row int, query_id bigint, vec_id bigint, score double"


# ---- inside tasks ---------------------------------------------------------------

def scaled(v: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings their largest component near 1:
    exact, and squares neither overflow nor vanish."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1))[1][:, None])


def squared_norms(v: np.ndarray) -> np.ndarray:
    out = np.zeros(len(v))
    for d in range(v.shape[1]):
        out += v[:, d] * v[:, d]
    return out


def quantise(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of the unit vectors, their scales, and what they leave out."""
    unit = v / np.sqrt(squared_norms(v))[:, None]
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None])
    eps = np.sqrt(((unit - codes * scale[:, None]) ** 2).sum(axis=1))
    return codes.astype(np.int8), scale.astype(np.float32), (eps + 1e-7).astype(np.float32)


class Block:
    def __init__(self, row: dict, dim: int):
        self.ids = row["ids"]
        n = len(self.ids)
        self.codes = np.frombuffer(row["codes"], np.int8).reshape(n, dim)
        self.scale, self.eps = np.frombuffer(row["scale"], np.float32), np.frombuffer(row["eps"], np.float32)
        self.vecs = scaled(np.frombuffer(row["vecs"], np.float32 if len(row["vecs"]) == 4 * n * dim else np.float64)
                           .reshape(n, dim).astype(np.float64))
        self.norms = squared_norms(self.vecs)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of int8 rows, summed exactly ``SLAB`` dimensions at a time."""
    out = a[:, :SLAB].astype(np.float32) @ b[:, :SLAB].astype(np.float32).T
    for d in range(SLAB, a.shape[1], SLAB):
        out += a[:, d:d + SLAB].astype(np.float32) @ b[:, d:d + SLAB].astype(np.float32).T
    return out


def bounds(q: Block, c: Block, qs: slice, cs: slice) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest value each cosine of a tile can have."""
    near = products(q.codes[qs], c.codes[cs])
    near *= q.scale[qs, None]
    near *= c.scale[None, cs]
    err = (1 + q.eps[qs, None]) * c.eps[None, cs]
    err += q.eps[qs, None] + SLACK
    return near - err, near + err


def cosines(q: Block, c: Block, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact cosines of pairs, summed dimension by dimension."""
    out = np.empty(len(i))
    for lo in range(0, len(i), PAIRS):
        a, b = i[lo:lo + PAIRS], j[lo:lo + PAIRS]
        dot = np.zeros(len(a))
        for d in range(q.vecs.shape[1]):
            dot += q.vecs[a, d] * c.vecs[b, d]
        out[lo:lo + PAIRS] = dot / np.sqrt(q.norms[a] * c.norms[b])
    return np.clip(out, -1.0, 1.0)


def search_tile(q: Block, c: Block, k: int) -> list[list[tuple[float, int]]]:
    """One heap of (score, -id) per query of ``q`` over the rows of ``c``."""
    heaps: list[list[tuple[float, int]]] = [[] for _ in q.ids]
    for qlo in range(0, len(q.ids), ROWS):
        qs = slice(qlo, min(qlo + ROWS, len(q.ids)))
        for clo in range(0, len(c.ids), COLUMNS):
            cs = slice(clo, min(clo + COLUMNS, len(c.ids)))
            low, high = bounds(q, c, qs, cs)
            floor = np.array([h[0][0] if len(h) == k else -2.0 for h in heaps[qs]])
            if low.shape[1] > k:          # one of the k + 1 can be the query itself
                at = low.shape[1] - k - 1
                low.partition(at, axis=1)
                np.maximum(floor, low[:, at], out=floor)
            i, j = np.nonzero(high >= (floor - 1e-6).astype(np.float32)[:, None])
            i, j = i + qlo, j + clo
            for row, col, s in zip(i.tolist(), j.tolist(), cosines(q, c, i, j).tolist()):
                heap, own = heaps[row], q.ids[row][0]
                for v in c.ids[col]:
                    if v == own:
                        continue
                    if len(heap) < k:
                        heapq.heappush(heap, (s, -v))
                    elif (s, -v) > heap[0]:
                        heapq.heapreplace(heap, (s, -v))
    return heaps


def found_table(dim: int, qb: int, part: int, rows: list[tuple[int, int, int, float]]) -> pa.Table:
    r, q, v, s = zip(*rows) if rows else ((), (), (), ())
    n = len(rows)
    return pa.table({"dim": pa.array([dim] * n, pa.int32()), "qb": pa.array([qb] * n, pa.int32()),
                     "part": pa.array([part] * n, pa.int32()), "row": pa.array(r, pa.int32()), "query_id": pa.array(q, pa.int64()),
                     "vec_id": pa.array(v, pa.int64()), "score": pa.array(s, pa.float64())})


def merge_heaps(rows, k: int) -> list[tuple[int, int, int, float]]:
    """The k best of each query (row) over the sorted lists of several parts."""
    lists: dict[tuple[int, int], dict[int, list]] = {}
    for part, row, query, v, s in rows:
        lists.setdefault((row, query), {}).setdefault(part, []).append((-s, v))
    return [(row, query, v, -s) for (row, query), parts in sorted(lists.items())
            for s, v in islice(heapq.merge(*[sorted(p) for p in parts.values()]), k)]


# ---- Spark ----------------------------------------------------------------------

def usable(df: DataFrame, id_col: str, vector: str, element: str) -> DataFrame:
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return (df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector}`").cast(f"array<{element}>").alias("v"))
            .where(F.col("id").isNotNull() & (F.size(v) > 0)).where(~bad & F.exists(v, lambda x: x != 0)).distinct())


def packed(rows: DataFrame, blocks: int) -> DataFrame:
    """(ids, v) rows as blocks, by a hash of the row."""

    def pack(t: pa.Table) -> pa.Table:
        dim, block = t.column("dim")[0].as_py(), t.column("block")[0].as_py()
        flat = pa.concat_arrays([x.flatten() for x in t.column("v").chunks]).to_numpy(zero_copy_only=False)
        v = flat.reshape(t.num_rows, dim)
        codes, scale, eps = quantise(scaled(v.astype(np.float64)))
        ids = t.column("ids").combine_chunks()
        ids = ids if isinstance(ids, pa.Array) else ids.chunk(0)
        return pa.table({"dim": pa.array([dim], pa.int32()), "block": pa.array([block], pa.int32()),
                         "ids": pa.array([ids.to_pylist()], pa.list_(pa.list_(pa.int64()))),
                         **{n: pa.array([np.ascontiguousarray(a).tobytes()], pa.binary())
                            for n, a in (("codes", codes), ("scale", scale), ("eps", eps), ("vecs", v))}})

    keyed = rows.select(F.size("v").alias("dim"), F.pmod(F.xxhash64("ids", "v"), F.lit(blocks)).cast("int").alias("block"), "ids", "v")
    return stored(keyed.groupBy("dim", "block").applyInArrow(pack, _BLOCK))


def block_count(df: DataFrame, components: int) -> int:
    total = df.agg(F.sum(F.size("v").cast("long"))).first()[0] or 0
    return max(MIN_BLOCKS, int(-(-total // components)))


def nearest(queries: DataFrame, candidates: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = K) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows of ``candidates``
    nearest to each row of ``queries``."""
    ship(candidates.sparkSession)
    single = all(isinstance(t, ArrayType) and isinstance(t.elementType, FloatType)
                 for t in (queries.schema[vector].dataType, candidates.schema[vector].dataType))
    element = "float" if single else "double"
    q, c = usable(queries, id_col, vector, element), usable(candidates, id_col, vector, element)
    first = Window.partitionBy("v").orderBy("id")
    c = (c.withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= k + 1)
         .groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    c = stored(c)
    q = stored(q.select("v", F.array("id").alias("ids")))
    parts = block_count(c, CANDIDATE_BLOCK)
    cb, qb = packed(c, parts), packed(q, block_count(q, QUERY_BLOCK))
    # one number per block of the other side of the same dimension
    c_of = cb.groupBy("dim").agg(F.collect_list("block").alias("other"))
    q_of = qb.groupBy("dim").agg(F.collect_list("block").alias("other"))
    left = qb.join(c_of, "dim").withColumn("part", F.explode("other")).drop("other").withColumnRenamed("block", "qb")
    right = cb.join(q_of, "dim").withColumn("qb", F.explode("other")).drop("other").withColumnRenamed("block", "part")

    def tile(a: pa.Table, b: pa.Table) -> pa.Table:
        if not (a.num_rows and b.num_rows):
            return found_table(0, 0, 0, [])
        a, b = a.to_pylist()[0], b.to_pylist()[0]
        x, y = Block(a, a["dim"]), Block(b, b["dim"])
        heaps = search_tile(x, y, k)
        return found_table(a["dim"], a["qb"], a["part"], [(i, x.ids[i][0], -v, s) for i, h in enumerate(heaps) for s, v in h])

    def merge(t: pa.Table) -> pa.Table:
        rows = merge_heaps(zip(*[t.column(n).to_pylist() for n in ("part", "row", "query_id", "vec_id", "score")]), k)
        return found_table(t.column("dim")[0].as_py(), t.column("qb")[0].as_py(), t.column("part")[0].as_py() // FAN, rows)

    keys = ("dim", "qb", "part")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(tile, _FOUND)
    while True:
        found = found.groupBy("dim", "qb", F.floor(F.col("part") / FAN)).applyInArrow(merge, _FOUND)
        parts = -(-parts // FAN)
        if parts <= 1:
            break
    order = Window.partitionBy("dim", "qb", "row").orderBy(F.desc("score"), "vec_id")
    return found.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score")
