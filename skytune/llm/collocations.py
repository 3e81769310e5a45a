"""Phrase collocations by best-first branch-and-bound growth.

Texts, A-Z lower-cased, are split at ``.,;:!?`` and line breaks into pieces and
these at spaces and tabs into words; everything is counted per language.  A
candidate is a phrase of two or three words found ``MIN_COUNT`` times or more
inside pieces.  A cut after its first k words has score floor(10^6 * a * a /
(l * r)), a, l and r the counts of the phrase and of both parts; the lowest cut
counts (ties: smallest k).  A candidate goes if a longer one that contains it
is found at least ``SHARE`` percent as often.  Each language's best ``TOP`` are
kept, by score, count and phrase.

1. One pass counts the words.  A word is its 64-bit hash from then on; that no
   two words of the corpus share one is checked, else another seed is taken,
   so all counts are exact.
2. A second pass counts pairs of frequent words: the nodes of the first level,
   with their scores.  A three-word phrase that grows from the pair (w1, w2)
   scores at most floor(10^6 * f(w1 w2) / f(w1)), since f(w2 w3) >= a and
   f(w1 w2) >= a: the admissible bound of that node.
3. Rounds, best bound first: a language's threshold is the score of its
   ``FIRST * TOP``-th pair (``WIDEN`` times as many in each further round).  All
   nodes whose bound reaches it are expanded by one pass that counts their
   three-word phrases, and with them those that end in a pair whose own score
   reaches it, for they decide whether that pair goes.  All scores from the
   threshold up are then settled, ties included; a language with ``TOP``
   survivors among them is done, as is one whose threshold is 0.

Tasks look words and pairs up in bitmaps of a fixed size (``BITS`` bits each,
the only broadcasts): a false hit is counted for nothing and joined away, none
is missed.  Counts leave a task as distinct rows with their number, so a
phrase that a third of all documents holds is one row per task and block.

Defined results: a null language is ``und``; a null, empty or blank text has no
words; a very long text is read in slices that end at a piece; repeated rows
count as often as they come; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chunks import give_back, texts_of
from .common import ship, stored

TOP = 2000
MIN_COUNT = 10
SHARE = 50
SCALE = 1_000_000
FIRST, WIDEN = 2, 4
BITS = 26
SEEDS = 8
SLICE = 1 << 20                   # bytes of text read at a time
HELD = 1 << 22                    # words or phrases held before they are counted and passed on
SALTS = 64
_BREAKS = b".,;:!?\n\x0b\x0c\r"
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[list(_BREAKS)] = 2
_PART_BITS = 16


# ---- words of a batch -----------------------------------------------------------

def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def phrase_key(cols: list[np.ndarray]) -> np.ndarray:
    """A hash of phrases given by the hashes of their words."""
    out = cols[0]
    for c in cols[1:]:
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + c)
    return out


def letters(seed: int) -> np.ndarray:
    """A random number per byte; A-Z have those of a-z."""
    t = np.random.default_rng(1000 + seed).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    t[65:91] = t[97:123]
    return t


def slices(raw: np.ndarray, off: np.ndarray):
    """Ranges of about ``SLICE`` bytes that start at a text or after a break."""
    lo = 0
    while lo < len(raw):
        hi = lo + SLICE
        if hi >= len(raw):
            hi = len(raw)
        else:
            text = off[min(np.searchsorted(off, hi), len(off) - 1)]
            while hi < text:
                cut = np.flatnonzero(_KIND[raw[hi:min(hi + SLICE, text)]] == 2)
                if len(cut):
                    hi += int(cut[0]) + 1
                    break
                hi = min(hi + SLICE, text)
        yield lo, int(hi)
        lo = int(hi)


def words_of(raw: np.ndarray, off: np.ndarray, salt: np.ndarray, table: np.ndarray):
    """Of each slice: its bytes, and per word hash, piece, first byte, bytes, text."""
    for lo, hi in slices(raw, off):
        part = raw[lo:hi]
        kind = _KIND[part]
        solid = np.flatnonzero(kind == 0)
        if not len(solid):
            continue
        begins = np.zeros(len(part), bool)
        begins[0] = True
        begins[1:] = kind[:-1] != 0
        starts = off[:-1][off[:-1] < off[1:]] - lo
        begins[starts[(starts >= 0) & (starts < len(part))]] = True
        head = np.flatnonzero(begins[solid])
        size = np.diff(np.append(head, len(solid)))
        within = np.arange(len(solid)) - np.repeat(head, size)
        power = np.full(int(size.max()), 0x9E3779B97F4A7C15, np.uint64)
        power[0] = 1
        sums = np.add.reduceat(table[part[solid]] * np.cumprod(power, dtype=np.uint64)[within], head)
        at = solid[head]
        text = np.searchsorted(off, at + lo, side="right") - 1
        yield part, mix(mix(sums) + salt[text]), np.cumsum(kind == 2)[at] + text, at, size, text


def batch_words(batch: pa.RecordBatch, seed: int, table: np.ndarray):
    raw, off = texts_of(batch)
    langs = batch.column("lang").to_pylist()
    of = {v: xxhash.xxh64_intdigest(v.encode(), seed) for v in set(langs)}
    salt = np.array([of[v] for v in langs], np.uint64)
    return words_of(raw, off, salt, table)


def counted(cols: list[np.ndarray], n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places of the distinct rows among ``cols`` and how often each comes."""
    order = np.argsort(phrase_key(cols), kind="stable")
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in cols:
        s = c[order]
        new[1:] |= s[1:] != s[:-1]
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(order))) if n is None else np.add.reduceat(n[order], first) if len(first) else n
    return order[first], count


# ---- bitmaps ---------------------------------------------------------------------

def slots(key: np.ndarray) -> np.ndarray:
    return (mix(key) >> np.uint64(64 - BITS)).astype(np.int64)


def holds(bitmap: np.ndarray, key: np.ndarray) -> np.ndarray:
    at = slots(key)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def bitmap(rows: DataFrame) -> np.ndarray:
    """A bitmap of ``BITS`` slots with the keys of ``rows`` (hash columns)
    set, put together part by part in Spark."""

    def find(batches):
        for b in batches:
            at = np.unique(slots(phrase_key([c.to_numpy(zero_copy_only=False).view(np.uint64) for c in b.columns])))
            yield pa.record_batch({"part": pa.array((at >> _PART_BITS).astype(np.int32)),
                                   "slot": pa.array((at & ((1 << _PART_BITS) - 1)).astype(np.int32))})

    def pack(t: pa.Table) -> pa.Table:
        bits = np.zeros(1 << _PART_BITS, np.uint8)
        bits[t.column("slot").to_numpy()] = 1
        return pa.table({"part": t.column("part").slice(0, 1), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    found = rows.mapInArrow(find, "part int, slot int").distinct().groupBy("part").applyInArrow(pack, "part int, bits binary")
    out = np.zeros((1 << BITS - _PART_BITS, (1 << _PART_BITS) // 8), np.uint8)
    for r in found.collect():             # a fixed number of bits
        out[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


# ---- passes over the texts ----------------------------------------------------------

def count_words(docs: DataFrame, seed: int) -> DataFrame:
    """(h, lang, word, n) of all words."""

    def run(batches):
        table, held, total = letters(seed), [], 0

        def flush():
            h, n, lang, word = (np.concatenate([x[i] for x in held]) if i < 2 else pa.concat_arrays([x[i] for x in held]) for i in range(4))
            at, n = counted([h], n)
            held.clear()
            return pa.record_batch({"h": pa.array(h[at].view(np.int64)), "lang": lang.take(pa.array(at)), "word": word.take(pa.array(at)),
                                    "n": pa.array(n.astype(np.int64))})

        for b in batches:
            langs = b.column("lang").cast(pa.string())
            for part, h, _, at, size, text in batch_words(b, seed, table):
                one, n = counted([h])
                size_of = size[one]
                ends = np.cumsum(size_of)
                place = np.arange(ends[-1]) + np.repeat(at[one] - ends + size_of, size_of)
                word = pa.LargeStringArray.from_buffers(len(one), pa.py_buffer(np.r_[0, ends].astype(np.int64)), pa.py_buffer(part[place]))
                held.append((h[one], n, langs.take(pa.array(text[one])), pc.ascii_lower(word).cast(pa.string())))
                total += len(one)
                if total >= HELD // 4:
                    yield flush()
                    total = 0
        if held:
            yield flush()
        give_back()

    return docs.mapInArrow(run, "h long, lang string, word string, n long").groupBy("h", "lang", "word").agg(F.sum("n").alias("n"))


def count_phrases(docs: DataFrame, seed: int, size: int, keep, maps) -> DataFrame:
    """(h1 .., n) of the phrases of ``size`` words that ``keep(columns, maps)``
    picks; ``maps`` are bitmaps."""
    names = [f"h{i + 1}" for i in range(size)]
    sent = docs.sparkSession.sparkContext.broadcast(maps)

    def run(batches):
        table, held, total = letters(seed), [], 0

        def flush():
            cols = [np.concatenate([x[i] for x in held]) for i in range(size)]
            at, n = counted(cols)
            held.clear()
            return pa.record_batch({**{c: pa.array(v[at].view(np.int64)) for c, v in zip(names, cols)}, "n": pa.array(n)})

        for b in batches:
            for _, h, piece, *_ in batch_words(b, seed, table):
                if len(h) < size:
                    continue
                whole = np.flatnonzero(piece[size - 1:] == piece[:len(piece) - size + 1])
                cols = [h[whole + i] for i in range(size)]
                picked = keep(cols, sent.value)
                held.append([c[picked] for c in cols])
                total += int(picked.sum())
                if total >= HELD:
                    yield flush()
                    total = 0
        if held:
            yield flush()
        give_back()

    return (docs.mapInArrow(run, ", ".join(f"{c} long" for c in names) + ", n long")
            .groupBy(*names).agg(F.sum("n").alias("a")).where(F.col("a") >= MIN_COUNT))


def frequent_words(cols, maps):
    return holds(maps[0], cols[0]) & holds(maps[0], cols[1])


def expanded(cols, maps):
    """Both pairs frequent, and the first one expanded or the last contending."""
    pairs, grown, contending = maps
    first, last = phrase_key(cols[:2]), phrase_key(cols[1:])
    return holds(pairs, first) & holds(pairs, last) & (holds(grown, first) | holds(contending, last))


# ---- scores ---------------------------------------------------------------------------

def big(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(18,0)")


def cut_score(a, l, r) -> Column:
    """floor(SCALE * a * a / (l * r)), exactly: products of up to 38 digits."""
    scaled = (big(a) * big(a)).cast("decimal(31,0)") * F.lit(SCALE).cast("decimal(7,0)")
    return F.call_function("div", scaled, (big(l) * big(r)).cast("decimal(38,0)"))


def word_table(docs: DataFrame) -> tuple[DataFrame, int]:
    """Counts of all words under a seed that keeps all their hashes apart."""
    for seed in range(SEEDS):
        words = stored(count_words(docs, seed))
        if not words.groupBy("h").count().where("count > 1").head(1):
            return words, seed
    raise RuntimeError(f"words share a hash under each of {SEEDS} seeds")


def threshold(pairs: DataFrame, want: int) -> DataFrame:
    """(lang, reach): the score that ``want`` pairs reach, none if there are
    fewer.  Scores are whole numbers up to ``SCALE``, so are a language's rows."""
    down = Window.partitionBy("lang").orderBy(F.desc("score"))
    return (pairs.groupBy("lang", "score").count().withColumn("above", F.sum("count").over(down))
            .where(F.col("above") >= want).groupBy("lang").agg(F.max("score").alias("reach")))


def collocations(df: DataFrame, text: str = "text", lang: str = "lang", top: int = TOP) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of each language's best."""
    ship(df.sparkSession)
    docs = df.select(F.col(f"`{text}`").alias("text"), F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"))
    words, seed = word_table(docs)
    frequent = words.where(F.col("n") >= MIN_COUNT)
    one = frequent.select("h", "n")
    counted_pairs = count_phrases(docs, seed, 2, frequent_words, (bitmap(one.select("h")),))
    pairs = stored(
        counted_pairs.join(frequent.select(F.col("h").alias("h1"), "lang", F.col("n").alias("l")), "h1")
        .join(one.select(F.col("h").alias("h2"), F.col("n").alias("r")), "h2")
        .withColumn("score", cut_score("a", "l", "r"))
        .withColumn("bound", F.call_function("div", big("a") * F.lit(SCALE).cast("decimal(7,0)"), big("l"))))
    all_pairs = bitmap(pairs.select("h1", "h2"))
    state = words.groupBy("lang").agg(F.sum("n").alias("n")).select(
        "lang", "n", F.lit(SCALE + 1).cast("long").alias("reach"), F.lit(True).alias("open"))
    state = stored(state)
    grown, want = [], FIRST * top
    while True:
        state = stored(state.withColumnRenamed("reach", "before").join(threshold(pairs, want), "lang", "left").select(
            "lang", "n", "before", "open",
            F.when(F.col("open"), F.coalesce("reach", F.lit(0).cast("long"))).otherwise(F.col("before")).alias("reach")))
        near = pairs.join(state.drop("n", "open"), "lang")
        fresh = lambda c: (F.col(c) >= F.col("reach")) & (F.col(c) < F.col("before"))
        maps = (all_pairs, bitmap(near.where(fresh("bound")).select("h1", "h2")), bitmap(near.where(fresh("score")).select("h1", "h2")))
        grown.append(stored(three_words(count_phrases(docs, seed, 3, expanded, maps), pairs, state)))
        triples = reduce(DataFrame.unionByName, grown)
        found = survivors(pairs, triples, state)
        enough = found.groupBy("lang").agg(F.count(F.lit(1)).alias("found"))
        state = stored(state.join(enough, "lang", "left").select(
            "lang", "n", "reach", (F.col("open") & (F.coalesce("found", F.lit(0)) < top) & (F.col("reach") > 0)).alias("open")))
        if not state.where("open").head(1):
            return best(found, frequent, state, top)
        want *= WIDEN


def three_words(counts: DataFrame, pairs: DataFrame, state: DataFrame) -> DataFrame:
    """Counted three-word phrases that this round's nodes reach, with the
    lower of their two cuts."""
    head = pairs.select("h1", "h2", "lang", F.col("l").alias("f1"), F.col("a").alias("f12"), F.col("bound").alias("grow"))
    tail = pairs.select(F.col("h1").alias("h2"), F.col("h2").alias("h3"), F.col("a").alias("f23"), F.col("r").alias("f3"),
                        F.col("score").alias("contend"))
    at_least = lambda c: (F.col("grow") >= F.col(c)) | (F.col("contend") >= F.col(c))
    s1, s2 = cut_score("a", "f1", "f23"), cut_score("a", "f12", "f3")
    return (counts.join(head, ["h1", "h2"]).join(tail, ["h2", "h3"]).join(state.select("lang", "before", "reach"), "lang")
            .where(at_least("reach") & ~at_least("before")).withColumn("s1", s1).withColumn("s2", s2)
            .select("lang", "h1", "h2", "h3", "a", F.when(F.col("s2") < F.col("s1"), F.col("f12")).otherwise(F.col("f1")).alias("l"),
                    F.when(F.col("s2") < F.col("s1"), F.col("f3")).otherwise(F.col("f23")).alias("r"), F.least("s1", "s2").alias("score")))


def survivors(pairs: DataFrame, triples: DataFrame, state: DataFrame) -> DataFrame:
    """All candidates from each language's threshold up that no longer one
    takes in."""
    inside = (triples.select("h1", "h2", F.col("a").alias("longer"))
              .unionByName(triples.select(F.col("h2").alias("h1"), F.col("h3").alias("h2"), F.col("a").alias("longer")))
              .groupBy("h1", "h2").agg(F.max("longer").alias("longer")))
    reach = state.select("lang", "reach")
    two = (pairs.join(reach, "lang").where(F.col("score") >= F.col("reach")).join(inside, ["h1", "h2"], "left")
           .where(F.col("longer").isNull() | (100 * F.col("longer") < SHARE * F.col("a")))
           .select("lang", "h1", "h2", F.lit(None).cast("long").alias("h3"), "a", "l", "r", "score"))
    three = triples.join(reach, "lang").where(F.col("score") >= F.col("reach")).drop("reach")
    return two.unionByName(three)


def best(found: DataFrame, words: DataFrame, state: DataFrame, top: int) -> DataFrame:
    for i in (1, 2, 3):
        found = found.join(words.select(F.col("h").alias(f"h{i}"), F.col("word").alias(f"w{i}")), f"h{i}", "left" if i == 3 else "inner")
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    rows = (found.withColumn("phrase", F.concat_ws(" ", "w1", "w2", "w3")).withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
            .withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
            .withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top))
    return rows.join(state.select("lang", "n"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
