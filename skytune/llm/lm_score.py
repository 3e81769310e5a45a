"""Documents scored by masked pseudo-likelihood.

A window network predicts every token from the tokens on both sides of it
(``WINDOW`` each way, the token itself masked); a document's score is the sum
of ln P(token | both sides) over all its tokens.

* Tokens: runs of non-blank bytes, A-Z lower-cased.  The network's vocabulary
  is the ``TOP`` most frequent ones, counted over all documents, and ``RARE``
  hash buckets for all others: ``CLASSES`` classes by frequency rank, each of
  ``CLASSES`` members.
* Words inside a bucket: P(word | both sides) = P(bucket | both sides) *
  P(word | bucket), the latter from the counts of all words (Witten-Bell: a word
  seen n times has n / (N + T + 1), with N tokens of T words in the bucket; the
  unseen ones share (T + 1) / (N + T + 1) by a uniform model of their bytes).
  The counts of all words stay a Spark table.  Tasks hold its most frequent
  words, ``NEAR`` at most; only the words beyond these are joined to it, as
  distinct words of each document.
* Network: hidden = tanh(sum over places of scale_place * E[token] + bias);
  P(token) = P(class | hidden) * P(token | class, hidden).  Biases start at the
  corpus' own frequencies, so that training starts from the unigram model.
* Training in numpy inside tasks, over every document once: ``ROUNDS`` rounds,
  each over the documents of one residue of a hash of doc_id.  In a round each
  task starts from the same weights and runs Adagrad over its documents; the
  weights of all tasks are then averaged in Spark, weighted by their tokens
  (whole numbers, so the order of summation does not matter).  What is gathered
  from the corpus, the counts of all its words, grows with it; the network
  (``params`` numbers) does not.

Defined results: a null or empty text has 0 tokens, score 0.0 and a null mean;
with an empty table nothing is trained and nothing returned; very long texts
are read in blocks, with their neighbours on both sides; repeated rows count
as often as they come.
"""

from __future__ import annotations

from collections import Counter
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .arrow_schema import to_arrow
from .common import ship, stored

CLASSES = 32
RARE = 64
TOP = CLASSES * CLASSES - RARE
PAD = CLASSES * CLASSES
WIDTH = 16
WINDOW = 2
PLACES = (-2, -1, 1, 2)
NEAR = 1 << 17                    # rare words whose probability inside the bucket tasks hold: some 20 MB a worker
_CODES = 1 << 11                  # above all ids
MEMO = 1 << 17                    # buckets of words a task remembers
ROUNDS = 2
RATE = 0.05
BATCH = 8192
LIMIT = np.float32(60)
_FIXED = 1 << 20
_FIRST, _NEXT = 256 - 6 - 26, 256 - 6 - 26 + 1      # bytes that a word can begin with, and go on with or end
_FLUSH = 200_000                  # distinct words held before they are passed on
_SHAPES = {"embed": (PAD + 1, WIDTH), "scale": (len(PLACES), WIDTH), "bias": (WIDTH,), "to_class": (WIDTH, CLASSES),
           "class_bias": (CLASSES,), "to_word": (CLASSES, WIDTH, CLASSES), "word_bias": (CLASSES, CLASSES)}
params = sum(int(np.prod(s)) for s in _SHAPES.values())


# ---- tokens ------------------------------------------------------------------

class Vocabulary(dict):
    """Ids of the ``TOP`` words; ``near``: ln P(word | bucket) of at most ``NEAR``
    next ones, in steps of 1 / ``_FIXED``; ``rare``: a Spark table (word, inside) of
    all words outside the vocabulary, ``far``: of those that ``near`` lacks;
    ``unseen``: ln of what each bucket leaves to words that the corpus does not
    hold."""

    near: dict[bytes, int]
    rare: DataFrame
    far: DataFrame
    unseen: list[float]


class Ids(dict):
    """Ids of all words: those of a vocabulary, and the buckets of others as
    they come up."""

    def __init__(self, vocab: dict[bytes, int]):
        super().__init__(vocab)
        self.limit = len(vocab) + MEMO

    def __missing__(self, word: bytes) -> int:
        i = TOP + crc32(word) % RARE
        if len(self) < self.limit:
            self[word] = i
        return i


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def count_words(df: DataFrame, text: str) -> DataFrame:
    def run(batches):
        seen: Counter = Counter()

        def flush():
            out = pa.record_batch({"word": pa.array(list(seen), pa.binary()), "n": pa.array(list(seen.values()), pa.int64())})
            seen.clear()
            return out

        for b in batches:
            for v in b.column("text"):
                seen.update(words(v.as_py()))
                if len(seen) > _FLUSH:
                    yield flush()
        yield flush()

    return (df.select(F.col(f"`{text}`").alias("text")).mapInArrow(run, "word binary, n long")
            .groupBy("word").agg(F.sum("n").alias("n")))


def token_ids(text: str | None, vocab: dict[bytes, int]) -> list[int]:
    ids = vocab if isinstance(vocab, Ids) else Ids(vocab)
    return [ids[w] for w in words(text)]


def coded(vocab: dict[bytes, int], near: dict[bytes, int]) -> tuple[dict[bytes, int], np.ndarray]:
    """One number per known word, its id and (times ``_CODES``) its place among
    ``near``, from 1; and the values at these places."""
    codes = dict(vocab)
    for place, w in enumerate(near, start=1):
        codes[w] = TOP + crc32(w) % RARE + _CODES * place
    return codes, np.array([0, *near.values()], np.int64)


def rare_words(split: list[list[bytes]], codes: np.ndarray, near: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Of each text (its words; ``codes`` of all texts' words): the sum of the
    values of its words in ``near``, and the distinct words outside both the
    vocabulary and ``near`` with their numbers."""
    sizes = np.array([len(w) for w in split], np.int64)
    doc = np.repeat(np.arange(len(split)), sizes)
    held = np.flatnonzero(codes >= _CODES)
    sums = np.zeros(len(split), np.int64)
    np.add.at(sums, doc[held], near[codes[held] // _CODES])
    far: list[dict[bytes, int]] = [{} for _ in split]
    starts = np.cumsum(sizes) - sizes
    at = np.flatnonzero((codes >= TOP) & (codes < _CODES))
    for i, k in zip(doc[at].tolist(), (at - starts[doc[at]]).tolist()):
        w, d = split[i][k], far[i]
        d[w] = d.get(w, 0) + 1
    items = pa.StructArray.from_arrays([pa.array([w for c in far for w in c], pa.binary()),
                                        pa.array([n for c in far for n in c.values()], pa.int64())], names=["word", "n"])
    return pa.array(sums), pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(c) for c in far])], pa.int32()), items)


def windows(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of tokens, and the ids at the PLACES around each; documents are
    parted by PADs (WINDOW before, between and after them)."""
    at = np.flatnonzero(ids != PAD)
    return at, np.stack([ids[at + p] for p in PLACES])


# ---- network -----------------------------------------------------------------

def start_network(counts: np.ndarray, seed: int = 11) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    share = (counts + 1.0) / (counts + 1.0).sum()
    grid = share.reshape(CLASSES, CLASSES)
    net = {"embed": rng.normal(0, 0.3, _SHAPES["embed"]), "scale": np.ones(_SHAPES["scale"]) * [[0.5], [1], [1], [0.5]],
           "bias": np.zeros(WIDTH), "to_class": rng.normal(0, 0.02, _SHAPES["to_class"]), "class_bias": np.log(grid.sum(axis=1)),
           "to_word": rng.normal(0, 0.02, _SHAPES["to_word"]), "word_bias": np.log(grid / grid.sum(axis=1, keepdims=True))}
    return {k: v.astype(np.float32) for k, v in net.items()}


def by_class(target: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Order of a batch by the class of its targets, and the classes' slices."""
    klass = target // CLASSES
    order = np.argsort(klass, kind="stable")
    cut = np.searchsorted(klass[order], np.arange(CLASSES + 1)).tolist()
    return order, [(c, cut[c], cut[c + 1]) for c in range(CLASSES) if cut[c] < cut[c + 1]]


def places_table(net) -> np.ndarray:
    """What each token adds to the hidden layer at each place."""
    return net["scale"][:, None, :] * net["embed"][None]


def _exp_sum(x: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ln softmax at ``pick``, and exp(x) with its sums (x is overwritten).
    Scores are held within LIMIT, far inside what a float's exp can take."""
    np.clip(x, -LIMIT, LIMIT, out=x)
    got = x[np.arange(len(x)), pick]
    np.exp(x, out=x)
    total = x @ np.ones(x.shape[1], x.dtype)
    return got - np.log(total), x, total


def forward(net, table: np.ndarray, context: np.ndarray, target: np.ndarray, slices):
    """ln P(target | context) of a batch in order of class, and what
    ``backward`` needs."""
    hidden = np.take(table[0], context[0], axis=0)
    for p in range(1, len(PLACES)):
        hidden += np.take(table[p], context[p], axis=0)
    hidden += net["bias"]
    np.tanh(hidden, out=hidden)
    klass, member = target // CLASSES, target % CLASSES
    x = hidden @ net["to_class"]
    x += net["class_bias"]
    log_c, e_c, t_c = _exp_sum(x, klass)
    y = np.empty((len(target), CLASSES), np.float32)
    for c, lo, hi in slices:
        np.matmul(hidden[lo:hi], net["to_word"][c], out=y[lo:hi])
        y[lo:hi] += net["word_bias"][c]
    log_w, e_w, t_w = _exp_sum(y, member)
    return log_c + log_w, (hidden, e_c, t_c, e_w, t_w, klass, member)


def backward(net, table: np.ndarray, context: np.ndarray, kept, slices) -> dict[str, np.ndarray]:
    """Gradient of the mean of ln P."""
    hidden, e_c, t_c, e_w, t_w, klass, member = kept
    n, at = len(klass), np.arange(len(klass))
    d_c, d_w = e_c, e_w
    d_c *= (-1 / n / t_c)[:, None]
    d_w *= (-1 / n / t_w)[:, None]
    d_c[at, klass] += np.float32(1 / n)
    d_w[at, member] += np.float32(1 / n)
    grad = {"to_class": hidden.T @ d_c, "class_bias": d_c.sum(axis=0),
            "to_word": np.zeros_like(net["to_word"]), "word_bias": np.zeros_like(net["word_bias"])}
    d_h = d_c @ net["to_class"].T
    for c, lo, hi in slices:
        grad["to_word"][c] = hidden[lo:hi].T @ d_w[lo:hi]
        grad["word_bias"][c] = d_w[lo:hi].sum(axis=0)
        d_h[lo:hi] += d_w[lo:hi] @ net["to_word"][c].T
    d_h *= 1 - hidden * hidden
    grad["bias"] = d_h.sum(axis=0)
    grad["embed"], grad["scale"] = np.zeros_like(net["embed"]), np.empty_like(net["scale"])
    for p in range(len(PLACES)):
        order = np.argsort(context[p], kind="stable")
        token = context[p][order]
        first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        sums = np.add.reduceat(np.take(d_h, order, axis=0), first, axis=0)      # of each token at this place
        found = token[first]
        grad["embed"][found] += sums * net["scale"][p]
        grad["scale"][p] = (sums * net["embed"][found]).sum(axis=0)
    return grad


class Trainer:
    """Adagrad over batches of ``BATCH`` tokens."""

    def __init__(self, net):
        self.net = {k: v.copy() for k, v in net.items()}
        self.sums = {k: np.full_like(v, 1e-6) for k, v in net.items()}
        self.tokens = 0

    def step(self, context, target):
        order, slices = by_class(target)
        context, target = context[:, order], target[order]
        table = places_table(self.net)
        grad = backward(self.net, table, context, forward(self.net, table, context, target, slices)[1], slices)
        for k, g in grad.items():
            self.sums[k] += g * g
            self.net[k] += RATE * g / np.sqrt(self.sums[k])
        self.tokens += len(target)

    def learn(self, ids: np.ndarray):
        at, context = windows(ids)
        for i in range(0, len(at), BATCH):
            self.step(context[:, i:i + BATCH], ids[at[i:i + BATCH]])


def flat(net) -> np.ndarray:
    return np.concatenate([net[k].ravel() for k in _SHAPES])


def unflat(v: np.ndarray) -> dict[str, np.ndarray]:
    out, i = {}, 0
    for k, s in _SHAPES.items():
        out[k] = v[i:i + int(np.prod(s))].reshape(s).astype(np.float32)
        i += int(np.prod(s))
    return out


def flat_ids(split: list[list[bytes]], vocab: dict[bytes, int]) -> np.ndarray:
    ids = vocab if isinstance(vocab, Ids) else Ids(vocab)
    return np.fromiter(map(ids.__getitem__, chain.from_iterable(split)), np.int32, sum(map(len, split)))


def padded(ids: np.ndarray, sizes: list[int]) -> np.ndarray:
    """The texts' ids one after another, parted by PADs."""
    out = np.full(len(ids) + WINDOW * (len(sizes) + 1), PAD, np.int16)
    out[np.arange(len(ids)) + WINDOW * (np.repeat(np.arange(len(sizes)), sizes) + 1)] = ids
    return out


# ---- Spark -----------------------------------------------------------------------

def _of_bucket(values: list[float]) -> Column:
    """The one of ``RARE`` values that stands for the bucket of ``word``."""
    return F.get(F.array(*[F.lit(v) for v in values]), (F.crc32("word") % RARE).cast("int"))


def train(df: DataFrame, text: str, doc_id: str, rounds: int = ROUNDS):
    """(``Vocabulary``, network) fitted on all rows of ``df``."""
    spark = df.sparkSession
    counts = stored(count_words(df, text))
    top = counts.orderBy(F.desc("n"), "word").limit(TOP).collect()
    vocab = Vocabulary((bytes(r["word"]), i) for i, r in enumerate(top))
    freq = np.zeros(PAD)
    freq[:len(top)] = [r["n"] for r in top]
    others = counts.join(F.broadcast(spark.createDataFrame([(w,) for w in vocab], "word binary")), "word", "left_anti").withColumn(
        "bucket", F.crc32("word") % RARE)
    kinds = np.zeros(RARE)
    for r in others.groupBy("bucket").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds")).collect():
        freq[TOP + r["bucket"]], kinds[r["bucket"]] = r["n"], r["kinds"]
    mass = np.log(freq[TOP:] + kinds + 1)
    vocab.unseen = (np.log(kinds + 1) - mass).tolist()
    inside = others.select("word", "n", (F.ln("n") - _of_bucket(mass.tolist())).alias("inside"))
    vocab.rare = inside.select("word", "inside")
    # by powers of two of the counts: at most 64 numbers tell which words fit
    size = F.floor(F.log2("n")).cast("int")
    least, fit = 64, 0
    for r in sorted(others.groupBy(size.alias("size")).count().collect(), reverse=True):
        if (fit := fit + r["count"]) > NEAR:
            break
        least = r["size"]
    vocab.near = {bytes(r["word"]): round(r["inside"] * _FIXED) for r in inside.where(size >= least).collect()}
    inside = inside.where(size < least)
    vocab.far = inside.select("word", F.round(F.col("inside") * _FIXED).cast("long").alias("inside"))
    net = start_network(freq)
    narrow = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    for r in range(rounds):
        held = spark.sparkContext.broadcast((dict(vocab), net))

        def learn(batches, held=held):
            vocab, net = held.value
            vocab = Ids(vocab)
            t = Trainer(net)
            for b in batches:
                for lo in range(0, b.num_rows, 256):
                    split = [words(v) for v in b.column("text").slice(lo, 256).to_pylist()]
                    t.learn(padded(flat_ids(split, vocab), [len(w) for w in split]))
            if t.tokens:
                value = np.rint(flat(t.net).astype(np.float64) * _FIXED).astype(np.int64)
                yield pa.record_batch({"place": pa.array(np.arange(params, dtype=np.int32)), "value": pa.array(value),
                                       "tokens": pa.array(np.full(params, t.tokens, np.int64))})

        mine = narrow.where(F.pmod(F.xxhash64("doc_id"), F.lit(rounds)) == r).select("text")
        mean = (mine.mapInArrow(learn, "place int, value long, tokens long").groupBy("place")
                .agg((F.sum(F.col("value").cast("decimal(19,0)") * F.col("tokens").cast("decimal(15,0)")).cast("double")
                      / F.sum("tokens")).alias("value")))
        got = mean.toPandas()            # one row for each of the network's numbers
        if len(got):
            v = np.empty(params)
            v[got["place"].to_numpy()] = got["value"].to_numpy() / _FIXED
            net = unflat(v)
    return vocab, net


def document_scores(texts, vocab, net) -> tuple[list[int], np.ndarray]:
    """Tokens of each text and its sum of ln P(class member | both sides): for
    a rare word that of its bucket."""
    split = [words(t) for t in texts]
    return token_scores(flat_ids(split, vocab), [len(w) for w in split], net)


def token_scores(flat: np.ndarray, sizes: list[int], net) -> tuple[list[int], np.ndarray]:
    ids = padded(flat, sizes)
    at, context = windows(ids)
    logp, table = np.empty(len(at)), places_table(net)
    for i in range(0, len(at), BATCH):
        target = ids[at[i:i + BATCH]]
        order, slices = by_class(target)
        logp[i + order] = forward(net, table, context[:, i:i + BATCH][:, order], target[order], slices)[0]
    doc = np.repeat(np.arange(len(sizes)), sizes)
    return sizes, np.bincount(doc, weights=logp, minlength=len(sizes))


def score(df: DataFrame, vocab: Vocabulary, net, text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """``df``, or some ``columns`` of it, with ``n_tokens, pll, mean_pll``
    (existing ones are replaced)."""
    spark = df.sparkSession
    df = df.drop("n_tokens", "pll", "mean_pll")
    columns = df.columns if columns is None else columns
    numbered = df.select(*[F.col(f"`{c}`") for c in columns], F.monotonically_increasing_id().alias("__row"), F.col(f"`{text}`").alias("__text"))
    schema = StructType([*numbered.schema.fields[:-1], *StructType.fromDDL(
        "n_tokens long, __network double, __near long, __rare array<struct<word: binary, n: long>>").fields])
    target = to_arrow(spark, schema)
    held = spark.sparkContext.broadcast((*coded(vocab, vocab.near), net))

    def run(batches):
        codes, near, net = held.value
        codes = Ids(codes)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                split = [words(t) for t in part.column("__text").to_pylist()]
                found = flat_ids(split, codes)
                sizes, sums = token_scores(found % _CODES, [len(w) for w in split], net)
                inside, far = rare_words(split, found, near)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(sizes, pa.int64()), pa.array(sums), inside,
                                                  far.cast(target.field("__rare").type)], schema=target)

    scored = stored(numbered.mapInArrow(run, schema))
    unseen = (_of_bucket(vocab.unseen) - float(np.log(_FIRST)) - F.length("word") * float(np.log(_NEXT))) * _FIXED
    # whole numbers, so that the order of summation does not matter; no word that is one of many tokens is a key here
    inside = (scored.select("__row", F.explode("__rare").alias("r")).select("__row", "r.word", "r.n")
              .join(vocab.far, "word", "left")
              .groupBy("__row").agg(F.sum(F.col("n") * F.coalesce("inside", F.round(unseen).cast("long"))).alias("__inside")))
    pll = F.col("__network") + (F.col("__near") + F.coalesce("__inside", F.lit(0))) / _FIXED
    return (scored.drop("__rare").join(inside, "__row", "left").withColumn("pll", pll)
            .select(*[F.col(f"`{c}`") for c in columns], "n_tokens", "pll",
                    F.when(F.col("n_tokens") > 0, F.col("pll") / F.col("n_tokens")).alias("mean_pll")))


def score_documents(df: DataFrame, text: str = "text", doc_id: str = "doc_id", rounds: int = ROUNDS,
                    columns: list[str] | None = None) -> DataFrame:
    """Train on all rows of ``df`` and score all of them; ``columns`` of ``df``
    to keep, all by default."""
    ship(df.sparkSession)
    return score(df, *train(df, text, doc_id, rounds), text=text, columns=columns)
