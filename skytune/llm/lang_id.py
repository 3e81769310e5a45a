"""Language identification with error-correcting output codes.

Languages get binary codewords, a binary n-gram classifier predicts each bit,
and the codeword nearest to the predicted bits, by a weighted loss, wins.

* Codewords: with L languages, the rows of a Sylvester-Hadamard matrix of order
  at least max(8, 2 L) without its constant column, so that any two differ in
  half of the bits; bits that are equal for all languages are left out.  With
  more than ``HADAMARD`` languages, random words of ``RANDOM_BITS`` bits, which
  differ in about half of them, so that the model does not grow with their number
  but for one codeword each.
* Bit classifiers: naive Bayes over letters.  Runs of letters are lower-cased,
  padded with a space; all n-grams of 1 to 3 characters are hashed to
  ``DIMENSIONS``.  Bit b weighs an n-gram by ln P(g | languages with b = 1) -
  ln P(g | languages with b = 0), each language counting alike; the margin of a
  text is the mean weight of its n-grams, in units of the spread of this mean
  over the fitted texts.
* The counts behind the weights come from every training row (one sum per
  language and dimension), and the weights from these, both made in Spark; the
  driver receives one number per dimension and bit.  Bit weights (accuracy of each
  classifier) and spreads come from a bounded sample of training rows:
  ``SAMPLE_ROWS`` rows with the smallest hash of doc_id.
* Decoding: loss(c) = sum over bits of weight_b * exp(-code_cb * margin_b); the
  least loss wins.  score = softmax of -loss; ``ambiguous`` where, of the two
  best alone, the shares of the softmax are within ``AMBIGUITY`` (the number of
  languages does not matter).

Training rows: ``crc32(doc_id as text) mod 3 <> 1`` and lang not null.  Neither
lang, source nor doc_id is an input of a prediction.

Defined results: ``und`` with score 0 for a null text, a text without a letter,
or when there is nothing to learn from; ambiguous is then true.  With a single
language in training every other text gets it, with score 1.  An empty table
gives an empty table; repeated rows count and are returned as often as they
come.  Every language found is learned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from .arrow_schema import to_arrow
from .common import ship, stored

DIMENSIONS = 1 << 14
SAMPLE_ROWS = 4000
HADAMARD, RANDOM_BITS = 256, 512
_BLOCK = 256                      # dimensions of one group
AMBIGUITY = 0.05
SMOOTHING = 0.5
UND = "und"
_PIECE = 1 << 16                   # characters at a time


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


# ---- features --------------------------------------------------------------

_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """True for the code points that are letters; made once a process."""
    if not _LETTER:
        _LETTER.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _LETTER[0]


def ngrams(text: str) -> np.ndarray:
    """Hashed n-grams (1 to 3) of the letters of one text."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = _letters()[np.minimum(code, 0x10FFFF)]
    if not is_letter.any():
        return np.zeros(0, np.int64)
    code = np.where(is_letter, code, 0).astype(np.uint64)
    # one space between runs
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    code = np.concatenate([[np.uint64(0)], code[keep], [np.uint64(0)]]) + np.uint64(1)
    one = code * np.uint64(0x9E3779B97F4A7C15)
    two = one[:-1] * np.uint64(31) + code[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    three = two[:-1] * np.uint64(37) + code[2:] * np.uint64(0x165667B19E3779F9)
    out = np.concatenate([one[code > 1], two, three])
    out ^= out >> np.uint64(29)
    return ((out * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - int(np.log2(DIMENSIONS)))).astype(np.int64)


def _pieces(text: str) -> list[str]:
    """Long texts in pieces, cut between characters (whole text, bounded memory)."""
    return [text[i:i + _PIECE] for i in range(0, len(text), _PIECE)]


def codewords(n: int) -> np.ndarray:
    """n rows of +1 / -1, any two of which differ in (about) half of the columns."""
    if n > HADAMARD:
        rows = np.random.default_rng(7).choice(np.array([-1, 1]), (n, RANDOM_BITS))
    else:
        order = 8
        while order < 2 * n:
            order *= 2
        h = np.array([[1]])
        while len(h) < order:
            h = np.block([[h, h], [h, -h]])
        rows = h[order - n:, 1:] if n > 1 else h[:1, 1:]
    vary = (rows != rows[0]).any(axis=0)
    return rows[:, vary]


# ---- fitting -----------------------------------------------------------------

class Model:
    """languages, code (L x B), table (DIMENSIONS x B), spread (B), weight (B)"""

    def __init__(self, languages, code, table):
        self.languages, self.code, self.table = languages, code, table
        self.spread, self.weight = np.ones(code.shape[1]), np.ones(code.shape[1])

    def margins(self, text: str | None) -> np.ndarray | None:
        total, n = np.zeros(self.code.shape[1]), 0
        for piece in _pieces(text or ""):
            g = ngrams(piece)
            if len(g):
                total += self.table[g].sum(axis=0, dtype=np.float64)
                n += len(g)
        return total / n if n else None

    def losses(self, margin: np.ndarray) -> np.ndarray:
        """sum of weight * exp(-code * margin), each term one of two values."""
        m = np.clip(margin / self.spread, -8, 8)
        near, far = self.weight * np.exp(-m), self.weight * np.exp(m)
        return ((near + far).sum() + self.code @ (near - far)) / 2 / self.weight.sum()

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not self.languages:
            return UND, 0.0, True
        if self.code.shape[1] == 0:
            return (self.languages[0], 1.0, False) if len(ngrams_any(text)) else (UND, 0.0, True)
        margin = self.margins(text)
        if margin is None:
            return UND, 0.0, True
        loss = self.losses(margin)
        p = np.exp(loss.min() - loss)
        p /= p.sum()
        best = int(np.argmin(loss))
        second = np.partition(p, -2)[-2] if len(p) > 1 else 0.0
        return self.languages[best], float(p[best]), bool(p[best] - second < AMBIGUITY * (p[best] + second))


def ngrams_any(text: str | None) -> np.ndarray:
    for piece in _pieces(text or ""):
        g = ngrams(piece)
        if len(g):
            return g
    return np.zeros(0, np.int64)


def _texts(batch: pa.RecordBatch, name: str):
    return (v.as_py() for v in batch.column(name))


def fit(train: DataFrame) -> Model:
    """``train(doc_id, text, lang)``, lang not null.  The driver receives the
    languages with their totals, one number per dimension and bit, and margins
    of ``SAMPLE_ROWS`` texts."""
    spark = train.sparkSession

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(_texts(b, "lang"), _texts(b, "text")):
                for piece in _pieces(text or ""):
                    g = ngrams(piece)
                    if len(g):
                        if lang not in sums:
                            sums[lang] = np.zeros(DIMENSIONS, np.int64)
                        sums[lang] += np.bincount(g, minlength=DIMENSIONS)
        for lang, v in sums.items():
            at = np.flatnonzero(v)
            yield pa.record_batch({"lang": pa.array([lang] * len(at)), "dim": pa.array(at.astype(np.int32)), "n": pa.array(v[at])})

    # as one list for each language and block of dimensions
    counts = (train.select("lang", "text").mapInArrow(count, "lang string, dim int, n long")
              .groupBy("lang", "dim").agg(F.sum("n").alias("n")))
    counts = stored(counts)
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(totals)
    code = codewords(len(languages))
    if not languages:
        return Model([], code, np.zeros((DIMENSIONS, 0)))
    # P(g | language) = (n + SMOOTHING) / whole; bits weigh the means over their languages
    whole = np.array([totals[x] for x in languages], float) + SMOOTHING * DIMENSIONS
    on, off = code > 0, code <= 0
    floor_on, floor_off = (SMOOTHING * (side / whole[:, None]).sum(axis=0) / np.maximum(side.sum(axis=0), 1) for side in (on, off))
    place = {x: i for i, x in enumerate(languages)}
    sent = spark.sparkContext.broadcast((place, whole, on, floor_on, floor_off))

    def weigh(t: pa.Table) -> pa.Table:
        place, whole, on, floor_on, floor_off = sent.value
        who = np.array([place[x] for x in t.column("lang").to_pylist()])
        dims, row = np.unique(t.column("dim").to_numpy(), return_inverse=True)
        share = t.column("n").to_numpy() / whole[who]
        sums = np.zeros((len(dims), on.shape[1])), np.zeros((len(dims), on.shape[1]))
        for i in np.argsort(who, kind="stable").tolist():
            sums[0][row[i]] += share[i] * on[who[i]]
            sums[1][row[i]] += share[i] * ~on[who[i]]
        up = sums[0] / np.maximum(on.sum(axis=0), 1) + floor_on
        down = sums[1] / np.maximum((~on).sum(axis=0), 1) + floor_off
        weights = (np.log(up) - np.log(down)).astype(np.float32)
        return pa.table({"dim": pa.array(dims.astype(np.int32)), "w": pa.array(list(weights), pa.list_(pa.float32()))})

    table = np.tile((np.log(floor_on) - np.log(floor_off)).astype(np.float32), (DIMENSIONS, 1))
    if code.shape[1]:
        got = counts.groupBy(F.floor(F.col("dim") / _BLOCK)).applyInArrow(weigh, "dim int, w array<float>").toPandas()
        if len(got):
            table[got["dim"].to_numpy()] = np.stack(got["w"].to_list())
    model = Model(languages, code, table)
    if code.shape[1] == 0:
        return model

    def margins(batches):
        for b in batches:
            got = [(lang, m.tolist()) for lang, text in zip(_texts(b, "lang"), _texts(b, "text"))
                   if (m := model.margins(text)) is not None]
            if got:
                yield pa.record_batch({"lang": pa.array([x for x, _ in got]), "m": pa.array([m for _, m in got], pa.list_(pa.float64()))})

    n = train.count()
    few = train
    if n > SAMPLE_ROWS:      # at most about SAMPLE_ROWS rows, whatever the input
        few = few.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * SAMPLE_ROWS / n))
    sample = few.select("lang", "text").mapInArrow(margins, "lang string, m array<double>").limit(2 * SAMPLE_ROWS).toPandas()
    if len(sample):
        m = np.stack(sample["m"].to_list())
        truth = code[sample["lang"].map(place).to_numpy(int)]
        model.spread = np.maximum(np.abs(m).mean(axis=0), 1e-6)
        right = ((np.sign(m) == truth).sum(axis=0) + 1) / (len(m) + 2)
        model.weight = np.maximum(np.log(right / (1 - right)), 1e-3)
    return model


# ---- prediction ----------------------------------------------------------------

def predict(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` with ``lang_pred, score, ambiguous`` (names that ``df`` has
    already are replaced).  The model's size is fixed by DIMENSIONS and the
    number of languages; it is broadcast once."""
    spark = df.sparkSession
    df = df.drop("lang_pred", "score", "ambiguous")
    schema = StructType([*df.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType()),
                         StructField("ambiguous", BooleanType())])
    target = to_arrow(spark, schema)
    held = spark.sparkContext.broadcast((model.languages, model.code, model.table, model.spread, model.weight))

    def run(batches):
        languages, code, table, spread, weight = held.value
        m = Model(languages, code, table)
        m.spread, m.weight = spread, weight
        for b in batches:
            got = [m.predict(t) for t in _texts(b, text)]
            lang, score, odd = zip(*got) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(odd, pa.bool_())], schema=target)

    return df.mapInArrow(run, schema)


def identify(df: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """Fit on the training rows of ``df`` and predict all of them."""
    ship(df.sparkSession)
    train = df.where(~held_out(F.col(f"`{doc_id}`")) & F.col(f"`{lang}`").isNotNull()).select(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"))
    return predict(df, fit(train), text)
