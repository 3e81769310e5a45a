"""SentencePiece encoding by sampling without replacement, and decoding.

A text has many segmentations into the model's pieces; each has probability
proportional to the product of its pieces' weights.  ``sample_segmentations``
draws the k that come first under Gumbel noise (Gumbel top-k: a sample without
replacement) by a perturbed A* search over the lattice, with the score that
turns such a sample into unbiased estimates: the (log) probability of being
included above the (k+1)-th perturbed value.

* The model's file gives pieces only; they are never trained.  BPE models store
  merge ranks instead of probabilities: the weight of a piece is 1 / (rank +
  OFFSET), normalised over the vocabulary.  Characters outside the vocabulary
  are spelled in byte pieces at the weight of the last rank.
* No piece has a space after another character, so the lattice falls apart at
  each run of spaces; it is built once for each distinct word of a slice of
  text, for all words at once in numpy.  ``beta`` (log of the sum over all
  completions) is exact, so a first-come expansion needs no backtracking: the
  best child of a node inherits its perturbed value, drawn by its exact
  conditional probability, and its siblings stay together as one entry of the
  queue with a Gumbel value truncated at the parent's.  Popping that entry
  picks one of them, and leaves the others behind as a new entry.  Eight samples
  by default: seven times the search leaves one of the paths found so far.
  Noise being given, all samples' ways through whole words are drawn ahead, for
  some words at a time, whose arcs stay in the cache; a sample takes those after
  the word in which it leaves its parent.
* Noise comes from a hash of (row key, seed, number of the sample, word, step),
  so it does not depend on partitions, batches or retries, and fewer samples
  are the first of more.  Entries whose value cannot reach the k+1 best (a
  double's Gumbel noise is at most ``REACH``) are not written down: exact, and a
  text of any length needs a short queue.

``decode`` joins pieces to bytes; it is the exact inverse for every text.

Defined results: a null text has null samples; an empty text has one empty
segmentation; with fewer than k segmentations all are returned, with inclusion
1; a null key is a key of its own; rows with the same key and text get the same
samples; an empty table gives an empty table; whole texts are segmented.
"""

from __future__ import annotations

import math
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from . import chunks as C
from .arrow_schema import to_arrow
from .common import ship

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES = 8
SEED = 1
OFFSET = 10
REACH = 37.0
SPACE = "▁"
_LITERAL = "\udc81"               # stands for a SPACE character of the text itself
_SLICE = 2 << 20
_HEAD = 32                         # pieces
_FIELD = 1 << 17                   # pieces of all texts at a time
_PART = 6000                       # words
_RUN = 1 << 15                     # words
_WORDS = 40_000
_TEXTS = 64
_SLOT_BITS = 18
_BITS = 30
_UNIT = 1 << _BITS
_SMALL = 1e-280
_U = np.uint64
SAMPLE_TYPE = ArrayType(StructType([StructField("ids", ArrayType(IntegerType(), False)), StructField("logp", DoubleType()),
                                    StructField("log_inclusion", DoubleType())]))


def _at(x: np.ndarray, places: np.ndarray) -> np.ndarray:
    """``x[places]`` for places that are all there, without a check of each."""
    return x.take(places, mode="clip")


def _mix(h):
    h = h ^ (h >> _U(30))
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


# ---- vocabulary -----------------------------------------------------------------

class Vocabulary:
    """Pieces by id; prefixes by length, for lookups of many at once."""

    def __init__(self, pieces: list[str], normal: list[bool], first_byte: int):
        self.size, self.first_byte = len(pieces), first_byte
        ids = [i for i, ok in enumerate(normal) if ok]
        weight = np.full(len(pieces), -np.inf)
        rank = np.arange(len(ids)) + OFFSET
        weight[ids] = -np.log(rank) - np.log(np.sum(1.0 / rank))
        self.byte_weight = float(weight[ids[-1]])
        weight[first_byte:first_byte + 256] = self.byte_weight
        self.weight = weight
        prefixes: dict[str, int] = {}
        for i in ids:
            p = pieces[i]
            for n in range(1, len(p)):
                prefixes.setdefault(p[:n], -1)
            prefixes[p] = i
        self.longest = max(map(len, prefixes))
        h = np.array([self.hash_of(p) for p in prefixes], np.uint64)
        order = np.argsort(h)
        self.known, self.known_piece = h[order], np.array(list(prefixes.values()), np.int32)[order]
        self.slot = np.searchsorted(self.known, np.arange(1 << _SLOT_BITS, dtype=np.uint64) << _U(64 - _SLOT_BITS)).astype(np.int32)
        self.slot = np.append(self.slot, np.int32(len(h)))
        raw = [p.replace(SPACE, " ").encode() if ok else b"" for p, ok in zip(pieces, normal)]
        for b in range(256):
            raw[first_byte + b] = bytes([b])
        self.raw = pa.array(raw, pa.large_binary())

    @staticmethod
    def letters(code: np.ndarray) -> np.ndarray:
        return code.astype(np.uint64) * _U(0xC2B2AE3D27D4EB4F) + _U(1)

    @staticmethod
    def extend(h, letter):
        h = h ^ (h >> _U(31))
        h *= _U(0x9E3779B97F4A7C15)
        h += letter
        return h

    @classmethod
    def hash_of(cls, p: str) -> int:
        h = np.zeros(1, np.uint64)
        for x in cls.letters(np.array([ord(c) for c in p])):
            h = cls.extend(h, x)
        return int(h[0])

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash among the known ones, -1 if it is none."""
        top = (h >> _U(64 - _SLOT_BITS)).astype(np.int64)
        at, last = _at(self.slot, top), _at(self.slot, top + 1)
        out = np.full(len(h), -1, np.int32)
        todo = np.flatnonzero(at < last)
        at, h, last = _at(at, todo), _at(h, todo), _at(last, todo)
        while len(todo):
            same = _at(self.known, at) == h
            hit = np.flatnonzero(same)
            out[_at(todo, hit)] = _at(at, hit)
            at += np.int32(1)
            more = np.flatnonzero((at < last) & ~same)
            todo, at, h, last = (_at(x, more) for x in (todo, at, h, last))
        return out

    @classmethod
    def load(cls, path: str = MODEL) -> "Vocabulary":
        import sentencepiece
        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        normal = [not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i)) for i in range(n)]
        return cls([m.id_to_piece(i) for i in range(n)], normal, m.piece_to_id("<0x00>"))

    def byte_ids(self, code: int) -> list[int]:
        c = SPACE if chr(code) == _LITERAL else chr(code)
        return [self.first_byte + b for b in c.encode("utf-8")]


def decode_many(vocab: Vocabulary, ids: np.ndarray, off: np.ndarray) -> list[bytes]:
    """Bytes of many id lists (joined, with offsets); the space put before a
    text is taken off again."""
    joined = vocab.raw.take(pa.array(ids))
    at = np.frombuffer(joined.buffers()[1], np.int64)[off].tolist() if len(ids) else [0] * len(off)
    raw = memoryview(joined.buffers()[2] or b"")
    return [raw[a + (b > a):b].tobytes() for a, b in zip(at[:-1], at[1:])]


def decode(vocab: Vocabulary, ids: list[int]) -> str:
    return decode_many(vocab, np.asarray(ids, np.int32), np.array([0, len(ids)]))[0].decode()


# ---- lattice of distinct words ---------------------------------------------------

class Lattice:
    """Arcs of all distinct words.  A node is a character; its arcs are pieces
    that start there.  ``below`` holds the cumulated conditional probability of
    the node's arcs before each, in ``_UNIT`` rounded up, so that a whole number
    of ``_BITS`` random bits draws an arc."""

    def __init__(self, vocab: Vocabulary, code: np.ndarray, size: np.ndarray):
        """``code``: characters of all words, joined; ``size``: of each word."""
        self.vocab = vocab
        at = offsets(size)
        cut = [*range(0, len(size), _PART), len(size)]                                    # arrays that fit a cache
        parts = [self._part(code[at[i]:at[j]], size[i:j]) for i, j in zip(cut[:-1], cut[1:])]
        ends = [(len(p[3]), len(p[1])) for p in parts]
        columns = [list(x) for x in zip(*parts)]
        del parts
        size, degree, self.piece, to, self.logp, self.below = (in_one(x) for x in columns)
        C.give_back()
        self.root = np.cumsum(size) - size
        self.first = np.zeros(len(degree) + 1, np.int32)
        np.cumsum(degree, out=self.first[1:])
        self.node = np.repeat(np.arange(len(degree), dtype=np.int32), degree)
        begin, n0 = 0, 0
        for arcs, nodes in ends:
            end = begin + arcs
            to[begin:end] += (to[begin:end] >= 0) * np.int32(n0)
            begin, n0 = end, n0 + nodes
        self.to = to
        self.last = self.first[1:] - np.int32(1)

    def _part(self, code: np.ndarray, size: np.ndarray):
        """Sizes of words; by node the number of arcs; by arc its piece, next
        node (-1: the word's end), conditional ln probability and ``below``."""
        vocab = self.vocab
        n = len(code)
        end_of = np.repeat(np.cumsum(size), size).astype(np.int32)
        at, h, letter = np.arange(n, dtype=np.int32), np.zeros(n, np.uint64), vocab.letters(code)
        degree = np.zeros(n, np.int32)
        starts, pieces, nth, lengths = [], [], [], []
        for length in range(1, vocab.longest + 1):
            if length > 1:
                inside = np.flatnonzero(at + np.int32(length) <= _at(end_of, at))
                at, h = _at(at, inside), _at(h, inside)
            h = vocab.extend(h, _at(letter, at + np.int32(length - 1)))
            j = vocab.find(h)
            hit = np.flatnonzero(j >= 0)
            at, h = _at(at, hit), _at(h, hit)
            if not len(at):
                break
            p = _at(vocab.known_piece, _at(j, hit))
            whole = np.flatnonzero(p >= 0)
            starts.append(_at(at, whole))
            pieces.append(_at(p, whole))
            lengths.append(length)
            if length == 1:                       # characters outside the vocabulary
                lone = np.ones(n, bool)
                lone[starts[0]] = False
                lone = np.flatnonzero(lone).astype(np.int32)
                starts[0], pieces[0] = np.concatenate([starts[0], lone]), np.concatenate([pieces[0], self._spelled(code[lone])])
            nth.append(_at(degree, starts[-1]))
            degree[starts[-1]] = nth[-1] + 1
        if not starts:
            starts, pieces, lengths, nth = [at_all := np.arange(n, dtype=np.int32)], [self._spelled(code)], [1], [degree * 0]
            degree[at_all] = 1
        first = np.zeros(n + 1, np.int64)
        np.cumsum(degree, out=first[1:])
        arcs = int(first[-1])
        piece = np.empty(arcs, np.int32)
        to = np.empty(arcs, np.int32)
        for st, pc, ln, r in zip(starts, pieces, lengths, nth):        # by node, shorter pieces first
            place = _at(first, st) + r
            piece[place] = pc
            to[place] = st + np.int32(ln)
        del starts, pieces, nth, at, h, letter
        to[to == np.repeat(end_of, degree)] = n
        spelled = np.flatnonzero(piece < 0)
        logp = np.take(vocab.weight, piece, mode="clip")
        logp[spelled] = vocab.byte_weight * self._bytes_of(piece[spelled])
        beta, p = self._sums(to, np.exp(logp), first, end_of, n)
        if beta is None:                              # too small for a double
            beta = self._beta(to, logp, first, end_of, n)
        logp += _at(beta, to)
        logp -= np.repeat(beta[:n], degree)
        if p is None:
            p = np.exp(logp)
        to[to == n] = -1
        before = np.cumsum(p)
        before -= p
        before -= np.repeat(before[first[:-1]], degree)
        before *= _UNIT
        return size, degree, piece, to, logp, np.ceil(before, out=before).astype(np.int32)

    def _spelled(self, code: np.ndarray) -> np.ndarray:
        """A single byte is an id like any other; others are -1 - character."""
        return np.where(code < 0x80, self.vocab.first_byte + code.astype(np.int64), -1 - code.astype(np.int64)).astype(np.int32)

    @staticmethod
    def _bytes_of(piece: np.ndarray) -> np.ndarray:
        c = -1 - piece
        return np.where(piece >= 0, 1, np.where(c < 0x800, 2, np.where(c < 0x10000, 3, 4)))

    @staticmethod
    def _from_ends(to, weight, first, end_of, n):
        """Nodes in an order that starts at the words' ends, their arcs in it
        (next node and weight), and for all nodes that are one character from
        an end, then two, ... where they, their arcs and each one's arcs begin."""
        left = end_of - np.arange(n, dtype=np.int32)
        order = np.argsort(left.astype(np.int16) if n and left.max() < 1 << 15 else left, kind="stable")
        degree = _at(np.diff(first), order)
        begin = np.cumsum(degree) - degree
        arc = np.arange(len(to)) + np.repeat(_at(first, order) - begin, degree)
        cut = np.r_[np.flatnonzero(np.diff(left[order], prepend=-1)), n] if n else np.zeros(1, int)
        begin = np.append(begin, len(to))
        return order, degree, _at(to, arc), _at(weight, arc), arc, [(lo, hi, begin[lo], begin[hi], begin[lo:hi] - begin[lo])
                                                          for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist())]

    @classmethod
    def _sums(cls, to, weight, first, end_of, n):
        """ln of the summed weight of all ways from a node to its word's end,
        and each arc's share of it, from plain sums; None if they are too small."""
        sums = np.ones(n + 1)
        order, degree, t, w, arc, cuts = cls._from_ends(to, weight, first, end_of, n)
        for lo, hi, a, b, start in cuts:
            v = w[a:b]
            v *= _at(sums, t[a:b])
            sums[order[lo:hi]] = np.add.reduceat(v, start)
        if sums.min() < _SMALL:
            return None, None
        w /= np.repeat(_at(sums, order), degree)
        p = np.empty(len(w))
        p[arc] = w
        return np.log(sums), p

    @classmethod
    def _beta(cls, to, weight, first, end_of, n):
        """ln of the summed weight of all ways from a node to its word's end."""
        beta = np.zeros(n + 1)
        order, degree, t, w, _, cuts = cls._from_ends(to, weight, first, end_of, n)
        for lo, hi, a, b, start in cuts:
            v = w[a:b] + _at(beta, t[a:b])
            top = np.maximum.reduceat(v, start)
            v -= np.repeat(top, degree[lo:hi])
            beta[order[lo:hi]] = top + np.log(np.add.reduceat(np.exp(v, out=v), start))
        return beta

    def walks(self, node: np.ndarray, key: np.ndarray, samples: range) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each sample a random way from each node to its word's end: arcs
        of all, joined, and how many each has.  ``key``: noise of each node."""
        shift = np.array([(i + 1) * 0xD6E8FEB86659FD93 & (2**64 - 1) for i in samples], np.uint64)[:, None]
        parts: list[list] = [[] for _ in samples]
        run = max(1, _RUN // len(samples))                 # arrays that fit a cache, near nodes together
        for lo in range(0, len(node), run):
            some = node[lo:lo + run]
            arcs, count = self._walk(np.tile(some, len(samples)), (key[lo:lo + run] + shift).ravel())
            at = offsets(count)[::len(some)]
            for part, x, n in zip(parts, split(arcs, at), count.reshape(len(samples), -1)):
                part.append((x.copy(), n))
        return [tuple(np.concatenate(x) for x in zip(*part)) for part in parts]

    def _walk(self, node: np.ndarray, noise: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count, steps, step = np.zeros(len(node), np.int32), [], 0
        live = np.flatnonzero(node >= 0)
        here = _at(node, live)
        noise = _mix(_at(noise, live))
        while len(live):
            if step % 2 == 0:              # one hash has the bits of two steps
                bits = _mix(noise + _U((step * 0x9E3779B97F4A7C15) & (2**64 - 1)))
                u = (bits >> _U(64 - _BITS)).astype(np.int32)
            else:
                u = bits.astype(np.int32)
                u &= np.int32(_UNIT - 1)
            arc = _at(self.last, here)             # long pieces, mostly the likely ones, come last
            over = np.flatnonzero(_at(self.below, arc) > u)
            while len(over):
                lower = _at(arc, over)
                lower -= np.int32(1)
                arc[over] = lower
                over = _at(over, np.flatnonzero(_at(self.below, lower) > _at(u, over)))
            steps.append((live, arc))
            step += 1
            here = _at(self.to, arc)
            count[live] = step
            on = np.flatnonzero(here >= 0)
            live, here, noise = _at(live, on), _at(here, on), _at(noise, on)
            if step % 2:
                bits = _at(bits, on)
        at = np.cumsum(count)
        arcs = np.empty(int(at[-1]), np.int32)
        at -= count
        for step, (live, arc) in enumerate(steps):
            arcs[_at(at, live) + step] = arc
        return arcs, count

    def ids(self, arcs: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of arcs, and how many each list of ``count`` arcs has."""
        p = _at(self.piece, arcs)
        odd = np.flatnonzero(p < 0)
        if not len(odd):
            return p, count
        spelled = [self.vocab.byte_ids(-1 - int(p[i])) for i in odd]
        size = np.ones(len(p), np.int64)
        size[odd] = [len(x) for x in spelled]
        out = np.repeat(p, size)
        at = np.cumsum(size) - size
        for i, x in zip(odd.tolist(), spelled):
            out[at[i]:at[i] + len(x)] = x
        edge = np.r_[0, np.cumsum(count)]
        total = np.r_[0, np.cumsum(size)]
        return out, np.diff(total[edge])


# ---- perturbed A* -----------------------------------------------------------------

def _uniform(key: int) -> float:
    """In (0, 1), of 53 bits."""
    k = key & (2**64 - 1)
    k = ((k ^ (k >> 30)) * 0xBF58476D1CE4E5B9) & (2**64 - 1)
    k = ((k ^ (k >> 27)) * 0x94D049BB133111EB) & (2**64 - 1)
    k ^= k >> 31
    return ((k >> 11) + 0.5) * 2.0 ** -53


def truncated_gumbel(location, limit, u):
    """Gumbel noise at ``location``, given that it is below ``limit``."""
    x = np.exp(np.minimum(location - limit, 700.0)) - np.log(u)
    return location - np.log(x)


def siblings(lat: "Lattice", arcs: np.ndarray, first: np.ndarray, phi: np.ndarray, limit: np.ndarray, noise: np.ndarray,
             floor: np.ndarray):
    """For paths (rows of arcs, padded with -1) that start at piece ``first``
    with ln probability ``phi``: row, column and Gumbel value of each piece's
    siblings taken together, where that may reach the row's ``floor``, ln
    probability before each such piece, and after the row."""
    real = arcs >= 0
    lp = _at(lat.logp, arcs)
    lp *= real
    sums = np.cumsum(lp, axis=1)
    ahead = sums - lp
    ahead += phi[:, None]
    bits = _mix((noise[:, None] + (first[:, None] + np.arange(arcs.shape[1])).astype(np.uint64) * _U(0x9E3779B97F4A7C15)) ^ _U(0xA5A5A5A5))
    bits >>= _U(11)
    # a value reaches the floor only if -ln u, which is 1 - u at least, is at most exp(location - floor)
    room = np.exp(np.minimum(ahead - floor[:, None], 1.0))
    room *= 2.0 ** 53 * (1 + 1e-9)
    r, c = np.nonzero(real & ((_U(2**53 - 1) - bits) <= room))
    a, lp, ahead = arcs[r, c], lp[r, c], ahead[r, c]
    rest = -np.expm1(np.minimum(lp, 0.0))
    node = lat.node[a]
    some = np.flatnonzero((lat.first[node + 1] - lat.first[node] > 1) & (rest > 1e-12))
    r, c, ahead = r[some], c[some], ahead[some]
    u = (bits[r, c].astype(np.float64) + 0.5) * 2.0 ** -53
    return r, c, truncated_gumbel(ahead + np.log(rest[some]), limit[r], u), ahead, phi + sums[:, -1]


class NewPath:
    """A path just found: its siblings count from piece ``skip`` on, where the
    arcs ``used`` are used up already; ``before``: ln P of what precedes."""

    def __init__(self, path, arcs, skip, before, value, used):
        self.path, self.arcs, self.skip, self.before, self.value, self.used = path, arcs, skip, before, value, used

    def noise(self, key: int) -> int:
        return (key + 0x51ED27 * (self.path + 1)) & (2**64 - 1)


def add_all(lat: "Lattice", found: list[tuple["Search", NewPath]]) -> None:
    """Queue the siblings along new paths of all texts at once, ``_HEAD`` pieces
    first, then more at a time, until nothing further down can come among those
    needed."""
    if not found:
        return
    need = np.array([s.need() for s, _ in found])
    floor = np.array([s.floor() for s, _ in found])          # what falls below is never popped
    value = np.array([p.value for _, p in found])
    keys = [p.noise(s.key) for s, p in found]
    noise = np.array(keys, np.uint64)
    phi = np.array([p.before for _, p in found])
    lo = np.array([p.skip for _, p in found])
    end = np.array([len(p.arcs) for _, p in found])
    entries: list[list] = [[] for _ in found]
    for d, (_, p) in enumerate(found):
        if p.used:                       # at the piece where it left its parent
            g, arc = left_over(lat, p, keys[d]), int(p.arcs[p.skip])
            if g > -math.inf:
                entries[d].append((-g, p.path, p.skip, p.before, (*p.used, arc)))
            phi[d] += lat.logp[arc]
            lo[d] += 1
    rows, width = np.flatnonzero(lo < end), max(_HEAD, 2 * int(need.max()))
    while len(rows):
        arcs = np.full((len(rows), width), -1, np.int32)
        for row, d, i in zip(arcs, rows.tolist(), lo[rows].tolist()):
            piece = found[d][1].arcs[i:i + width]
            row[:len(piece)] = piece
        r, c, g, ahead, phi[rows] = siblings(lat, arcs, lo[rows], phi[rows], value[rows], noise[rows], floor[rows])
        ranked = np.full(arcs.shape, -np.inf)
        ranked[r, c] = g
        ranked.sort(axis=1)
        floor[rows] = np.maximum(floor[rows], ranked[np.arange(len(rows)), width - need[rows]])
        good = np.flatnonzero(g >= floor[rows][r])
        r, c = r[good], c[good]
        at = rows[r]
        for d, i, x, before, arc in zip(at.tolist(), (c + lo[at]).tolist(), g[good].tolist(), ahead[good].tolist(), arcs[r, c].tolist()):
            entries[d].append((-x, found[d][1].path, i, before, (arc,)))
        lo[rows] += width
        rows = rows[(lo[rows] < end[rows]) & (phi[rows] + REACH >= floor[rows])]
        width = max(width, min(2 * width, _FIELD // max(len(rows), 1)))
    for (s, _), more in zip(found, entries):
        s.add(more)


def left_over(lat: "Lattice", p: NewPath, noise: int) -> float:
    """The Gumbel value of the siblings still unused where a path left its parent."""
    arc = int(p.arcs[p.skip])
    node = lat.node[arc]
    if lat.first[node + 1] - lat.first[node] - len(p.used) - 1 <= 0:
        return -math.inf
    rest = 1.0 - sum(math.exp(lat.logp[a]) for a in (*p.used, arc))
    if rest <= 1e-12:
        return -math.inf
    u = _uniform((noise + p.skip * 0x9E3779B97F4A7C15) ^ 0xA5A5A5A5)
    location = p.before + math.log(rest)
    return location - math.log(math.exp(min(location - p.value, 700.0)) - math.log(u))


class Search:
    """The queue of one text, no longer than what can still be popped."""

    def __init__(self, lattice: Lattice, k: int, key: int):
        self.l, self.k, self.key = lattice, k, key
        self.queue: list = []                          # best first
        self.found: list[tuple[float, float]] = []     # (perturbed value, ln P)

    def need(self) -> int:
        """Entries that may still matter: those to pop and the one that sets the limit."""
        return self.k + 1 - len(self.found)

    def floor(self) -> float:
        need = self.need()
        return -self.queue[need - 1][0] if len(self.queue) >= need else -math.inf

    def add(self, entries: list) -> None:
        self.queue = sorted(self.queue + entries)[:self.need()]

    def pop(self):
        """(value, parent path, place, ln P before it, new arc, used arcs)"""
        if not self.queue:
            return None
        g, path, place, before, used = self.queue.pop(0)
        lat = self.l
        node = lat.node[used[0]]
        lo, hi = int(lat.first[node]), int(lat.first[node + 1])
        arcs, sums, total = [], [], 0.0
        for a, x in zip(range(lo, hi), lat.logp[lo:hi].tolist()):
            if a not in used:
                total += math.exp(x)
                arcs.append(a)
                sums.append(total)
        u = _uniform(self.key + 0x7F4A7C15 * (place + 1) + 0xC2B2AE3D27D4EB4F * (len(self.found) + 1))
        return -g, path, place, before, arcs[min(bisect_right(sums, u * total), len(arcs) - 1)], used


def offsets(sizes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=out[1:])
    return out


def in_one(parts: list[np.ndarray]) -> np.ndarray:
    """All parts as one array; the list is emptied, so that these do not stay
    beside it."""
    out = np.concatenate(parts)
    parts.clear()
    return out


def split(x: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    at = at.tolist()
    return [x[a:b] for a, b in zip(at[:-1], at[1:])]


def sizes_of(parts: list[np.ndarray]) -> np.ndarray:
    return np.fromiter(map(len, parts), np.int64, len(parts))


def distinct_words(texts: list[str | None]):
    """The distinct words of all texts (their characters joined, as the model
    sees them, and the length of each), the number of each word in turn, and how
    many words each text has.  A space is put before each text; a word is a run
    of spaces with what follows it, as no piece has a space after another
    character."""
    parts = [(" " + t).encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    data = b"".join(parts)
    at = offsets(np.array([len(x) for x in parts], np.int64))
    space = np.frombuffer(data, np.uint8) == 32
    begins = space.copy()
    begins[1:] &= ~space[:-1]
    begins[at[:-1][np.diff(at) > 0]] = True
    begins = np.flatnonzero(begins)
    counts = np.diff(np.searchsorted(begins, at))
    edges = np.append(begins, len(data)).astype(np.int32)
    found = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(edges), pa.py_buffer(data)]).dictionary_encode()
    _, edges, joined = found.dictionary.buffers()
    edges = np.frombuffer(edges, np.int32)[:len(found.dictionary) + 1]
    joined = (joined.to_pybytes() if joined else b"")[:int(edges[-1]) if len(edges) else 0]
    whole = offsets((np.frombuffer(joined, np.uint8) & 0xC0) != 0x80)          # characters before each byte
    code = np.frombuffer(joined.decode("utf-8", "surrogatepass").replace(SPACE, _LITERAL).replace(" ", SPACE)
                         .encode("utf-32-le", "surrogatepass"), np.uint32)
    return code, np.diff(whole[edges]), found.indices.to_numpy(), counts


def segment(vocab: Vocabulary, texts: list[str | None], keys: list[int], k: int):
    """For each text a list of (ids, ln P, ln inclusion), best first."""
    out = []
    for lo, hi, ids, at, scores, drawn in draws(vocab, texts, keys, k):
        rows = list(zip(split(ids, at), *scores))
        out += [None if t is None else rows[b - n:b] for t, n, b in zip(texts[lo:hi], drawn, np.cumsum(drawn).tolist())]
    return out


def draws(vocab: Vocabulary, texts: list[str | None], keys: list[int], k: int):
    """For one run of texts after the other, which share a lattice: its first and
    last text (exclusive) and what ``draw`` returns."""
    letters, lengths, code, sizes = distinct_words(texts)
    lat = Lattice(vocab, letters, lengths) if len(code) else None
    del letters, lengths
    at = offsets(sizes)
    cuts = [0, *(np.flatnonzero(np.diff(at[:-1] // _WORDS)) + 1).tolist(), len(texts)]
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        yield lo, hi, *draw(lat, code[at[lo]:at[hi]], sizes[lo:hi], [t is not None for t in texts[lo:hi]], keys[lo:hi], k)


def draw(lat: Lattice, code: np.ndarray, sizes: np.ndarray, there: list[bool], keys: list[int], k: int):
    """The ids of all texts' samples, joined, best first; where each sample's
    begin; ln P and ln inclusion of each; how many samples each text has.
    ``code``: the numbers of all words; ``sizes``: how many a text has."""
    if not len(code):
        drawn = [*map(int, there)]
        return np.zeros(0, np.int32), np.zeros(sum(drawn) + 1, np.int64), ([0.0] * sum(drawn),) * 2, drawn
    root = _at(lat.root.astype(np.int32), code)
    edge = offsets(sizes)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    noise = _at(np.array([k_ & (2**64 - 1) for k_ in keys], np.uint64), doc)
    noise += (np.arange(len(code)) - _at(edge, doc)).astype(np.uint64) * _U(0xA0761D6478BD642F)
    del code, doc

    def log_probabilities(paths: list[np.ndarray]) -> list[float]:
        return [float(x.sum()) for x in split(_at(lat.logp, np.concatenate(paths)), offsets(sizes_of(paths)))] if paths else []

    walked = lat.walks(root, noise, range(k))             # from all words' beginnings
    arcs, count = walked[0]
    paths = [[x] for x in split(arcs, offsets(count)[edge])]
    some = [d for d, (a,) in enumerate(paths) if len(a)]
    searches: list[Search | None] = [None] * len(paths)
    new: list[tuple[Search, NewPath]] = []
    for d, total in zip(some, log_probabilities([paths[d][0] for d in some])):
        s = searches[d] = Search(lat, k, int(keys[d]))
        value = -math.log(-math.log(_uniform(int(keys[d]) ^ 0x5DEECE66D)))
        s.found.append((value, total))
        new.append((s, NewPath(0, paths[d][0], 0, 0.0, value, ())))
    add_all(lat, new)
    ends = lat.to < 0
    for i in range(1, k):
        some = [d for d in some if searches[d].queue]
        if not some:
            break
        popped = [searches[d].pop() for d in some]
        before = [paths[d][got[1]][:got[2]] for d, got in zip(some, popped)]
        left = np.cumsum(np.append(0, ends[np.concatenate(before)]))[offsets(sizes_of(before))]
        word = edge[some] + np.diff(left)                 # the one it leaves in
        arc = np.array([got[4] for got in popped], np.int32)
        (rest, count), = lat.walks(lat.to[arc], noise[word], range(i, i + 1))
        rest = split(rest, offsets(count))
        arcs, at = walked[i][0], offsets(walked[i][1])
        walked[i], new = None, []
        found = [np.concatenate([x, arc[j:j + 1], rest[j], arcs[a:b]])
                 for j, (x, a, b) in enumerate(zip(before, at[word + 1].tolist(), at[edge[1:][some]].tolist()))]
        for d, (value, _, place, ln, _, used), path, total in zip(some, popped, found, log_probabilities(found)):
            paths[d].append(path)
            searches[d].found.append((value, total))
            new.append((searches[d], NewPath(len(paths[d]) - 1, path, place, ln, value, used)))
        add_all(lat, new)
    paths = [ps if is_there else [] for is_there, ps in zip(there, paths)]
    drawn = [*map(len, paths)]
    del noise, root, new, walked, arcs, count, ends
    parts = []
    for lo in range(0, len(paths), _TEXTS):
        some = [p for ps in paths[lo:lo + _TEXTS] for p in ps]
        paths[lo:lo + _TEXTS] = [[]] * len(paths[lo:lo + _TEXTS])
        if some:
            parts.append(lat.ids(np.concatenate(some), sizes_of(some)))
    del some
    ids, n = (np.concatenate(x) for x in zip(*parts))
    del parts
    logp, inclusion = [], []
    for s, n_drawn in zip(searches, drawn):
        limit = -s.queue[0][0] if s and s.queue and len(s.found) >= k else -math.inf
        for i in range(n_drawn):
            total = s.found[i][1] if s else 0.0
            x = total - limit
            logp.append(total)
            inclusion.append(0.0 if x > 30 else (x if x < -30 else math.log(-math.expm1(-math.exp(x)))))
    return ids, offsets(n), (logp, inclusion), drawn


# ---- the operator --------------------------------------------------------------------

def row_key(value, seed: int) -> int:
    return xxhash.xxh64_intdigest(b"\0null" if value is None else str(value).encode(), seed & 0xFFFFFFFF)


def sample_segmentations(df: DataFrame, text: str = "text", key: str = "doc_id", k: int = SAMPLES, seed: int = SEED,
                         model: str = MODEL, check: bool = True) -> DataFrame:
    """``df`` with ``samples``, an array of (ids, logp, log_inclusion), and
    ``exact``: every sample decodes to the text (null for a null text).
    Columns of these names are replaced."""
    spark = df.sparkSession
    ship(spark)
    df = df.drop("samples", "exact")
    schema = StructType([*df.schema.fields, StructField("samples", SAMPLE_TYPE), *StructType.fromDDL("exact boolean").fields])
    target = to_arrow(spark, schema)
    held = spark.sparkContext.broadcast(Vocabulary.load(model))      # one vocabulary
    inner = target.field("samples").type.value_type

    def run(batches):
        vocab = held.value
        for b in batches:
            raw, off = C.texts_of(b, text)
            cuts = [0, *(np.flatnonzero(np.diff(off[:-1] // _SLICE)) + 1).tolist(), b.num_rows] if b.num_rows else [0]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                part = b.slice(lo, hi - lo)
                keys = [row_key(v, seed) for v in part.column(key).to_pylist()]
                for first, last, ids, edge, scores, drawn in draws(vocab, part.column(text).to_pylist(), keys, k):
                    starts = offsets(np.array(drawn))
                    exact = [None] * len(drawn)
                    for d in np.flatnonzero(drawn).tolist() if check else ():
                        own = raw[off[lo + first + d]:off[lo + first + d + 1]].tobytes()
                        at = edge[starts[d]:starts[d + 1] + 1]
                        exact[d] = all(x == own for x in decode_many(vocab, ids[at[0]:at[-1]], at - at[0]))
                    lists = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(ids, pa.int32())).cast(inner.field("ids").type)
                    items = pa.StructArray.from_arrays([lists, *(pa.array(x, pa.float64()) for x in scores)], fields=list(inner))
                    starts = pa.array(starts, pa.int32(), mask=np.array([*[n == 0 for n in drawn], False]))
                    samples = pa.ListArray.from_arrays(starts, items).cast(target.field("samples").type)
                    rows = part.slice(first, last - first)
                    yield pa.RecordBatch.from_arrays([*rows.columns, samples, pa.array(exact, pa.bool_())], schema=target)
                    del ids, lists, items, samples
                C.give_back()

    return df.mapInArrow(run, schema)
