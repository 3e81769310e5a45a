"""Repair of conversations: the cheapest edits that make the turns legal.

A conversation is legal if its role initials read ``(s?(ua)+)?``: nothing, or
pairs of user and assistant, at most one system turn before them.  Edits: Keep
(free), Rerole to user or assistant (2), Delete (3; blank and duplicate rows
must go), Insert an empty user or assistant turn anywhere (2); a truncated row
that stays adds 1.  Of all edits of least cost those whose initials, in order,
are the ASCII-least string (the audit) are taken.

1. ``marked`` numbers the rows of a conversation by turn (nulls first; equal
   turns by role, then text) and marks faults, all by window functions.
2. A conversation is cut into segments of ``SEGMENT`` rows.  ``cheapest`` finds
   the best (cost, audit) from each state of the grammar at the segment's start
   to each state at its end, depth first: an explicit stack, a lower bound of
   what the rest must cost (the cheapest rest when audits are left out), the
   incumbent, and a table of the best (cost, audit) with which each node was
   reached; a prefix that is no better than one of these is dropped.  Two
   prefixes of equal cost at one node differ at some letter (edits between them
   would be inserts, which cost), so the better prefix stays better.
3. The segments of a conversation are chained in order, four states at a time.
4. ``repaired`` applies the audit to the rows as a sorted stream: it holds the
   audit of one conversation (a byte per edit) and one batch of rows, so a
   conversation of any length passes through.

Defined results: a null role or text is one space; a null conv_id is one
conversation, a null turn the lowest turn; equal rows are duplicates of the
first; an empty text is blank; roles count by their first character only; an
empty table gives empty tables; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, ship, stored

SEGMENT = 256
KEEP_SYSTEM, START, USER, ASSISTANT = 1, 0, 2, 3      # states: what stands last
RENAME, DELETE, INSERT, CUT = 2, 3, 2, 1               # costs: fixed values
FINE, TRUNCATED, GONE = 0, 1, 2                        # what a row's fault allows
_NEXT = (USER, USER, ASSISTANT, USER)                  # state after an inserted or renamed turn
_NEEDS = ("user", "user", "assistant", "user")         # and that turn's role
_KEEPS = ({"s": KEEP_SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
_END = {START: (0, ""), ASSISTANT: (0, ""), USER: (INSERT, "I"), KEEP_SYSTEM: (2 * INSERT, "II")}
_NEVER = 1 << 60


# ---- search ---------------------------------------------------------------------

def edits(row: tuple[str, int], state: int) -> list[tuple[str, int, int]]:
    """(initial, cost, next state) of what can be done to a row itself."""
    initial, fault = row
    out = [("D", DELETE, state)]
    if fault != GONE:
        if initial in _KEEPS[state]:
            out.append(("K", CUT * fault, _KEEPS[state][initial]))
        out.append(("R", RENAME + CUT * fault, _NEXT[state]))
    return out


def suffix_bounds(rows: list[tuple[str, int]], goal: int) -> list[list[int]]:
    """Least cost from each (row, state) to ``goal`` after the last row."""
    out = [[_NEVER] * 4 for _ in range(len(rows) + 1)]
    out[-1][goal] = 0
    for i in range(len(rows) - 1, -1, -1):
        own = [min(cost + out[i + 1][after] for _, cost, after in edits(rows[i], s)) for s in range(4)]
        turns = min(own[USER], INSERT + own[ASSISTANT])
        out[i] = [min(own[START], INSERT + turns), min(own[KEEP_SYSTEM], INSERT + turns), turns,
                  min(own[ASSISTANT], INSERT + own[USER])]
    return out


def cheapest(rows: list[tuple[str, int]], start: int, goal: int) -> tuple[int, str] | None:
    """Least (cost, audit) from ``start`` before the rows to ``goal`` right
    after the last of them; None if there is none."""
    bound = suffix_bounds(rows, goal)
    best: tuple[int, str] | None = None
    reached: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, start, 0, "")]
    while stack:
        i, state, cost, audit = stack.pop()
        least = cost + bound[i][state]
        if least >= _NEVER or best is not None and (least, audit) > (best[0], best[1][:len(audit)]):
            continue
        known = reached.get((i, state))
        if known is not None and known <= (cost, audit):
            continue
        reached[i, state] = (cost, audit)
        if i == len(rows):
            if best is None or (cost, audit) < best:
                best = (cost, audit)
            continue
        nodes = [(i + 1, after, cost + c, audit + letter) for letter, c, after in edits(rows[i], state)]
        nodes.append((i, _NEXT[state], cost + INSERT, audit + "I"))
        nodes.sort(key=lambda n: (n[2] + bound[n[0]][n[1]], n[3]), reverse=True)     # the most promising is popped first
        stack.extend(nodes)
    return best


def chain(before: dict[int, tuple[int, str]], pieces: list[tuple[int, int, int, str]]) -> dict[int, tuple[int, str]]:
    """Best (cost, audit) per state after one more segment, whose (start,
    goal, cost, audit) are ``pieces``."""
    after: dict[int, tuple[int, str]] = {}
    for start, goal, cost, audit in pieces:
        if start in before:
            new = (before[start][0] + cost, before[start][1] + audit)
            if goal not in after or new < after[goal]:
                after[goal] = new
    return after


def finish(states: dict[int, tuple[int, str]]) -> tuple[int, str]:
    return min((cost + _END[s][0], audit + _END[s][1]) for s, (cost, audit) in states.items())


# ---- streams of rows in order -------------------------------------------------------

def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Consecutive rows whose first ``keys`` columns are equal; a run is held
    whole, so it must be bounded."""
    key, held = None, []
    for b in batches:
        for row in zip(*[c.to_pylist() for c in b.columns]):
            if row[:keys] != key or not held:
                if held:
                    yield key, held
                key, held = row[:keys], []
            held.append(row)
    if held:
        yield key, held


def table_of(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


_PIECES = pa.schema([("conv_id", pa.int64()), ("seg", pa.int64()), ("start", pa.int32()), ("goal", pa.int32()),
                     ("cost", pa.int64()), ("audit", pa.string())])
_AUDITS = pa.schema([("conv_id", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())])
_ROWS = pa.schema([("conv_id", pa.int64()), ("n", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()),
                   ("role", pa.string()), ("text", pa.string())])
_HASHES = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])
_STEP = 4096


def flushed(schema: pa.Schema, rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held = []
    for r in rows:
        held.append(r)
        if len(held) == _STEP:
            yield table_of(schema, held)
            held = []
    if held:
        yield table_of(schema, held)


def solve(batches):
    """Rows (conv_id, seg, pos, initial, fault) in that order to pieces."""

    def pieces():
        for (conv, seg), rows in runs(batches, 2):
            light = [r[3:] for r in rows]
            for start in range(4) if seg else (START,):
                for goal in range(4):
                    found = cheapest(light, start, goal)
                    if found is not None:
                        yield conv, seg, start, goal, *found

    return flushed(_PIECES, pieces())


def join_pieces(batches):
    """Pieces (conv_id, seg, start, goal, cost, audit) in that order to audits."""

    def audits():
        last, states, open_ = None, {}, False
        for (conv, seg), pieces in runs(batches, 2):
            if not open_ or conv != last:
                if open_:
                    yield last, *finish(states)
                last, states, open_ = conv, {START: (0, "")}, True
            states = chain(states, [p[2:] for p in pieces])
        if open_:
            yield last, *finish(states)

    return flushed(_AUDITS, audits())


def apply(batches):
    """Rows (conv_id, pos, turn, role, text, audit) in order, each
    conversation's audit before its rows (pos 0), to repaired rows."""

    def repaired():
        conv, audit, at, state, n = None, "", 0, START, 0

        def inserts(stop):
            nonlocal at, state, n
            while at < len(audit) and audit[at] == "I" and at < stop:
                n += 1
                yield conv, n, "I", None, _NEEDS[state], ""
                state = _NEXT[state]
                at += 1

        for b in batches:
            for c, pos, turn, role, text, new in zip(*[x.to_pylist() for x in b.columns]):
                if pos == 0:
                    yield from inserts(len(audit))
                    conv, audit, at, state, n = c, new, 0, START, 0
                    continue
                yield from inserts(len(audit))
                edit = audit[at]
                at += 1
                if edit == "D":
                    continue
                if edit == "R":
                    role, state = _NEEDS[state], _NEXT[state]
                else:
                    state = _KEEPS[state][role[:1]]
                n += 1
                yield conv, n, edit, turn, role, text
        yield from inserts(len(audit))

    return flushed(_ROWS, repaired())


def hashed(batches):
    """SHA-256 of ``role:text`` lines of each conversation, rows in order."""

    def hashes():
        conv, digest = None, None
        for b in batches:
            for c, role, text in zip(*[b.column(x).to_pylist() for x in ("conv_id", "role", "text")]):
                line = f"{role}:{text}".encode()
                if digest is None or c != conv:
                    if digest is not None:
                        yield conv, digest.hexdigest()
                    conv, digest = c, hashlib.sha256(line)
                else:
                    digest.update(b"\n" + line)
        if digest is not None:
            yield conv, digest.hexdigest()

    return flushed(_HASHES, hashes())


# ---- Spark ------------------------------------------------------------------------

def filled(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(" "))


def damaged(df: DataFrame) -> DataFrame:
    """Faults planted by crc32(``conv_id:turn``) % 20 (a null there is one
    space): 0 drops the row, 1 empties its text, 2 removes ``.!?`` from it, 3
    repeats the row, 4 makes the role user."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    fate = F.crc32(F.encode(key, "utf-8")) % 20
    return (df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                      filled("role").alias("role"), filled("text").alias("text"), fate.alias("fate")).where("fate <> 0")
            .select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"),
                    F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", ""))
                    .otherwise(F.col("text")).alias("text"),
                    F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("again"))
            .drop("again"))


def marked(df: DataFrame) -> DataFrame:
    """Stored rows ``conv_id, pos, turn, role, text, initial, fault, blank,
    duplicate, truncated, illegal, new_turn``; pos counts from 1."""
    turn = F.col("turn").asc_nulls_first()
    same = Window.partitionBy("conv_id", "role", "text").orderBy(turn)
    order = Window.partitionBy("conv_id").orderBy(turn, "role", "text", "again")
    body = F.rtrim("text", F.lit(BLANKS))
    blank, again = F.length(F.ltrim(body, F.lit(BLANKS))) == 0, F.col("again") > 1
    rows = (df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                      filled("role").alias("role"), filled("text").alias("text"))
            .repartition("conv_id").withColumn("again", F.row_number().over(same))
            .withColumn("pos", F.row_number().over(order).cast("long"))
            .withColumn("initial", F.substring("role", 1, 1)).withColumn("blank", blank).withColumn("duplicate", ~blank & again)
            .withColumn("truncated", ~blank & ~again & ~F.substring(body, -1, 1).isin(".", "!", "?"))
            .withColumn("illegal", (F.col("pos") > 1) & ~F.concat(F.lag("initial", 1, "").over(order), "initial").isin("su", "ua", "au"))
            .withColumn("new_turn", F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.lag("turn").over(order)))
            .withColumn("fault", F.when(F.col("blank") | F.col("duplicate"), GONE).when(F.col("truncated"), TRUNCATED).otherwise(FINE)))
    return stored(rows.drop("again"))


def audits(rows: DataFrame) -> DataFrame:
    """``conv_id, cost, audit`` of ``marked`` rows."""
    light = rows.select("conv_id", F.floor((F.col("pos") - 1) / SEGMENT).cast("long").alias("seg"), "pos", "initial",
                        F.col("fault").cast("int").alias("fault"))
    pieces = (light.repartition("conv_id", "seg").sortWithinPartitions("conv_id", "seg", "pos")
              .mapInArrow(solve, "conv_id long, seg long, start int, goal int, cost long, audit string"))
    return (pieces.repartition("conv_id").sortWithinPartitions("conv_id", "seg", "start", "goal")
            .mapInArrow(join_pieces, "conv_id long, cost long, audit string"))


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``conv_id, n, edit, turn, role, text``: the turns of the repaired
    conversations (n from 1; an inserted turn has a null turn and empty text).
    All turns of a conversation come from one partition, one after another."""
    head = found.select("conv_id", F.lit(0).cast("long").alias("pos"), *[F.lit(None).cast(t).alias(c) for c, t in
                        (("turn", "long"), ("role", "string"), ("text", "string"))], "audit")
    both = rows.select("conv_id", "pos", "turn", "role", "text", F.lit(None).cast("string").alias("audit")).unionByName(head)
    return (both.repartition("conv_id").sortWithinPartitions("conv_id", "pos")
            .mapInArrow(apply, "conv_id long, n long, edit string, turn long, role string, text string"))


def repair_conversations(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Marked rows, audits, and repaired turns of the conversations of ``df``
    (``conv_id, turn, role, text``)."""
    ship(df.sparkSession)
    rows = marked(df)
    found = stored(audits(rows))
    return rows, found, repaired(rows, found)


def summary(ids: DataFrame, rows: DataFrame, found: DataFrame, turns: DataFrame) -> DataFrame:
    """One row per conv_id of ``ids``: faults, cost, audit and a hash of the
    repaired text."""
    counts = rows.groupBy("conv_id").agg(
        (F.max("turn") - F.min("turn") + 1 - F.sum(F.col("new_turn").cast("long"))).alias("gaps"),
        *[F.sum(F.col(c).cast("long")).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")])
    hashes = turns.mapInArrow(hashed, "conv_id long, repaired_sha256 string")
    parts = ids.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    for other in (counts, found, hashes):
        parts = parts.unionByName(other, allowMissingColumns=True)
    zero = {c: F.coalesce(F.max(c), F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return parts.groupBy("conv_id").agg(
        *zero.values(), F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("repaired_sha256"), F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
