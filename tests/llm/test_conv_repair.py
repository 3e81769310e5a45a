import hashlib
import heapq
import random
import re
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from skytune.llm import conv_repair as R

BLANK = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string"


def best_edits(rows):
    """Dijkstra over (row, roles so far legal) by (cost, audit): a plain search
    with none of the operator's bounds.  rows: (initial, may stay, extra)."""
    step = {"": "su", "s": "u", "u": "a", "a": "u"}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, out = heapq.heappop(heap)
        if (i, last) in done:
            continue
        done.add((i, last))
        if i == len(rows) and last in ("", "a"):
            return cost, audit, out
        for r in step[last].replace("s", ""):
            heapq.heappush(heap, (cost + 2, audit + "I", i, r, out + (("I", r, i),)))
        if i < len(rows):
            initial, stays, extra = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, last, out))
            if stays and initial and initial in step[last]:
                heapq.heappush(heap, (cost + extra, audit + "K", i + 1, initial, out + (("K", initial, i),)))
            if stays:
                for r in step[last].replace("s", ""):
                    heapq.heappush(heap, (cost + 2 + extra, audit + "R", i + 1, r, out + (("R", r, i),)))


def damage(rows):
    out = []
    for c, t, role, text in rows:
        key = ":".join(" " if x is None else str(x) for x in (c, t))
        fate = crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fate == 1:
            text = ""
        if fate == 2:
            text = re.sub("[.!?]", "", text)
        if fate == 4:
            role = "user"
        out += [(c, t, role, text)] * {0: 0, 3: 2}.get(fate, 1)
    return out


def brute(ids, rows):
    out = {}
    rows = [(c, t, *(" " if x is None else x for x in rest)) for c, t, *rest in rows]
    for conv in set(ids):
        mine = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, light, n = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in mine:
            body = text.strip(BLANK)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                n[fault] += 1
            light.append((role[:1], fault in (None, "truncated"), int(fault == "truncated")))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(light, light[1:]))
        turns = [t for t, _, _ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit, made = best_edits(light)
        name = {"u": "user", "a": "assistant"}
        lines = [f"{name[r]}:" if e == "I" else f"{name[r]}:{mine[i][2]}" if e == "R" else f"{mine[i][1]}:{mine[i][2]}" for e, r, i in made]
        out[conv] = (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def run(spark, rows, hurt=False, extra=False):
    df = spark.createDataFrame(rows, SCHEMA)
    df = df.repartition(3) if rows else df
    if extra:
        df = df.withColumns({c: F.lit(f"own {c}") for c in ("pos", "again", "fault", "initial", "audit", "cost", "seg", "n", "edit", "blank")})
    out = R.summary(df, *R.repair_conversations(R.damaged(df) if hurt else df))
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = out.collect()
    assert len({r.conv_id for r in got}) == len(got)
    return {r.conv_id: tuple(r)[1:] for r in got}


def random_rows(seed, convs, most):
    rnd = random.Random(seed)
    return [(c, rnd.choice([t, t, t, t + 1, None]), rnd.choice(["user", "assistant", "system", "tool", "", None]),
             rnd.choice(["Hello there.", "yes!", "cut off", "", " \n", None, f"text {rnd.random()}.", f"more {rnd.random()}"]))
            for c in range(convs) for t in range(rnd.randint(1, most))]


@pytest.mark.parametrize("segment", [1, 3, 256])
def test_equals_a_plain_search(spark, monkeypatch, segment):
    monkeypatch.setattr(R, "SEGMENT", segment)
    rows = random_rows(segment, 60, 9)
    ids = [r[0] for r in rows]
    assert run(spark, rows) == brute(ids, rows)
    assert run(spark, rows, hurt=True, extra=True) == brute(ids, damage(rows))


def test_every_start_and_goal_equals_the_whole():
    rnd = random.Random(4)
    for _ in range(300):
        rows = [(rnd.choice("suat "), rnd.choice([R.FINE, R.FINE, R.TRUNCATED, R.GONE])) for _ in range(rnd.randint(0, 12))]
        want = best_edits([(i, f != R.GONE, int(f == R.TRUNCATED)) for i, f in rows])[:2]
        states = {R.START: (0, "")}
        for seg in (rows[:5], rows[5:7], rows[7:]):
            states = R.chain(states, [(s, g, *R.cheapest(seg, s, g)) for s in range(4) for g in range(4) if R.cheapest(seg, s, g)])
        assert R.finish(states) == want


def test_long_conversation_takes_few_steps():
    rows = [("u", R.TRUNCATED)] * 256
    cost, audit = R.cheapest(rows, R.START, R.ASSISTANT)
    assert cost == 256 + 2 * 128 and len(audit) == 256


def test_edges(spark):
    rows = [(1, None, None, None), (1, None, "user", "a."), (2, 0, "system", "rules."), (None, 5, "user", "q?"), (None, None, "assistant", "r."),
            (3, 0, "user", ""), (4, 0, "user", "x " * 200000 + "end."), (4, 1, "assistant", "ok."), (4, 1, "assistant", "ok."),
            (5, 0, "user", "漢字 é ü 🙂."), (5, 9, "assistant", "ok. "), (6, 0, "üser", "hm.")]
    ids = [r[0] for r in rows]
    got = run(spark, rows, extra=True)
    assert got == brute(ids, rows)
    assert got[2][5:7] == (3, "D") and got[3][5:7] == (3, "D") and got[3][7] == hashlib.sha256(b"").hexdigest()


def test_conversation_that_loses_all_its_rows_and_empty_table(spark):
    gone = next(c for c in range(1000) if crc32(f"{c}:0".encode()) % 20 == 0)
    assert run(spark, [(gone, 0, "user", "hi.")], hurt=True) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert run(spark, [], hurt=True) == {}


def test_repaired_turns_read_as_a_legal_conversation(spark):
    rows = random_rows(9, 40, 12)
    _, found, turns = R.repair_conversations(spark.createDataFrame(rows, SCHEMA))
    roles = {r.conv_id: r.roles for r in turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("n", F.substring("role", 1, 1).alias("i")))), lambda x: x["i"]), "").alias("roles")).collect()}
    assert found.count() == len({r[0] for r in rows})
    assert all(re.fullmatch("s?(ua)+", r) for r in roles.values())
