"""Repair of conversations against a plain dynamic programme, a whole enumeration and Python's own damage."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from inkwell.llm import conversations as cv

SPACE = "[\x20\x09-\x0d]"


def least(codes):
    """Least (cost, audit) by filling the whole lattice row by row."""
    def inserted(row):
        for _ in range(3):
            for q, (_, to) in cv.WANTED.items():
                if q in row:
                    row[to] = min(row.get(to, (99999, "")), (row[q][0] + 3, row[q][1] + "I"))
        return row

    row = inserted({0: (0, "")})
    for code in codes:
        after = {}
        for q, (cost, audit) in row.items():
            steps = [(q, 4, "D")]
            if code != "d":
                more = 3 * code.isupper()
                steps.append((2 if q != 2 else 3, 3 + more, "R"))
                to = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((code.lower(), q))
                if to is not None:
                    steps.append((to, more, "K"))
            for to, more, letter in steps:
                after[to] = min(after.get(to, (99999, "")), (cost + more, audit + letter))
        row = inserted(after)
    return min(row[q] for q in (0, 3) if q in row)


def brute(rows):
    """The contract in plain Python, for rows (conv_id, turn, role, text)."""
    out = []
    for conv in {r[0] for r in rows}:
        own = []
        for c, turn, role, text in rows:
            if c == conv:
                role, text = (" " if role is None else role), (" " if text is None else text)
                kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
                text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
                own += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, codes, count = set(), "", dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for turn, role, text in own:
            bare = re.sub(SPACE, "", text)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                count[fault] += 1
            code = role[:1] if role[:1] in ("s", "u", "a") else "x"
            codes += "d" if fault in ("blank", "duplicate") else code.upper() if fault else code
        turns = [r[0] for r in own if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit = least(codes)
        lines, state, at = [], 0, 0
        for edit in audit:
            role, text = own[at][1:] if edit != "I" else ("", "")
            at += edit != "I"
            if edit == "D":
                continue
            if edit in "IR":
                role = "assistant" if state == 2 else "user"
            state = {"s": 1, "u": 2, "a": 3}[role[0]]
            lines.append(f"{role}:{text}")
        assert re.fullmatch("(s?(ua)+)?", "".join(line[0] for line in lines))
        out.append((conv, gaps, *count.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("n", range(5))
def test_every_short_path(n):
    for codes in itertools.product(cv.MOVES, repeat=n):
        assert cv.cheapest.__wrapped__("".join(codes)) == least(codes)


def test_long_paths_and_segments():
    rnd = random.Random(4)
    for _ in range(300):
        codes = "".join(rnd.choices("dsuaxSUAX", (2, 1, 8, 8, 1, 1, 2, 2, 1), k=rnd.randrange(60)))
        assert cv.cheapest.__wrapped__(codes) == least(codes)
    assert cv.cheapest("s", 2, (1,)) is None and cv.cheapest("", 3, (0,)) is None and cv.cheapest("", 2, (2,)) == (0, "")


def found(spark, rows, size):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, kind string, place int")
    got = cv.repaired(df, cv.damaged(df), size).collect()
    return sorted((tuple(r) for r in got), key=repr)


def odd_rows():
    rnd = random.Random(11)
    words = ["Yes.", "No", "Why?", "", " \t\n", "One. Two", "Well! \n", "a\x85.", ". ", None, "x" * 3000, "é日本。", "Sure. " * 400]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", " ", "User", None, "Ünder", "sys", "a"]
    rows = []
    for conv in [*range(150), None, -3]:
        for turn in range(rnd.randrange(9)):
            rows.append((conv, rnd.choice([turn, turn, turn, turn * 3, None, 2]), rnd.choice(roles), rnd.choice(words)))
    rows += rows[:40]
    rows += [(999, t, ("user", "assistant")[t % 2] if t % 7 else "tool", f"turn {t}.") for t in range(700)]
    rows += [(1000, -(2**63), "user", "Far."), (1000, 2**63 - 1, "assistant", "Away.")]
    return rows


@pytest.mark.parametrize("size", [cv.SEGMENT, 3])
def test_equals_plain_python(spark, size):
    rows = odd_rows()
    got, want = found(spark, rows, size), brute(rows)
    want = [w[:1] + (None,) + w[2:] if w[1] >= 2**63 else w for w in want]
    assert got == want


def test_all_rows_dropped_and_no_rows(spark):
    gone = [(c, t, "user", "Hi.") for c in range(40) for t in range(40) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0][:3]
    lone = [r for r in gone if sum(g[0] == r[0] for g in gone) == 1]
    assert found(spark, lone, 512) == [(r[0], 0, 0, 0, 0, 0, 0, "", cv.EMPTY_SHA256) for r in lone]
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert cv.repaired(empty, cv.damaged(empty)).count() == 0


def test_turns(spark):
    df = spark.createDataFrame([(1, 0, "assistant", "A."), (1, 1, "user", "B."), (1, 2, "tool", "C.")], "conv_id long, turn long, role string, text string")
    turns = cv.repaired_turns(df, cv.plans(df)).orderBy("place").collect()
    assert [(t.edit, t.role, t.text) for t in turns] == [("I", "user", ""), ("K", "assistant", "A."), ("K", "user", "B."), ("R", "assistant", "C.")]
