"""Operator 12 against a search over all edits, on odd rows, long conversations and an empty table."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib
from itertools import groupby, product

import pytest

from schemaloom.llm import conversation_repair as repair

SCHEMA = "conv_id long, turn long, role string, text string"
STEPS = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def brute_edits(rows):
    """(cost, letters) by a search in order of (cost, letters) over (row, last role); rows are (initial, gone, cut)."""
    queue, best = [(0, "", 0, "")], {}
    goals = []
    while queue:
        cost, letters, i, last = heapq.heappop(queue)
        if goals and cost > goals[0][0]:
            break
        if best.get((i, last), cost) < cost:
            continue
        best[i, last] = cost
        if i == len(rows) and last in ("", "a"):
            goals.append((cost, letters))
        following = [q for (p, x), q in STEPS.items() if p == last and x in "ua"]
        if len(letters) < 3 * len(rows) + 4:
            for q in following:
                heapq.heappush(queue, (cost + 2, letters + "I", i, q))
        if i < len(rows):
            initial, gone, cut = rows[i]
            heapq.heappush(queue, (cost + 3, letters + "D", i + 1, last))
            if not gone:
                if (last, initial) in STEPS:
                    heapq.heappush(queue, (cost + cut, letters + "K", i + 1, STEPS[last, initial]))
                for q in following:
                    heapq.heappush(queue, (cost + 2 + cut, letters + "R", i + 1, q))
    return min(goals)


def brute(rows, damage):
    """Expected rows of ``audits``, from (conv_id, turn, role, text)."""
    space = lambda x: " " if x is None else x
    kept = []
    for conv, turn, role, text in rows:
        role, text = space(role), space(text)
        code = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20 if damage else 9
        if code == 1:
            text = ""
        if code == 2:
            text = re.sub("[.!?]", "", text)
        if code == 4:
            role = "user"
        kept += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(code, 1)
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted((r[1:] for r in kept if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        known = [t for t, _, _ in own if t is not None]
        counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        marks, seen = [], set()
        for _, role, text in own:
            written = text.strip(" \t\n\x0b\x0c\r")
            fault = None
            if not written:
                fault = "blank"
            elif (role, text) in seen:
                fault = "duplicate"
            elif written[-1] not in ".!?":
                fault = "truncated"
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            marks.append((role[:1], fault in ("blank", "duplicate"), int(fault == "truncated")))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marks, marks[1:]))
        cost, audit = brute_edits(marks)
        lines, i, last = [], 0, ""
        for letter in audit:
            name = "assistant" if last == "u" else "user"
            if letter == "I":
                lines.append(f"{name}:")
                last = name[0]
                continue
            if letter == "K":
                lines.append(f"{own[i][1]}:{own[i][2]}")
                last = own[i][1][0]
            if letter == "R":
                lines.append(f"{name}:{own[i][2]}")
                last = name[0]
            i += 1
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, gaps, *counts.values(), illegal, cost, audit, digest))
    return sorted(out, key=repr)


def odd_turns(seed):
    rng = random.Random(seed)
    rows = []
    for conv in range(60):
        for turn in range(rng.randrange(1, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "uncle"])
            text = rng.choice(["Yes.", "No!", "so", "and ", "Why? \n", "", " \t", None, " ", "Long " * 50 + "."])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 2, None]), role, text))
    rows += [(None, None, None, None), (None, 1, "user", "Hi."), (None, 2, "assistant", "Hi.")]
    rows += [(100, t, "user" if t % 2 else "assistant", f"{t}.") for t in range(40)]
    rows += [(101, 7, "user", "same.")] * 20 + [(101, 8, "user", "same.")] * 3
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_audits(spark, seed):
    rows = odd_turns(seed)
    turns = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert sorted(map(tuple, repair.audits(repair.filled(turns)).collect()), key=repr) == brute(rows, False)
    found = repair.audits(repair.damaged(turns), turns).collect()
    assert sorted(map(tuple, found), key=repr) == brute(rows, True)


def test_repaired_rows_have_the_hash(spark):
    turns = repair.filled(spark.createDataFrame(odd_turns(3), SCHEMA))
    rows = sorted(map(tuple, repair.repaired(turns).collect()), key=repr)
    lines = {c: [f"{r[3]}:{r[4]}" for r in sorted(g, key=lambda r: r[1])] for c, g in groupby(rows, lambda r: r[0])}
    for row in repair.audits(turns).collect():
        text = "\n".join(lines.get(row.conv_id, []))
        assert row.repaired_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_all_short_strings_of_symbols():
    tables = repair.Tables()
    for n in range(4):
        for symbols in product(range(repair.SYMBOLS), repeat=n):
            marks = [("" if s == 8 else "suax"[s // 2], s == 8, s % 2 if s < 8 else 0) for s in symbols]
            assert tables.repair(bytes(symbols)) == brute_edits(marks), symbols


def test_block_lengths_agree():
    rng = random.Random(5)
    one, four = repair.Tables(1), repair.Tables(4)
    for n in (5, 17, 400, 5001):
        symbols = bytes(rng.choice([2, 4, 2, 4, 0, 3, 5, 8, 6]) for _ in range(n))
        assert one.repair(symbols) == four.repair(symbols)


def test_texts_in_a_file(spark, monkeypatch):
    talk = repair.Conversation(1)
    monkeypatch.setattr(repair, "HELD", 500)
    for i in range(40):
        talk.add(i, "user" if i % 2 == 0 else "assistant", f"é{i}" * 20 + ".", 1, False)
    cost, audit = talk.summary()[-2:]
    assert talk.spool is not None and (cost, audit) == (0, "K" * 40)
    assert [r[2] for r in talk.repaired(audit)] == [f"é{i}" * 20 + "." for i in range(40)]
    talk.close()


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert repair.audits(repair.damaged(none), none).collect() == []
    assert repair.repaired(repair.filled(none)).collect() == []


def test_extra_columns(spark):
    turns = spark.createDataFrame([(1, 0, "user", "Hi.", 7, "x", 1)], SCHEMA + ", copies int, seen string, cost int")
    assert repair.audits(repair.filled(turns)).first().audit == "KI"
