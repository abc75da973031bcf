"""Operator 11 against all pairs, on odd rows and on groups of near copies of many sizes."""

from __future__ import annotations

import random
import re
from itertools import combinations

from schemaloom.llm import jaccard_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size=3):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + size]) for i in range(max(len(words) - size + 1, 1))} if words else set()


def brute(rows, percent=90):
    sets = [shingles(r[1]) for r in rows]
    label = list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= percent * len(a | b) and label[i] != label[j]:
            label = [label[i] if x == label[j] else x for x in label]
    out = []
    for i, row in enumerate(rows):
        ids = [r[0] for k, r in enumerate(rows) if label[k] == label[i] and r[0] is not None]
        out.append((row[0], len(sets[i]), min(ids, default=None)))
    return sorted(out, key=repr)


def found(frame, **options):
    return sorted(map(tuple, jaccard_join.groups(frame, **options).collect()), key=repr)


def near_rows(seed):
    """Groups of near copies with few and many changes, a passage that all share, short texts, ties."""
    rng = random.Random(seed)
    passage = " ".join(f"p{i}" for i in range(30))
    rows = []
    for group in range(12):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([9, 12, 25, 60, 200, 600]))]
        for _ in range(rng.choice([2, 5, 40])):
            words = list(base)
            for _ in range(rng.randrange(0, 1 + max(1, len(base) // 25))):
                words[rng.randrange(len(words))] = f"x{rng.randrange(200)}"
            rows.append((len(rows) * 7 % 1009, " ".join([*words, passage] if group % 3 == 0 else words)))
    rows += [(2000 + i, " ".join(f"s{j}" for j in range(10 + i % 3))) for i in range(9)]
    return rows


def test_odd_rows(odd, odd_rows):
    assert found(odd) == brute([(r[0], r[1]) for r in odd_rows])


def test_near_copies_over_tiles(spark):
    rows = near_rows(3)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    expected = brute(rows)
    assert len({r[2] for r in expected}) <= len(rows) - 100
    assert found(frame) == expected
    assert found(frame, tile=7) == expected
    assert found(frame, percent=75) == brute(rows, 75)


def test_no_rows(none):
    assert found(none) == []
