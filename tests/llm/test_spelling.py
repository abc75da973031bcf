"""Operator 13 against all pairs of words, on odd rows, long words and an empty table."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from schemaloom.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_counts(rows, damage):
    counts = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if damage and h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(counts):
    form, out = {}, []
    others = {w: [v for v in counts if near(w, v)] for w in counts}
    for w in counts:
        best = min(others[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 10 * counts[w] else None
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(others[w]), counts[form[w]] if form[w] else None))
    return sorted(out)


def words_with_variants(seed):
    rng = random.Random(seed)
    letters = "abé×"
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(7, 10))) for _ in range(150)]
    words += ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "baaaaaaaa", "aaaaaaaab", "abababab", "babababab"]
    words += ["x" * 300 + "y" + "z" * 300, "x" * 300 + "z" * 300, "x" * 299 + "y" + "z" * 301, "q" * 70, "q" * 71]
    for w in list(words):
        at = rng.randrange(len(w))
        words.append(w[:at] + rng.choice(letters) + w[at + rng.randrange(2) :])
    return {w: rng.choice([2, 3, 20, 30, 200, 300, 3000]) for w in words}


@pytest.mark.parametrize("damage", [None, 3])
def test_counts(odd, odd_rows, damage):
    found = {r.word: r.n for r in spelling.word_counts(odd, damage=damage).collect()}
    assert found == brute_counts([(r[0], r[1]) for r in odd_rows], damage)


def test_counts_of_marks_between_words(spark):
    rows = [(1, "AbcdefghĀabcdefgh Étudiante×abc, étudiante"), (2, "ABCDEFGH"), (None, "abcdefg1abcdefg")]
    found = {r.word: r.n for r in spelling.word_counts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == brute_counts(rows, None) == {"abcdefgh": 3, "abcdefg": 2}


@pytest.mark.parametrize("seed", [1, 2])
def test_variants(spark, seed):
    counts = words_with_variants(seed)
    frame = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(4)
    found = sorted(map(tuple, spelling.variants(frame).collect()))
    expected = brute_variants(counts)
    assert found == expected
    assert any(r[1] and r[2] != r[1] for r in expected) and any(r[4] > 3 for r in expected)


def test_no_words(none):
    assert spelling.variants(spelling.word_counts(none)).collect() == []
