"""Rows that every operator must cope with: nulls, empty and very long texts, ties, repeats, odd columns."""

from __future__ import annotations

import random

import pytest

WORDS = "red green blue stone river cloud paper table seven eight nine hollow Über naïve großer señor x , ! www a".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ".", "\n"]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text, source) with copies, near copies, shared passages and the cases above."""
    rng = random.Random(7)
    passage = prose(rng, 40)
    rows = [(i, prose(rng, rng.randrange(1, 120)), f"src{i % 4}") for i in range(40)]
    rows += [(40 + i, prose(rng, 20) + " " + passage + " " + prose(rng, 10 * i), "src1") for i in range(5)]
    rows += [(50 + i, rows[3][1], "src3") for i in range(4)]  # copies, a tie in every respect
    rows += [(60, rows[7][1] + " end", "src2"), (61, rows[7][1].upper(), None)]
    rows += [(70, None, "src0"), (71, "", "src0"), (72, " \n\t ", None), (73, "one", "src1"), (74, "two words", "src1")]
    rows += [(80, prose(rng, 30_000), "src2"), (81, "ab" * 60_000, "src2"), (82, "same " * 5_000, "src2")]
    rows += [(None, passage, "src0"), (None, None, None), (90, "a\x1fb\u00a0c\u2028d \x0b e \x85f", "src1")]
    rows += [rows[5], rows[5]]  # repeated rows
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The rows with further columns, some named like the operators' own."""
    wide = [(*r, "x", 1.5, 7, "y", [1]) for r in odd_rows]
    names = "doc_id long, text string, source string, fp string, score double, n_words int, key string, spans array<int>"
    return spark.createDataFrame(wide, names).repartition(3).sortWithinPartitions("doc_id")


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.01"
