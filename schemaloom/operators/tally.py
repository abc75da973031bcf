"""Scores of a few documents for many questions: a batch of questions is scored at once, in Arrow and numpy.

Words of a question look up rows (place, points) of the documents that hold them; what a question gets adds up in one
row of numbers, so that neither words nor pairs of questions and documents are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Places of documents in a row of scores.
PLACES = 64
#: Characters of documents that every task holds.
CHARACTERS = 1 << 20


class Points:
    """Points by (group, text): the places that get them."""

    def __init__(self, rows: list[tuple[int, str, int, int]]):
        """``rows`` are (group, text, place, points); rows of one text add up."""
        rows = sorted(rows, key=lambda r: (r[1], r[0]))
        self.texts = pa.array(sorted({r[1] for r in rows}), pa.string())
        number = {t: i for i, t in enumerate(self.texts.to_pylist())}
        key = np.array([r[0] * len(number) + number[r[1]] for r in rows], np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.starts, self.sizes = np.unique(key[order], return_index=True, return_counts=True)
        self.places, self.points = (np.array([r[i] for r in rows], np.int64)[order] for i in (2, 3))

    def add(self, total: np.ndarray, row: np.ndarray, group: np.ndarray, texts: pa.Array) -> None:
        """Add to ``total[row]`` what each of ``texts`` brings in its group."""
        if not len(self.keys):
            return
        number = pc.fill_null(pc.index_in(texts, value_set=self.texts), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        known = np.flatnonzero(number >= 0)
        key = group[known] * len(self.texts) + number[known]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        met = self.keys[at] == key
        at, row = at[met], row[known[met]]
        size = self.sizes[at]
        of = np.arange(size.sum()) + np.repeat(self.starts[at] - (np.cumsum(size) - size), size)
        cell = np.repeat(row * total.shape[1], size) + self.places[of]
        # Counted as float64, which is exact for sums of a batch.
        total += np.bincount(cell, self.points[of], total.size).astype(np.int64).reshape(total.shape)


def rows_of(lists: pa.ListArray) -> np.ndarray:
    """The row of every element of a column of lists."""
    return np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))


def within(text: str, texts: pa.Array) -> np.ndarray:
    """Where ``text`` lies in ``texts``."""
    return pc.match_substring(texts, text).to_numpy(zero_copy_only=False)


def summed(asked: DataFrame, names: list[str], places: int, score: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(names..., scores): one row for each different ``names`` that ``score`` keeps, rows of equal ones added up.

    ``score`` returns the rows of a batch that are kept and their numbers, ``places`` each.
    """
    numbers = [f"s{i}" for i in range(places)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, total = score(batch)
            if len(kept):
                columns = [batch[n].take(pa.array(kept)) for n in names]
                columns += [pa.array(np.ascontiguousarray(x)) for x in total.T]
                yield pa.record_batch(columns, [*names, *numbers])

    kinds = [f"`{n}` {asked.schema[n].dataType.simpleString()}" for n in names] + [f"{n} bigint" for n in numbers]
    sums = asked.mapInArrow(run, ", ".join(kinds)).groupBy(*names).agg(*[F.sum(n).alias(n) for n in numbers])
    return sums.select(*names, F.array(*numbers).alias("scores"))


def by_table(asked: DataFrame, features: list, boosts: list[int], all_mark: str, mark: str) -> DataFrame | None:
    """(q_id, database, tables): the scores of ``retrieval.table_scores`` for one row per question and database.

    ``asked`` has (q_id, database, q_text, words, boosted); ``features`` are rows (database, table, is_user, key, points, values,
    named). None when a database has more than ``PLACES`` tables.
    """
    tables: dict[str, list[str]] = {}
    for r in features:
        if r["database"] is not None:
            tables.setdefault(r["database"], []).append(r["table"])
    tables = {d: sorted(set(t)) for d, t in sorted(tables.items())}
    places = max(map(len, tables.values()), default=0)
    if not 0 < places <= PLACES:
        return None
    group = {d: i for i, d in enumerate(tables)}
    place = {(d, t): i for d, names in tables.items() for i, t in enumerate(names)}
    words, values = [], {}
    boosted = np.zeros((len(group), len(boosts), places), np.int64)
    for r in features:
        if r["database"] is None:
            continue
        g, p = group[r["database"]], place[r["database"], r["table"]]
        if r["key"] != all_mark:
            words.append((g, r["key"].removeprefix(mark), p, r["points"]))
            continue
        for v in r["values"] or []:
            values.setdefault((g, v["value"]), []).append((p, v["points"]))
        if not r["is_user"]:
            boosted[g, :, p] += np.array(boosts) * np.array(r["named"])
    points, databases = Points(words), pa.array(list(group), pa.string())
    # What a value brings, as one row of numbers.
    brought = {key: np.bincount([p for p, _ in at], [n for _, n in at], places).astype(np.int64) for key, at in values.items()}

    def score(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        number = pc.fill_null(pc.index_in(batch["database"], value_set=databases), -1)
        of = number.to_numpy(zero_copy_only=False).astype(np.int64)
        total = np.zeros((len(of), places), np.int64)
        row = rows_of(batch["words"])
        words = batch["words"].flatten()
        mine = np.flatnonzero(of[row] >= 0)
        points.add(total, row[mine], of[row[mine]], words.take(pa.array(mine)))
        for g in range(len(group)):
            own = np.flatnonzero(of == g)
            if not len(own):
                continue
            texts = batch["q_text"].take(pa.array(own))
            longest = pc.max(pc.utf8_length(texts)).as_py()
            for (other, value), numbers in brought.items():
                if other == g and len(value) <= longest:
                    total[own[within(value, texts)]] += numbers
            asked = batch["boosted"].take(pa.array(own)).flatten().to_numpy(zero_copy_only=False)
            total[own] += asked.reshape(len(own), -1).astype(np.int64) @ boosted[g]
        kept = np.flatnonzero(of >= 0)
        return kept, total[kept]

    spark = asked.sparkSession
    names = spark.createDataFrame(pa.table({"database": list(tables), "names": pa.array(list(tables.values()), pa.list_(pa.string()))}))
    pair = lambda t, i: F.struct(t.alias("table"), F.get("scores", i).alias("score"))
    return (
        summed(asked, ["q_id", "database"], places, score)
        .join(F.broadcast(names), "database")
        .select("q_id", "database", F.transform("names", pair).alias("tables"))
    )


def by_text(asked: DataFrame, documents: list, kind: str, keywords: dict[str, int], run_points: int) -> DataFrame:
    """(q_id, d_id, score): the scores of ``retrieval.database_scores``, for pairs that score.

    ``asked`` has (q_id, q_text, words, runs); ``documents`` are rows (d_id, d_text, words, keywords), ``kind`` is the type of d_id.
    """
    place = {d: i for i, d in enumerate(dict.fromkeys(r["d_id"] for r in documents))}
    texts = [(place[r["d_id"]], r["d_text"]) for r in documents]
    words = Points([(0, w, place[r["d_id"]], 1) for r in documents for w in r["words"]])
    marked = {w: np.zeros(len(place), np.int64) for w in keywords}
    for r in documents:
        for w in r["keywords"]:
            marked[w][place[r["d_id"]]] += keywords[w]

    def score(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        total = np.zeros((batch.num_rows, len(place)), np.int64)
        row = rows_of(batch["words"])
        words.add(total, row, np.zeros(len(row), np.int64), batch["words"].flatten())
        for w, numbers in marked.items():
            if numbers.any():
                total[within(w, batch["q_text"])] += numbers
        runs = batch["runs"].flatten().dictionary_encode()
        held = np.zeros((len(runs.dictionary), len(place)), np.int64)
        for i, run in enumerate(runs.dictionary.to_pylist()):
            for p, text in texts:
                if run in text:
                    held[i, p] += run_points
        row, brought = rows_of(batch["runs"]), held[runs.indices.to_numpy()]
        for p in np.flatnonzero(held.any(axis=0)):
            total[:, p] += np.bincount(row, brought[:, p], len(total)).astype(np.int64)
        kept = np.flatnonzero(total.any(axis=1))
        return kept, total[kept]

    ids = [F.lit(d).cast(kind) for d in place]
    pairs = F.array(*[F.struct(d.alias("d_id"), F.get("scores", F.lit(i)).alias("score")) for i, d in enumerate(ids)])
    return summed(asked, ["q_id"], len(place), score).select("q_id", F.inline(F.filter(pairs, lambda p: p["score"] > 0)))
