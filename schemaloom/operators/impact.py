"""Exact best documents for questions, from an inverted index in blocks with the greatest weight of every key.

Documents are dealt to parts; a part's index lists, for each key that a question has, its documents with their
weights. A task takes one part and one block of questions. It adds up keys in the order of what they can bring at
most, and once no other document can reach the ``k`` best it goes on with the ones that can. So
at most ``k`` rows per question leave a task, however common a word is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from schemaloom.runtime import broadcast_if_small, materialise

#: Documents of a part of the index, and questions that a task looks up in it.
DOCUMENTS = 4096
QUESTIONS = 1024
#: Turns of questions per part, beyond which a turn takes more questions instead, as the part travels once per turn.
TURNS = 4096
#: Documents of a part up to which questions are scored many at once, and scores that are held for that.
FEW, CELLS = 512, 4_000_000
#: Distinct keys of all questions up to which they are broadcast to cut the index down.
BROADCAST_KEYS = 500_000


class Index:
    """The lists of one part: for each key the places of its documents, their weights, and the greatest of them."""

    def __init__(self, keys: list[str], lists: list[pa.StructArray]):
        self.keys = pa.array(keys, pa.string())
        ids, weights = zip(*(x.flatten() for x in lists))
        # Places are in the order of the ids, so that the smaller place wins a tie.
        self.ids, place = np.unique(np.concatenate([np.asarray(x.to_pylist()) for x in ids]), return_inverse=True)
        ends = np.cumsum([len(x) for x in ids])[:-1]
        self.places = dict(zip(keys, np.split(place, ends)))
        self.weights = dict(zip(keys, (w.to_numpy() for w in weights)))
        self.most = {k: int(w.max()) for k, w in self.weights.items()}

    def best_of_few(self, asked: pa.ListArray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, ids, scores) as by ``best`` for every row of ``asked``: all scores are added up, none is left out early."""
        known = self.keys.to_pylist()
        lengths = np.array([len(self.places[key]) for key in known])
        starts = np.cumsum(lengths) - lengths
        places, weights = (np.concatenate([x[key] for key in known]) for x in (self.places, self.weights))
        found = []
        step = max(1, CELLS // len(self.ids))
        for start in range(0, len(asked), step):
            part = asked.slice(start, step)
            row = np.repeat(np.arange(len(part)), pc.fill_null(pc.list_value_length(part), 0).to_numpy())
            keys, factor, bonus = part.flatten().flatten()
            number = pc.fill_null(pc.index_in(keys, value_set=self.keys), -1).to_numpy()
            factor, bonus = factor.to_numpy(), bonus.to_numpy(zero_copy_only=False)
            total = np.zeros(len(part) * len(self.ids), np.int64)
            for extra in (False, True):
                one = np.flatnonzero((number >= 0) & (bonus == extra))
                size = lengths[number[one]]
                at = np.arange(size.sum()) + np.repeat(starts[number[one]] - (np.cumsum(size) - size), size)
                cell = np.repeat(row[one] * len(self.ids), size) + places[at]
                points = np.repeat(factor[one], size) * weights[at]
                if extra:
                    points *= total[cell] > 0
                np.add.at(total, cell, points)
            total = total.reshape(len(part), -1)
            order = np.argsort(-total, axis=1, kind="stable")[:, :k]
            scores = np.take_along_axis(total, order, axis=1)
            rows, ranks = np.nonzero(scores)
            found.append((rows + start, self.ids[order[rows, ranks]], scores[rows, ranks]))
        return tuple(np.concatenate(x) for x in zip(*found))

    def best(self, asked: list[dict], k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the ``k`` best documents that share a key that is no bonus; smaller ids win ties."""
        known = [a for a in asked if a["key"] in self.places]
        known.sort(key=lambda a: (a["bonus"], -a["factor"] * self.most[a["key"]]))
        bounds = [a["factor"] * self.most[a["key"]] for a in known]
        left = sum(bounds)
        total = np.zeros(len(self.ids), np.int64)
        able: np.ndarray | None = None  # documents that can still be among the best, once others cannot
        for a, bound in zip(known, bounds):
            places, weights = self.places[a["key"]], self.weights[a["key"]]
            if a["bonus"] and able is None:
                able = total > 0
            if able is not None:
                mine = able[places]
                places, weights = places[mine], weights[mine]
            total[places] += a["factor"] * weights
            left -= bound
            if left and (total > 0).sum() >= k:
                last = np.partition(total, len(total) - k)[len(total) - k]
                if left < last:
                    able = total + left >= last
        found = np.flatnonzero(total)
        order = found[np.lexsort((found, -total[found]))[:k]]
        return self.ids[order], total[order]


def top_scores(
    asked: DataFrame, documents: DataFrame, k: int, documents_at_once: int = DOCUMENTS, questions_at_once: int = QUESTIONS
) -> DataFrame:
    """(q_id, d_id, score, rank): the ``k`` documents of the greatest sum of factor times weight over shared keys, exact.

    ``asked`` has (q_id, keys) and ``documents`` (d_id, keys), one row each, with keys as arrays of (key, factor, bonus) and
    of (key, weight); both are positive whole numbers. A bonus counts for documents that share another key.
    Ties prefer the smaller id; pairs that share no key are left out. Only lists of keys that are asked are
    kept. An index part travels once per block of questions, and a question once per part.
    """
    d_type, q_type = (f.schema[n].dataType.simpleString() for f, n in ((documents, "d_id"), (asked, "q_id")))
    asked = materialise(asked.select("q_id", "keys"))
    parts = max(1, -(-documents.count() // documents_at_once))
    turns = min(TURNS, max(1, -(-asked.count() // questions_at_once)))
    wanted = asked.select(F.explode("keys.key").alias("key")).distinct()
    part = F.pmod(F.xxhash64("d_id"), F.lit(parts)).cast("int").alias("part")
    rows = documents.select("d_id", part, F.explode("keys").alias("k")).select("d_id", "part", "k.key", F.col("k.weight").cast("bigint").alias("weight"))
    rows = rows.join(broadcast_if_small(wanted, BROADCAST_KEYS), "key", "left_semi")
    lists = rows.groupBy("part", "key").agg(F.collect_list(F.struct("d_id", "weight")).alias("list"))
    lists = materialise(lists)

    every_turn = F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("turn")
    every_part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    own_turn = F.pmod(F.xxhash64("q_id"), F.lit(turns)).cast("int").alias("turn")
    empty = {c: F.lit(None).cast(t) for c, t in (("q_id", q_type), ("keys", asked.schema["keys"].dataType))}
    index = lists.select("part", every_turn, F.lit(0).alias("order"), "key", "list").withColumns(empty)
    one_list = F.lit(None).cast(lists.schema["list"].dataType).alias("list")
    questions = asked.select(every_part, own_turn, F.lit(1).alias("order"), F.lit(None).cast("string").alias("key"), one_list, "q_id", "keys")
    stream = index.unionByName(questions).repartition("part", "turn").sortWithinPartitions("part", "turn", "order")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[str] = []
        held: list[pa.StructArray] = []
        index: Index | None = None
        at = None
        for batch in batches:
            kinds = [batch["list"].type.value_type.field("d_id").type, pa.int64()]
            places = np.stack([batch[c].to_numpy() for c in ("part", "turn", "order")], axis=1)
            ends = [*(np.flatnonzero((places[1:] != places[:-1]).any(axis=1)) + 1), len(places)]
            for start, end in zip([0, *ends], ends):
                # Rows of one part and turn: lists first, then questions.
                rows = batch.slice(start, end - start)
                if tuple(places[start, :2]) != at:
                    at, keys, held, index = tuple(places[start, :2]), [], [], None
                if places[start, 2] == 0:
                    keys += rows["key"].to_pylist()
                    held += [x.values for x in rows["list"]]
                    continue
                if index is None and keys:
                    index, held = Index(keys, held), []
                if index is None:
                    continue
                if len(index.ids) <= FEW:
                    row, d, v = index.best_of_few(rows["keys"], k)
                    q = rows["q_id"].take(pa.array(row))
                else:
                    best = [index.best(x.as_py() or [], k) for x in rows["keys"]]
                    d, v = (np.concatenate(x) for x in zip(*best))
                    q = rows["q_id"].take(pa.array(np.repeat(np.arange(len(best)), [len(ids) for ids, _ in best])))
                if len(d):
                    yield pa.record_batch([q, *(pa.array(c.tolist(), t) for c, t in zip((d, v), kinds))], ["q_id", "d_id", "score"])

    found = stream.mapInArrow(run, f"q_id {q_type}, d_id {d_type}, score bigint")
    best = Window.partitionBy("q_id").orderBy(F.desc("score"), "d_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
