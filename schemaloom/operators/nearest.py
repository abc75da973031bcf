"""Exact nearest vectors for any number of queries, as a join of query blocks and vector blocks.

Every vector is placed in the cell of its nearest pivot, and blocks of one cell know how near to and how far from
the pivot they reach. By the triangle inequality that bounds the distance between a query and
all vectors of a block from below and above, so that most pairs of blocks are dropped by their bounds alone, and
more of them while a task already knows its queries' ``k`` best. A task hands on ``k`` rows per query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from schemaloom.runtime import materialise, small_frame

#: Vectors that stand for the cells: at most so many, those of least hash. The driver holds no others.
PIVOTS = 64
#: About so many bytes of vectors make a block, and so many queries.
BLOCK_BYTES = 1 << 20
QUERIES = 512
#: Tasks that share the pairs of a query block, and parts that the blocks' bounds are dealt to.
SLICES = 8
#: Distances are trusted up to this share of the vectors' size.
ROUNDING = 1e-9


def matrix(vectors: pa.Array) -> np.ndarray:
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(vectors), -1 if len(values) else 0)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` to all of ``b``, up to rounding."""
    sizes = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)
    return np.maximum(sizes - 2.0 * a @ b.T, 0.0)


def cut(group: np.ndarray, away: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, int]]:
    """(rows, cell) of blocks of about ``size`` rows: a group that fits is one block, a larger one is cut by cells."""
    order = np.argsort(group, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
        cell = away[rows].argmin(axis=1)
        if len(rows) <= size:
            yield rows, int(np.bincount(cell).argmax())
            continue
        for c in np.unique(cell).tolist():
            own = rows[cell == c]
            for part in np.array_split(own, -(-len(own) // size)):
                yield part, c


def blocks(frame: DataFrame, pivots: np.ndarray, size: int) -> DataFrame:
    """(block, grp, cell, n, low, high, ids, data): ``frame(id, grp, data)`` in blocks, with the least and greatest distance
    to the pivot of the cell.

    A task makes blocks of what it holds, at most some ``size`` rows per cell, so that no vector is shuffled. Written, as
    the bounds of all blocks are read before their vectors are.
    """
    names = ["block", "grp", "cell", "n", "low", "high", "ids", "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0

        def flush(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal made
            table = pa.Table.from_batches(parts).combine_chunks()
            data = matrix(table["data"].chunk(0))
            away = np.sqrt(squared(data, pivots))
            coded = table["grp"].chunk(0).dictionary_encode()
            for rows, cell in cut(coded.indices.to_numpy(), away, size):
                own = data[rows].ravel()
                group = coded.dictionary[coded.indices[int(rows[0])].as_py()].as_py()
                ids = pa.array([table["id"].take(pa.array(rows)).to_pylist()], pa.list_(pa.int64()))
                values = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), pa.array(own))
                bounds = [[len(rows)], [away[rows, cell].min()], [away[rows, cell].max()]]
                columns = [pa.array([f"{task}:{made}"]), pa.array([group]), pa.array([cell], pa.int32())]
                yield pa.record_batch([*columns, *map(pa.array, bounds), ids, values], names)
                made += 1

        parts, held = [], 0
        for batch in batches:
            if batch.num_rows:
                parts.append(batch)
                held += batch.num_rows
            if held >= size * len(pivots):
                yield from flush(parts)
                parts, held = [], 0
        if parts:
            yield from flush(parts)

    schema = "block string, grp string, cell int, n bigint, low double, high double, ids array<bigint>, data array<double>"
    return materialise(frame.select("id", "grp", "data").mapInArrow(run, schema))


def block_pairs(queries: DataFrame, vectors: DataFrame, pivots: np.ndarray, k: int) -> DataFrame:
    """(qb, vb, near): pairs of blocks whose bounds allow a vector among the ``k`` nearest of a query.

    ``near`` bounds their distances from below. The blocks that surely hold ``k`` vectors within some
    distance bound those of a query block from above. Only bounds are joined, dealt to SLICES parts.
    """
    apart = np.sqrt(squared(pivots, pivots))
    rows = [(i, j, float(apart[i, j])) for i in range(len(pivots)) for j in range(len(pivots))]
    apart = F.broadcast(small_frame(queries.sparkSession, rows, "qc int,vc int,apart double"))
    part = F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))).alias("part")
    asked = queries.select(F.col("block").alias("qb"), "grp", F.col("cell").alias("qc"), F.col("high").alias("reach"), part)
    held = vectors.select(F.col("block").alias("vb"), "grp", F.col("cell").alias("vc"), "n", "low", "high")
    held = held.withColumn("part", F.pmod(F.xxhash64("vb"), F.lit(SLICES)).cast("int"))
    pairs = asked.join(held, ["grp", "part"]).join(apart, ["qc", "vc"])
    near = F.greatest(F.lit(0.0), F.expr("apart - reach - high"), F.expr("low - apart - reach"))
    pairs = pairs.select("qb", "vb", "n", near.alias("near"), F.expr("apart + reach + high").alias("far"))
    so_far = Window.partitionBy("qb").orderBy("far", "vb").rowsBetween(Window.unboundedPreceding, 0)
    counted = pairs.withColumn("held", F.sum("n").over(so_far))
    enough = Window.partitionBy("qb").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = F.min(F.when(F.col("held") >= k, F.col("far"))).over(enough)
    kept = counted.withColumn("last", last).where(F.col("last").isNull() | (F.col("near") <= F.col("last") * (1 + 1e-6) + 1e-9))
    return kept.select("qb", "vb", "near")


class Best:
    """The ``k`` nearest of each query of a block so far; equal distances prefer the smaller id."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, pivots: np.ndarray, k: int):
        self.ids, self.data, self.k = ids, data, k
        self.sizes = np.einsum("ij,ij->i", data, data)
        self.away = np.sqrt(squared(data, pivots))
        self.last = np.full(len(ids), np.inf)
        self.found: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0), np.empty(0, np.int64))] * len(ids)

    def look(self, cell: int, low: float, high: float, ids: np.ndarray, data: np.ndarray) -> None:
        away = self.away[:, cell]
        bound = np.maximum(np.maximum(away - high, low - away), 0.0)
        asking = np.flatnonzero(bound * (1 - 1e-6) - 1e-9 <= np.sqrt(self.last))
        if not len(asking):
            return
        rough = squared(self.data[asking], data)
        margin = ROUNDING * (1.0 + self.sizes[asking] + np.einsum("ij,ij->i", data, data).max())
        if len(ids) > self.k:
            limit = np.partition(rough, self.k - 1, axis=1)[:, self.k - 1]
        else:
            limit = np.full(len(asking), np.inf)
        limit = np.minimum(limit, self.last[asking]) + 2 * margin
        for row, q in enumerate(asking.tolist()):
            kept = np.flatnonzero(rough[row] <= limit[row])
            if not len(kept):
                continue
            gap = data[kept] - self.data[q]
            value = np.concatenate([self.found[q][0], np.einsum("ij,ij->i", gap, gap)])
            name = np.concatenate([self.found[q][1], ids[kept]])
            order = np.lexsort((name, value))[: self.k]
            self.found[q] = value[order], name[order]
            if len(order) == self.k:
                self.last[q] = value[order[-1]]

    def rows(self) -> pa.RecordBatch:
        many = [len(v) for v, _ in self.found]
        columns = [pa.array(np.repeat(self.ids, many)), pa.array(np.concatenate([n for _, n in self.found]))]
        columns.append(pa.array(np.concatenate([v for v, _ in self.found])))
        return pa.record_batch(columns, ["q_id", "d_id", "value"])


def vector_top_k(
    queries: DataFrame, vectors: DataFrame, k: int, same_group: bool = False, query_block: int = QUERIES, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """(q_id, d_id, distance, rank): the ``k`` nearest vectors by squared distance, exact.

    ``queries`` has (q_id, vector[, grp]); ``vectors`` has (d_id, vector[, grp]). With ``same_group`` a query sees
    only the vectors of its own group. Ties prefer the smaller id; rows without vector (or group) take no part.
    The plan is the same for ten queries and for millions: query blocks and vector blocks are both
    written, a task gets a query block once and the vector blocks that its bounds leave, nearest first, and
    hands on ``k`` rows per query. A hot group or cell is many blocks.
    """
    spark = vectors.sparkSession
    group = (F.col("grp") if same_group else F.lit(0)).cast("string").alias("grp")
    data = F.col("vector").cast("array<double>").alias("data")

    def shaped(frame: DataFrame, name: str) -> DataFrame:
        rows = frame.select(F.col(name).cast("bigint").alias("id"), group, data)
        return rows.where("data is not null and size(data) > 0 and grp is not null")

    held = shaped(vectors, "d_id")
    chosen = held.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).select("data").collect()
    if not chosen:
        return spark.createDataFrame([], "q_id bigint, d_id bigint, distance double, rank int")
    pivots = np.array([r.data for r in chosen])
    size = max(1, block_bytes // (8 * pivots.shape[1]))
    held = blocks(held, pivots, size)
    asked = blocks(shaped(queries, "q_id"), pivots, query_block)
    pairs = block_pairs(asked, held, pivots, k)

    turns = F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))).alias("slice")
    first = asked.select(
        F.col("block").alias("qb"), turns, F.lit(0).alias("turn"), F.lit(0.0).alias("near"), "cell", "low", "high", "ids", "data"
    )
    then = pairs.join(held, pairs.vb == held.block).select(
        "qb", F.pmod(F.xxhash64("vb"), F.lit(SLICES)).cast("int").alias("slice"), F.lit(1).alias("turn"), "near", "cell",
        "low", "high", "ids", "data",
    )
    stream = first.unionByName(then).repartition("qb", "slice").sortWithinPartitions("qb", "slice", "turn", "near")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: Best | None = None
        for batch in batches:
            turn, cell, low, high = (batch[c].to_pylist() for c in ("turn", "cell", "low", "high"))
            for i in range(batch.num_rows):
                ids = batch["ids"][i].values.to_numpy()
                data = batch["data"][i].values.to_numpy().reshape(len(ids), -1)
                if turn[i]:
                    best.look(cell[i], low[i], high[i], ids, data)
                    continue
                if best is not None:
                    yield best.rows()
                best = Best(ids.copy(), data.copy(), pivots, k)
        if best is not None:
            yield best.rows()

    found = stream.mapInArrow(run, "q_id bigint, d_id bigint, value double")
    order = Window.partitionBy("q_id").orderBy("value", "d_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("q_id", "d_id", F.col("value").alias("distance"), "rank")
