"""SimHash fingerprints and an exact, tiled search for near fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schemaloom.llm.common import connected_components, free_name, with_fields
from schemaloom.runtime import materialise

SHINGLE = 3
RADIUS = 3
SEED = 42
#: About so many fingerprints make a tile; larger groups of equal population counts are split.
TILE = 4096
#: Shingles whose bits are counted at once; a memory bound, not a limit on the text.
COUNTED = 1 << 16
#: Tiles of a key that go to one task together, with as many of another key.
GROUP = 8
ROWS = 256


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of the word shingles of a text; 0 without words."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and the six white space characters
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    n = max(len(words) - shingle + 1, 1)
    ones = np.zeros(64, np.int64)
    reach = min(shingle, len(words)) - 1
    for at in range(0, n, COUNTED):
        to = min(at + COUNTED, n)
        spans = zip(starts[at:to], ends[at + reach : to + reach])
        hashes = np.fromiter((xxhash.xxh64_intdigest(joined[a : b - 1], SEED) for a, b in spans), np.uint64, to - at)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, column: str = "fp", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with the fingerprint of ``text`` as a long of the same bits; a map over batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t, shingle) for t in batch["text"].to_pylist()], np.uint64)
            yield pa.record_batch([*batch.columns, pa.array(values.view(np.int64))], [*batch.schema.names, column])

    return docs.mapInArrow(run, with_fields(docs.schema, **{column: "long"}))


def merged(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links between two tiles (or within one).

    Every pair is compared; a row of the comparison is only followed into columns that it is not yet
    connected with, so at most len(a) + len(b) edges come back for any number of links.
    """
    nodes = a if same else np.concatenate([a, b])
    parent = np.arange(len(nodes))
    shift = 0 if same else len(a)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    edges: list[tuple[int, int]] = []
    for at in range(0, len(a), ROWS):
        hit = np.bitwise_count(a[at : at + ROWS, None] ^ b[None, :]) <= radius
        if same:
            i = np.arange(len(hit))
            hit[i, at + i] = False
        while hit.any():
            rows = np.flatnonzero(hit.any(axis=1))
            columns = hit[rows].argmax(axis=1)
            for i, j in zip(rows, columns):
                i, j = at + int(i), shift + int(j)
                x, y = root(i), root(j)
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    edges.append((i, j))
            roots = parent
            while (up := roots[roots]).tolist() != roots.tolist():
                roots = up
            hit &= roots[at : at + len(hit), None] != roots[None, shift : shift + len(b)]
    found = np.array(edges, np.int64).reshape(-1, 2)
    return nodes[found[:, 0]], nodes[found[:, 1]]


def links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(u, v): links that connect all fingerprints of ``prints(fp)`` within ``radius`` bits, each fp once.

    A fingerprint's key is the population counts of its four 16-bit words. Two fingerprints within the
    radius have keys within the radius (in sums of differences), so tile pairs further apart are
    skipped; all others are compared whole. There are at most 17**4 keys, which bounds what is
    broadcast; keys with more than ``tile`` fingerprints are split into tiles by hash, and the pairs of
    tiles of two keys are dealt by groups of ``GROUP`` tiles, so that no task gets all pairs of a key.
    """
    counts = [F.bit_count(F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF))) for i in range(4)]
    key = sum(c * 17**i for i, c in enumerate(counts))
    keyed = prints.where("fp is not null").select("fp", key.cast("int").alias("key"))
    sizes = materialise(keyed.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("parts")))
    keyed = keyed.join(F.broadcast(sizes), "key").withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    tiles = materialise(keyed.groupBy("key", "part").agg(F.collect_list("fp").alias("fps")))

    steps = [d for d in product(range(-radius, radius + 1), repeat=4) if d >= (0,) * 4 and sum(map(abs, d)) <= radius]

    def meeting(sign: int, own: str, other: str) -> DataFrame:
        """Each tile once for every group of tiles that it is compared with: of its own key and of the near ones."""
        near = F.array(*[F.struct(*[F.lit(sign * x).alias(f"d{i}") for i, x in enumerate(d)]) for d in steps])
        digits = [F.expr(f"cast(key / {17**i} as int) % 17").alias(f"p{i}") for i in range(4)]
        moved = tiles.select("key", "part", "fps", *digits, F.explode(near).alias("d"))
        for i in range(4):
            moved = moved.withColumn(f"p{i}", F.col(f"p{i}") + F.col("d")[f"d{i}"]).where(f"p{i} between 0 and 16")
        target = sum(F.col(f"p{i}") * 17**i for i in range(4)).cast("int")
        moved = moved.withColumn("target", target).join(F.broadcast(sizes.toDF("target", "parts")), "target")
        return moved.select(
            F.col("key").alias(f"key_{own}"),
            F.col("target").alias(f"key_{other}"),
            F.expr(f"part div {GROUP}").alias(f"group_{own}"),
            F.explode(F.expr(f"sequence(0l, (parts - 1) div {GROUP})")).alias(f"group_{other}"),
            F.col("part").alias(f"part_{own}"),
            F.col("fps").alias(own),
        )

    keys = ["key_a", "key_b", "group_a", "group_b"]
    pairs = meeting(1, "a", "b").join(meeting(-1, "b", "a"), keys).where("key_a <> key_b or part_a <= part_b")
    pairs = pairs.select("a", "b", F.expr("key_a = key_b and part_a = part_b").alias("same"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = [], []
            for i, same in enumerate(batch["same"].to_pylist()):
                a, b = (batch[c][i].values.to_numpy().view(np.uint64) for c in "ab")
                if not same or len(a) > 1:
                    x, y = merged(a, b, radius, same)
                    u.append(x)
                    v.append(y)
            if u:
                yield pa.record_batch([pa.array(np.concatenate(x).view(np.int64)) for x in (u, v)], ["u", "v"])

    return pairs.mapInArrow(run, "u long, v long")


def components(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(fp, label): fingerprints that chains of links connect have the same label."""
    distinct = materialise(prints.select("fp").distinct())
    found = connected_components(links(distinct, radius, tile))
    return distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", F.coalesce("label", "fp").alias("label")
    )


def near_groups(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(doc_id, fp, component_id) of each row of ``docs(doc_id, text)``.

    component_id is the smallest doc_id that links reach. Texts without words (null or empty) have
    fingerprint 0 and are linked with each other like any other texts. A null doc_id belongs to its
    component but never names it; a component of null ids has a null component_id. Repeated rows stay
    repeated. Copies collapse to one fingerprint before anything is compared.
    """
    prints = materialise(fingerprints(docs.select("doc_id", "text"), "fp", shingle).select("doc_id", "fp"))
    labels = materialise(components(prints, radius, tile))
    lowest = prints.groupBy("fp").agg(F.min("doc_id").alias("low")).join(labels, "fp")
    lowest = lowest.groupBy("label").agg(F.min("low").alias("component_id"))
    named = materialise(labels.join(lowest, "label").select("fp", "component_id"))
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def drop_near_copies(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """One row of ``docs`` of each group that links of fingerprints connect, all columns as they are.

    The row with the smallest doc_id stays (of several texts of that id the one of the smallest hash); in a
    group whose ids are all null one row stays. Texts without words (null, empty, white space) have
    fingerprint 0 and are copies of each other. Of repeated rows one stays. An id that stands on texts of
    several groups may stay with each of them. No rows in, no rows out.
    """
    own = free_name(docs, "text_key")
    marked = fingerprints(docs.select("doc_id", "text"), "fp", shingle)
    prints = materialise(marked.select("doc_id", F.xxhash64("text").alias("own"), "fp"))
    labels = components(prints, radius, tile)
    row = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "own")
    lowest = prints.groupBy("fp").agg(F.min(row).alias("low")).join(labels, "fp")
    lowest = lowest.groupBy("label").agg(F.min("low").alias("low"))
    kept = materialise(lowest.select(F.col("low.doc_id").alias("kept_id"), F.col("low.own").alias("kept_text")))
    once = docs.withColumn(own, F.xxhash64("text")).dropDuplicates(["doc_id", own])
    kept = kept.toDF(free_name(once, "kept_id"), free_name(once, "kept_text"))
    stays = F.col("doc_id").eqNullSafe(F.col(kept.columns[0])) & (F.col(own) == F.col(kept.columns[1]))
    return once.join(kept, stays, "left_semi").drop(own)
