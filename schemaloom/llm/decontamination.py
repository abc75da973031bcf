"""Finds short benchmark items inside documents by size-partitioned MinHash and exact containment."""

from __future__ import annotations

import re
from collections.abc import Iterator
from fractions import Fraction
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schemaloom.llm.common import free_name, with_fields

SHINGLE = 5
CONTAINMENT = Fraction(4, 5)
#: Characters of items that one pass over the documents looks for; more items make more passes.
BLOCK_CHARS = 4_000_000
#: Word hashes that a task remembers; emptied when full.
KEPT = 500_000

WORDS = re.compile(r"\w+")
HITS = "array<struct<item_id: long, n_shingles: int, n_found: int>>"


def words_of(text: str | None) -> list[str]:
    """Runs of letters, digits and underscores, lower-cased."""
    return WORDS.findall((text or "").lower())


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= KEPT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingle_hashes(words: list[str], size: int, hashes: WordHashes) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    one = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    total = one[:n].copy()
    for i in range(1, size):
        total *= np.uint64(0x9E3779B97F4A7C15)
        total += one[i : i + n]
    total ^= total >> np.uint64(31)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    return total ^ (total >> np.uint64(29))


def sketch_size(n: int, containment: Fraction = CONTAINMENT) -> int:
    """Least hashes kept of an item with n shingles: those of the upper bound of its size class.

    Classes are (2**(i-1), 2**i]. A text that holds the share ``containment`` of the n shingles lacks at
    most n - ceil(containment * n) of them, hence has one of that many and one more, whichever they are.
    """
    upper = 1 << max(n - 1, 0).bit_length()
    return upper - ceil(containment * upper) + 1


class Index:
    """Bottom-k MinHash sketches of items, by shingle size, with their shingles for the exact check."""

    def __init__(self, items: list[tuple[int, str]], shingle: int, containment: Fraction):
        self.containment = containment
        self.shingles: list[set[str]] = []
        self.ids: list[int] = []
        self.size: list[int] = []
        self.hashes = WordHashes()
        self.sketch: dict[int, dict[int, list[int]]] = {}
        self.all: list[np.ndarray] = []
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            size = min(shingle, len(words))
            hashed = np.unique(shingle_hashes(words, size, self.hashes))
            number = len(self.ids)
            self.ids.append(item_id)
            self.size.append(size)
            self.shingles.append({" ".join(words[i : i + size]) for i in range(len(words) - size + 1)})
            self.all.append(hashed)
            table = self.sketch.setdefault(size, {})
            for h in hashed[: sketch_size(len(hashed), containment)].tolist():
                table.setdefault(h, []).append(number)
        self.near = {}  # a bit table in front of each sketch
        for size, table in self.sketch.items():
            near = np.zeros(1 << 16, bool)
            near[(np.fromiter(table, np.uint64, len(table)) & np.uint64(0xFFFF)).astype(np.int64)] = True
            self.near[size] = near

    def find(self, text: str | None) -> list[dict]:
        words = words_of(text)
        out = []
        for size, table in self.sketch.items():
            hashed = shingle_hashes(words, size, self.hashes)
            if not len(hashed):
                continue
            maybe = hashed[self.near[size][(hashed & np.uint64(0xFFFF)).astype(np.int64)]]
            candidates = {n for h in maybe.tolist() for n in table.get(h, ())}
            for n in candidates:
                places = np.flatnonzero(np.isin(hashed, self.all[n]))
                found = {" ".join(words[i : i + size]) for i in places.tolist()} & self.shingles[n]
                if len(found) >= self.containment * len(self.shingles[n]):
                    out.append({"item_id": self.ids[n], "n_shingles": len(self.shingles[n]), "n_found": len(found)})
        return sorted(out, key=lambda x: (x["item_id"] is not None, x["item_id"], -x["n_found"]))


def with_hits(
    docs: DataFrame, items: DataFrame, column: str, shingle: int = SHINGLE, containment: Fraction = CONTAINMENT
) -> DataFrame:
    """``docs`` with ``column``: the items of ``items(item_id, text)`` that each ``text`` contains.

    An item is contained if the text has at least ``containment`` of its distinct shingles of ``shingle``
    words; an item with fewer words is one shingle of all of them, and one without words is in no text.
    Items are the query set: they come to the tasks in blocks of bounded size, one pass over the
    documents per block; documents are not shuffled. Null texts contain nothing; items with a null id
    are looked for like others; repeated rows stay repeated.
    """
    sized = items.select(F.col("item_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    total = sized.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_CHARS))
    names = []
    for block in range(blocks):
        part = sized.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(blocks)) == block).distinct()
        chosen = [tuple(r) for r in part.collect()]  # about BLOCK_CHARS characters
        names.append(free_name(docs, f"{column}_{block}"))
        docs = _annotated(docs, names[-1], chosen, shingle, containment)
    return docs.withColumn(column, F.concat(*names)).drop(*names)


def _annotated(docs: DataFrame, column: str, items: list[tuple], shingle: int, containment: Fraction) -> DataFrame:
    hits = pa.list_(pa.struct([("item_id", pa.int64()), ("n_shingles", pa.int32()), ("n_found", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(items, shingle, containment)
        for batch in batches:
            found = pa.array([index.find(t.as_py()) for t in batch["text"]], hits)
            yield pa.record_batch([*batch.columns, found], [*batch.schema.names, column])

    return docs.mapInArrow(run, with_fields(docs.schema, **{column: HITS}))


def contaminations(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found): one row per document row and item contained in it."""
    found = with_hits(docs.select("doc_id", "text"), items, "hits", **options)
    return found.select("doc_id", F.explode("hits").alias("hit")).select("doc_id", "hit.*")


def drop_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that contain no item; columns as they are."""
    column = free_name(docs, "hits")
    return with_hits(docs, items, column, **options).where(F.size(column) == 0).select(*docs.columns)
