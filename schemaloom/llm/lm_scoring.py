"""Scores documents by the cross-entropy difference of a target and a background model."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemaloom.runtime import broadcast_if_small, materialise

#: Weight, in tokens, of the unigram model where a bigram model is asked.
SMOOTHING = 2.0
#: Words that a task counts before it hands the counts on.
COUNTED = 400_000
#: Words of documents whose pairs a task sorts at once; a longer document is taken whole.
BLOCK = 1 << 22
#: Documents in one row of a pair; a pair with more has more rows.
LISTED = 1 << 12
#: Pairs are worked off in so many parts by their hash, each with all its counts, to need less disk at once.
PARTS = 3
#: Target ids (8 bytes each) up to which they are broadcast.
BROADCAST_IDS = 1_000_000
#: Parts of the words in which ``packed_sums`` works, places of words that one bucket holds, and a task sorts at once.
WORD_PARTS, BUCKET, CHUNK = 2, 1 << 18, 1 << 20
#: Words with more places are dealt by their pairs.
HOT = BUCKET // 4
#: What a place of a word has: its document is in the target, a word follows, none stands before, its document has no id.
TARGET, FOLLOWED, FIRST, NO_ID = 1, 2, 4, 8
PLACED = "bucket int, second binary, size binary, key binary, doc binary, flags binary"
GAINED = "bucket int, doc binary, n binary, total binary, flags binary"
#: Stands before a document's first word; no word has a space.
START = np.uint64(xxhash.xxh64_intdigest(b" "))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def word_counts(marked: DataFrame) -> DataFrame:
    """(key, word, n, n_target): words, with their hash, of all documents and of the target's, summed per task
    before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())

        def rows() -> pa.RecordBatch:
            every, target = counts
            columns = [pa.array(hashes(every).view(np.int64)), pa.array(list(every), pa.binary())]
            columns += [pa.array(list(every.values()), pa.int64()), pa.array([target[w] for w in every], pa.int64())]
            every.clear()
            target.clear()
            return pa.record_batch(columns, ["key", "word", "n", "n_target"])

        for batch in batches:
            for text, target in zip(batch["text"], batch["target"].to_pylist()):
                found = words_of(text.as_py())
                counts[0].update(found)
                if target:
                    counts[1].update(found)
                if len(counts[0]) >= COUNTED:
                    yield rows()
        yield rows()

    parts = marked.mapInArrow(run, "key long, word binary, n long, n_target long")
    return parts.groupBy("key", "word").agg(F.sum("n").alias("n"), F.sum("n_target").alias("n_target"))


def hashes(words: Iterable[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64)


def pair_key(first: Column, second: Column) -> Column:
    """The hash of a pair from those of its words; ``pairs_of`` has the same in numpy."""
    return first.bitwiseXOR(F.shiftleft(second, 17).bitwiseOR(F.shiftrightunsigned(second, 47)))


def pairs_of(batch: pa.RecordBatch, part: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of (first, second, key, row), sorted by key: the words before and at each place of the texts, in one
    part of the pairs."""

    def block() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        every = np.concatenate(found)
        row = np.repeat(np.arange(at, at + len(found)), [len(x) for x in found])
        first, second = every[:-1], every[1:]
        key = first ^ (second << np.uint64(17) | second >> np.uint64(47))
        picked = np.flatnonzero((row[1:] == row[:-1]) & (key % np.uint64(PARTS) == part))
        picked = picked[np.argsort(key[picked])]
        return first[picked], second[picked], key[picked], row[1:][picked]

    found, size, at = [], 0, 0
    for text in batch["text"]:
        words = hashes(words_of(text.as_py()))
        found.append(np.concatenate([[START], words]))
        size += len(found[-1])
        if size >= BLOCK:
            yield block()
            at += len(found)
            found, size = [], 0
    if found:
        yield block()


def starts_of(key: np.ndarray) -> np.ndarray:
    """Where a sorted key begins."""
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)


def pair_counts(marked: DataFrame, part: int) -> DataFrame:
    """(first, second, n, n_target) of all documents' pairs in one part, summed per block before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = np.array(batch["target"].to_pylist(), np.int64)
            for first, second, key, row in pairs_of(batch, part):
                if not len(key):
                    continue
                at = starts_of(key)
                columns = [first[at].view(np.int64), second[at].view(np.int64), np.diff(at, append=len(key))]
                columns.append(np.add.reduceat(hit[row], at))
                yield pa.record_batch([pa.array(x) for x in columns], ["first", "second", "n", "n_target"])

    parts = marked.mapInArrow(run, "first long, second long, n long, n_target long")
    return parts.groupBy("first", "second").agg(F.sum("n").alias("n"), F.sum("n_target").alias("n_target"))


class Words:
    """The known words as a table (key, n, n_target), and sums over it."""

    def __init__(self, counted: DataFrame, size: int | None):
        counted = materialise(counted)
        totals = [F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "n_target")]
        self.total = counted.agg(*totals).first()
        known = counted if size is None else materialise(counted.orderBy(F.desc("n"), "word").limit(size))
        self.table = known.select("key", "n", "n_target")
        self.size, *inside = known.agg(F.count(F.lit(1)), *totals).first()
        #: Counts (background, target) of the unknown words together.
        self.rest = [a - b for a, b in zip(self.total, inside)]


def pair_gains(counts: DataFrame, words: Words, smoothing: float) -> DataFrame:
    """(key, pair_gain): the target's loss less the background's of the second word of a pair after the first."""
    first, second = words.table.toDF("first", "n1", "t1"), words.table.toDF("second", "n2", "t2")
    joined = counts.join(first, "first", "left").join(second, "second", "left")
    both = F.col("n1").isNotNull() & F.col("n2").isNotNull()
    chances = []
    for side, (pair, before, alone) in enumerate([("n", "n1", "n2"), ("n_target", "t1", "t2")]):
        one = (F.coalesce(alone, F.lit(words.rest[side])) + 1.0) / F.lit(float(words.total[side] + words.size + 1))
        two = (F.col(pair) + smoothing * one) / (F.col(before) + F.lit(smoothing))
        chances.append(F.when(both, two).otherwise(one))
    gain = F.log(chances[0]) - F.log(chances[1])
    return joined.select(pair_key(F.col("first"), F.col("second")).alias("key"), gain.alias("pair_gain"))


def pair_places(marked: DataFrame, part: int) -> DataFrame:
    """(key, docs): the doc_ids that have a pair of one part, as often as they have it, a row or more per block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["doc_id"].cast(pa.int64())
            for _, _, key, row in pairs_of(batch, part):
                if not len(key):
                    continue
                at = starts_of(key)
                sizes = np.diff(at, append=len(key))
                at = np.flatnonzero((np.arange(len(key)) - np.repeat(at, sizes)) % LISTED == 0)
                ends = pa.array(np.append(at, len(key)).astype(np.int32))
                docs = pa.ListArray.from_arrays(ends, ids.take(pa.array(row)))
                yield pa.record_batch([pa.array(key[at].view(np.int64)), docs], ["key", "docs"])

    return marked.mapInArrow(run, "key long, docs array<long>")


def packed(bucket: np.ndarray, **columns: np.ndarray) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """Columns sorted by bucket, cut where it changes."""
    at = starts_of(bucket)
    for start, end in zip(at, [*at[1:], len(bucket)]):
        yield int(bucket[start]), {n: c[start:end] for n, c in columns.items()}


def word_places(marked: DataFrame, part: int, buckets: int, hot: np.ndarray) -> DataFrame:
    """The places of the words of one part, packed by bucket: those of a word, or of a pair if its word is hot, are together."""

    def block(found: list[np.ndarray], ids: list[int], marks: list[int]) -> Iterator[pa.RecordBatch]:
        every = np.concatenate([*found, [START]])
        row = np.repeat(np.arange(len(found) + 1), [*(len(x) for x in found), 1])
        second, key = every[1:], every[:-1] ^ (every[1:] << np.uint64(17) | every[1:] >> np.uint64(47))
        at = np.flatnonzero(row[1:] == row[:-1])
        slot = second[at]
        if len(hot):
            slot = np.where(hot[np.minimum(np.searchsorted(hot, slot), len(hot) - 1)] == slot, key[at], slot)
        at, slot = (x[slot % np.uint64(WORD_PARTS) == part] for x in (at, slot))
        bucket = (slot >> np.uint64(20)) % np.uint64(buckets)
        order = np.argsort(bucket << np.uint64(40) | second[at] >> np.uint64(24))
        at, bucket = at[order], bucket[order]
        start = np.concatenate([[True], row[1:] != row[:-1]])[at]
        follows = np.concatenate([row[2:] == row[1:-1], [False]])[at]
        flags = np.array(marks, np.uint8)[row[at]] + FOLLOWED * follows.astype(np.uint8) + FIRST * start.astype(np.uint8)
        doc = np.array(ids, np.int64)[row[at]]
        for b, x in packed(bucket, second=second[at], key=key[at], doc=doc, flags=flags):
            begins = starts_of(x["second"])
            size = np.diff(begins, append=len(x["second"])).astype(np.uint32)
            values = [x["second"][begins], size, x["key"], x["doc"], x["flags"]]
            yield pa.record_batch([pa.array([b], pa.int32()), *(pa.array([v.tobytes()]) for v in values)], ["bucket", "second", "size", "key", "doc", "flags"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, ids, marks, size = [], [], [], 0
        for batch in batches:
            for text, doc, target in zip(batch["text"], batch["doc_id"].cast(pa.int64()).to_pylist(), batch["target"].to_pylist()):
                found.append(np.concatenate([[START], hashes(words_of(text.as_py()))]))
                ids.append(0 if doc is None else doc)
                marks.append(NO_ID if doc is None else TARGET * target)
                size += len(found[-1])
                if size >= BLOCK:
                    yield from block(found, ids, marks)
                    found, ids, marks, size = [], [], [], 0
        if found:
            yield from block(found, ids, marks)

    return marked.mapInArrow(run, PLACED).repartition("bucket").sortWithinPartitions("bucket")


def by_bucket(batches: Iterator[pa.RecordBatch], kinds: dict[str, type]) -> Iterator[list[dict[str, np.ndarray]]]:
    """The rows of each bucket, unpacked, in chunks of at least ``CHUNK`` places."""

    def joined() -> list[dict[str, np.ndarray]]:
        chunks, some, size = [], [], 0
        for x in held:
            some.append(x)
            size += len(x["flags"])
            if size >= CHUNK or x is held[-1]:
                chunks.append({n: np.concatenate([np.frombuffer(y[n], kind) for y in some]) for n, kind in kinds.items()})
                some, size = [], 0
        return chunks

    held, at = [], None
    for batch in batches:
        for i, bucket in enumerate(batch["bucket"].to_pylist()):
            if bucket != at and held:
                yield joined()
                held = []
            at = bucket
            held.append({n: batch[n][i].as_buffer() for n in kinds})
    if held:
        yield joined()


def counted_pairs(chunk: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
    """(key, second, first, n, n_target) of the pairs of a chunk, sorted by key."""
    second = np.repeat(chunk["second"], chunk["size"])
    order = np.argsort(chunk["key"])
    key = chunk["key"][order]
    at = starts_of(key)
    flags = chunk["flags"][order]
    target = np.add.reduceat((flags & TARGET).astype(np.int64), at)
    return key[at], second[order[at]], (flags[at] & FIRST) > 0, np.diff(at, append=len(key)), target


def packed_sums(marked: DataFrame, words: Words, smoothing: float, part: int) -> DataFrame:
    """(doc_id, n_words, total): the sums of the gains of one part's words over documents.

    A word stands once behind each of its places, so that a bucket with all its places has its count too. The gain of a pair is
    log(pair + s one) - log(before + s) on both sides; what depends on the word before alone is added where that word
    stands itself, if a word follows.
    """
    buckets = max(1, -(-words.total[0] // (BUCKET * WORD_PARTS)))
    rows = words.table.where(F.col("n") > HOT).collect()
    table = np.array([[r["key"], r["n"], r["n_target"]] for r in rows], np.int64).reshape(-1, 3)
    hot = table[:, 0].copy().view(np.uint64)
    order = np.argsort(hot)
    hot, hot_n = hot[order], table[order, 1:]
    above = [float(t + words.size + 1) for t in words.total]
    kinds = {"second": np.uint64, "size": np.uint32, "key": np.uint64, "doc": np.int64, "flags": np.uint8}

    def sums(doc: np.ndarray, no_id: np.ndarray, n: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.lexsort((doc, no_id)) if no_id.any() else np.argsort(doc)
        doc, no_id = doc[order], no_id[order]
        at = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (no_id[1:] != no_id[:-1])]))
        return doc[at], no_id[at], np.add.reduceat(n[order], at), np.add.reduceat(total[order], at)

    def gains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunks in by_bucket(batches, kinds):
            parts = [counted_pairs(c) for c in chunks]
            key, at, of = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_inverse=True)
            second, first = (np.concatenate([p[i] for p in parts])[at] for i in (1, 2))
            pair = [np.bincount(of, np.concatenate([p[i] for p in parts])) for i in (3, 4)]
            word, of = np.unique(second, return_inverse=True)
            alone = np.stack([np.bincount(of, p) for p in pair], axis=1)
            if len(hot):
                place = np.minimum(np.searchsorted(hot, word), len(hot) - 1)
                alone[hot[place] == word] = hot_n[place[hot[place] == word]]
            one = (alone + 1.0) / above
            two = np.stack(pair, axis=1) + smoothing * one[of]
            gain = np.log(np.where(first[:, None], one[of], two))
            gain = gain[:, 0] - gain[:, 1]
            before = np.log(alone + smoothing)
            before = (before[:, 1] - before[:, 0])[of]
            for c in chunks:
                at = np.searchsorted(key, c["key"])
                total = gain[at] + before[at] * ((c["flags"] & FOLLOWED) > 0)
                doc, no_id, n, total = sums(c["doc"], (c["flags"] & NO_ID) > 0, np.ones(len(at), np.int64), total)
                bucket = doc.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)
                bucket = bucket % np.uint64(buckets)
                order = np.argsort(bucket, kind="stable")
                columns = {"doc": doc, "n": n.astype(np.uint32), "total": total, "flags": no_id.astype(np.uint8)}
                out = list(packed(bucket[order], **{k: v[order] for k, v in columns.items()}))
                blobs = [pa.array([x[k].tobytes() for _, x in out], pa.binary()) for k in columns]
                yield pa.record_batch([pa.array([b for b, _ in out], pa.int32()), *blobs], ["bucket", *columns])

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunks in by_bucket(batches, {"doc": np.int64, "n": np.uint32, "total": np.float64, "flags": np.uint8}):
            for c in chunks:
                doc, no_id, n, total = sums(c["doc"], c["flags"] > 0, c["n"].astype(np.int64), c["total"])
                yield pa.record_batch([pa.array(doc, mask=no_id), pa.array(n), pa.array(total)], ["doc_id", "n_words", "total"])

    found = word_places(marked, part, buckets, hot).mapInArrow(gains, GAINED)
    return found.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(totals, "doc_id long, n_words long, total double")


def score(
    docs: DataFrame, target: DataFrame, vocabulary_size: int | None = None, smoothing: float = SMOOTHING
) -> DataFrame:
    """(doc_id, n_words, score): mean over words of the target's loss less the background's, per doc_id.

    The target model is counted over the rows of ``docs(doc_id, text)`` whose doc_id is in
    ``target(doc_id)``, the background over all rows; both are bigram models with the same words,
    smoothing and handling of unknown words, so that a low score means more like the target. All words
    and all pairs are counted and no word is unknown, unless a caller gives a ``vocabulary_size``: then all
    but so many words are one unknown word, and a pair with it is judged by the second word alone. So is a
    document's first word. Rows with one doc_id are parts of one document; rows without doc_id are one
    document, which is in no target. A document without words has score 0, as all have if the target is
    empty or unknown.

    Words and pairs are known by 64-bit hashes; the driver gets three sums and the words with more than ``HOT`` places. Places
    go as packed rows to buckets of words (see ``packed_sums``), and what they bring to buckets of documents. With a
    ``vocabulary_size``, or without smoothing, words and pairs are tables: pair counts are shuffled by pair and meet the counts of their words by joins; documents meet them as rows (pair, documents), again by
    pair, and only sums go on. A hot pair or word has one row per block or pair and is split by the join.
    """
    wanted = target.select("doc_id").where("doc_id is not null").distinct().withColumn("target", F.lit(True))
    marked = docs.select("doc_id", "text").join(broadcast_if_small(wanted, BROADCAST_IDS), "doc_id", "left")
    marked = marked.withColumn("target", F.coalesce("target", F.lit(False)))
    words = Words(word_counts(marked), vocabulary_size)
    sums = marked.select("doc_id", F.lit(0).cast("long").alias("n_words"), F.lit(0.0).alias("total"))
    plain = vocabulary_size is None and smoothing > 0
    for part in range(WORD_PARTS if plain else 0):
        sums = sums.unionByName(materialise(packed_sums(marked, words, smoothing, part)))
    for part in range(0 if plain else PARTS):
        model = materialise(pair_gains(pair_counts(marked, part), words, smoothing)).hint("shuffle_hash")
        found = pair_places(marked, part).join(model, "key").select(F.explode("docs").alias("doc_id"), "pair_gain")
        found = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_words"), F.sum("pair_gain").alias("total"))
        sums = sums.unionByName(materialise(found))
    sums = sums.groupBy("doc_id").agg(F.sum("n_words").alias("n_words"), F.sum("total").alias("total"))
    alike = (F.col("n_words") == 0) | F.lit(not words.total[1])
    return sums.select("doc_id", "n_words", F.when(alike, 0.0).otherwise(F.col("total") / F.col("n_words")).alias("score"))
