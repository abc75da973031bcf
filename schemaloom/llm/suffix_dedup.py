"""Removes byte strings that repeat across documents, by external induced suffix sorting of shards.

All occurrences of a repeated string must meet in one shard. Every window of LENGTH bytes has an
anchor, the least hash of its GRAM-byte pieces, which depends on the window's bytes alone; windows in a
row with one anchor make a stretch, and stretches are dealt out by anchor. Anchors that only one text
has cannot hold a repeat and go no further. The distinct stretches of an anchor, each with the smallest
document that has it, are suffix-sorted; windows next to each other with LENGTH common bytes are equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schemaloom.llm.induced_sort import Scratch, sorted_suffixes
from schemaloom.runtime import materialise

LENGTH = 50
GRAM = 20
#: Bytes whose anchors are found at once; a longer text is taken whole.
CHUNK = 1 << 17
#: A stretch is cut after so many windows; its parts keep the anchor.
STRETCH = 256
#: Bytes of stretches that make a shard, so few that its arrays stay near the processor; a single anchor may have more.
SHARD = 1 << 21
#: Bytes of texts whose anchors make a bucket; the anchors of a bucket that only one text has are held by its task.
BUCKET = 1 << 22
#: Rows that are dealt to buckets, or looked through for shared anchors, at once.
FOLD = 1 << 19
#: Stretches in one packed row, so few that a batch of packed rows stays small.
PACKED = 1 << 9
ROW = np.dtype([("anchor", "<i8"), ("t", "<i8"), ("at", "<i4"), ("windows", "<i4")])

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def rolling_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each run of ``gram`` bytes, built from halves by doubling."""
    def power(n: int) -> np.uint64:
        return np.uint64(pow(int(MULTIPLIER), n, 1 << 64))

    n = len(data) - gram + 1
    level = data.astype(np.uint64) + np.uint64(1)
    total, done, size = None, 0, 1
    while True:
        if gram & size:
            part = level[done : done + n]
            total = part.copy() if total is None else total * power(size) + part
            done += size
        if size * 2 > gram:
            break
        level = level[: len(level) - size] * power(size) + level[size:]
        size *= 2
    total ^= total >> np.uint64(29)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    total ^= total >> np.uint64(32)
    return total


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    size, level = 1, values
    while size * 2 <= width:
        level = np.minimum(level[: len(level) - size], level[size:])
        size *= 2
    n = len(values) - width + 1
    return np.minimum(level[:n], level[width - size : width - size + n])


def stretches(texts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text number, first window, windows, anchor) of all stretches of the texts, in order."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < length:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    ends = np.cumsum(sizes)
    anchors = sliding_minimum(rolling_hashes(data, gram), length - gram + 1)
    inside = np.zeros(len(data) + 1, np.int64)  # windows that lie in one text
    many = sizes >= length
    np.add.at(inside, (ends - sizes)[many], 1)
    np.add.at(inside, (ends - length + 1)[many], -1)
    good = np.cumsum(inside)[: len(anchors)] > 0
    places = np.flatnonzero(good)
    if not len(places):
        return tuple(np.empty(0, np.int64) for _ in range(4))
    owner = np.searchsorted(ends, places, "right")
    new = np.ones(len(places), bool)
    new[1:] = (anchors[places[1:]] != anchors[places[:-1]]) | (owner[1:] != owner[:-1])
    begin = np.flatnonzero(new)
    windows = np.diff(np.append(begin, len(places)))
    if windows.max() > STRETCH:
        parts = -(-windows // STRETCH)
        step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        begin, whole = np.repeat(begin, parts) + step * STRETCH, np.repeat(windows, parts)
        windows = np.minimum(whole - step * STRETCH, STRETCH)
    at = places[begin]
    doc = owner[begin]
    return doc, at - (ends - sizes)[doc], windows, anchors[at].view(np.int64)


def by_chunks(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    start = held = 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= CHUNK:
            yield start, texts[start : i + 1]
            start, held = i + 1, 0
    if start < len(texts):
        yield start, texts[start:]


def anchor_rows(identified: DataFrame, length: int, gram: int, buckets: int) -> DataFrame:
    """(bucket, rows): the stretches of each text as packed rows of ``ROW``, dealt to buckets by their anchor; a text
    that a batch repeats counts once."""

    def packed(rows: np.ndarray) -> pa.RecordBatch:
        bucket = (rows["anchor"].view(np.uint64) & np.uint64(0xFFFFFFFF)).astype(np.int64) % buckets
        order = np.argsort(bucket, kind="stable")
        bucket, rows = bucket[order], rows[order]
        place = np.arange(len(rows))
        begin = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        inside = place - np.repeat(begin, np.diff(np.append(begin, len(rows))))
        cut = np.flatnonzero(inside % PACKED == 0)
        ends = pa.py_buffer((np.append(cut, len(rows)) * ROW.itemsize).astype(np.int32))
        blobs = pa.Array.from_buffers(pa.binary(), len(cut), [None, ends, pa.py_buffer(rows.tobytes())])
        return pa.record_batch([pa.array(bucket[cut].astype(np.int32)), blobs], ["bucket", "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, first = np.unique(batch["t"].to_numpy(zero_copy_only=False), return_index=True)
            first.sort()
            texts = [t.encode() for t in batch["text"].take(pa.array(first)).to_pylist()]
            keys = batch["t"].to_numpy(zero_copy_only=False)[first]
            held, size = [], 0
            for start, part in by_chunks(texts):
                doc, at, windows, anchor = stretches(part, length, gram)
                rows = np.empty(len(doc), ROW)
                rows["anchor"], rows["t"], rows["at"], rows["windows"] = anchor, keys[start + doc], at, windows
                held.append(rows)
                size += len(rows)
                if size >= FOLD:
                    yield packed(np.concatenate(held))
                    held, size = [], 0
            if size:
                yield packed(np.concatenate(held))

    return identified.select("t", "text").mapInArrow(run, "bucket int, rows binary")


def shared_anchors(packed: DataFrame, fold: int) -> DataFrame:
    """(anchor, t, at, windows) of the stretches whose anchor at least two texts have.

    Packed rows arrive sorted by bucket. Of a bucket only the rows of anchors that one text alone has so far are
    held, besides ``fold`` rows or as many as are held; once a second text is met, an anchor's rows go on, so a
    hot anchor streams by.
    """

    def settle(rows: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows to go on, rows still of one text, and all anchors known to be shared."""
        rows = rows[np.argsort(rows["anchor"])]
        anchor = rows["anchor"]
        begin = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
        each = anchor[begin]
        mixed = np.minimum.reduceat(rows["t"], begin) != np.maximum.reduceat(rows["t"], begin)
        if len(shared):
            mixed |= shared[np.minimum(np.searchsorted(shared, each), len(shared) - 1)] == each
        go = np.repeat(mixed, np.diff(np.append(begin, len(rows))))
        return rows[go], rows[~go], np.union1d(shared, each[mixed])

    def batch_of(rows: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(np.ascontiguousarray(rows[n])) for n in ROW.names], list(ROW.names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, single, shared = None, np.empty(0, ROW), np.empty(0, np.int64)
        parts: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for bucket, blob in zip(batch["bucket"].to_pylist(), batch["rows"]):
                if parts and (bucket != now or size >= max(fold, len(single))):
                    go, single, shared = settle(np.concatenate([single, *parts]), shared)
                    parts, size = [], 0
                    if len(go):
                        yield batch_of(go)
                if bucket != now:
                    now, single, shared = bucket, np.empty(0, ROW), np.empty(0, np.int64)
                parts.append(np.frombuffer(blob.as_buffer(), ROW))
                size += len(parts[-1])
        if parts:
            go, _, _ = settle(np.concatenate([single, *parts]), shared)
            if len(go):
                yield batch_of(go)

    return packed.mapInArrow(run, "anchor long, t long, at int, windows int")


def cut_stretches(spans: DataFrame, length: int) -> DataFrame:
    """(anchor, doc_id, t, at, bytes) from rows (doc_id, t, text, spans of anchor, at and windows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "doc_id", "t", "at", "bytes"]
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                lists = part["spans"]
                values = lists.flatten()
                anchor, at, windows = (values.field(n) for n in ("anchor", "at", "windows"))
                owner = lists.value_parent_indices().to_numpy(zero_copy_only=False)
                texts = [t.encode() for t in part["text"].to_pylist()]
                cut = [
                    texts[d][a : a + w + length - 1]
                    for d, a, w in zip(owner.tolist(), at.to_pylist(), windows.to_pylist())
                ]
                take = pa.array(owner)
                yield pa.record_batch(
                    [anchor, part["doc_id"].take(take), part["t"].take(take), at, pa.array(cut, pa.binary())], names
                )

    return spans.mapInArrow(run, "anchor long, doc_id long, t long, at int, bytes binary")


def first_owners(texts: list[bytes], firsts: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text, from, to, first): for runs of windows of a shard's texts, the smallest first of any equal window."""
    sizes = np.array([len(t) for t in texts], np.int64) + 1
    data = np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8)  # 255 is in no UTF-8 text
    ends = np.cumsum(sizes)
    with Scratch() as scratch:
        order, prefix = sorted_suffixes(data, length, scratch)
        owner = np.repeat(np.arange(len(texts)), sizes)
        whole = ends[owner[order]] - 1 - order >= length
        group = np.cumsum(prefix < length)[whole]
        order = order[whole]
        begin = np.flatnonzero(np.diff(group, prepend=-1))
        least = np.minimum.reduceat(firsts[owner[order]], begin)
        found = np.empty(len(data), np.int64)
        found[order] = np.repeat(least, np.diff(np.append(begin, len(order))))
    places = np.sort(order)
    doc, value = owner[places], found[places]
    new = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])))
    starts = (ends - sizes)[doc[new]]
    stop = np.append(new[1:], len(places)) - 1
    return doc[new], places[new] - starts, places[stop] - starts + 1, value[new]


def sort_shards(strings: DataFrame, length: int, shard: int) -> DataFrame:
    """(s1, s2, from, to, first) for the distinct stretches ``strings(anchor, s1, s2, bytes, first)``.

    Rows arrive sorted by anchor; a shard takes whole anchors, and those with one stretch need no sort. Beyond the sort's bound in memory, its
    queues and arrays are on the task's disk.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["s1", "s2", "from", "to", "first"]

        def settle(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            whole = pa.Table.from_batches(parts)
            anchors = whole["anchor"].to_numpy()
            same = np.append(anchors[1:] == anchors[:-1], False)
            alone = np.flatnonzero(~(same | np.append(False, same[:-1])))  # nothing to compare with
            sizes = pc.binary_length(whole["bytes"]).to_numpy()[alone]
            s1, s2, first = (whole[n].to_numpy() for n in ("s1", "s2", "first"))
            rows, a, b, least = alone, np.zeros(len(alone), np.int64), sizes - length + 1, first[alone]
            more = np.flatnonzero(same | np.append(False, same[:-1]))
            if len(more):
                doc, c, d, found = first_owners(whole["bytes"].take(pa.array(more)).to_pylist(), first[more], length)
                rows, least = np.append(rows, more[doc]), np.append(least, found)
                a, b = np.append(a, c), np.append(b, d)
            columns = (s1[rows], s2[rows], a.astype(np.int32), b.astype(np.int32), least)
            return pa.record_batch([pa.array(x) for x in columns], names)

        parts: list[pa.RecordBatch] = []
        held, anchor = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            a = batch["anchor"].to_numpy(zero_copy_only=False)
            size = np.append(0, np.cumsum(pc.binary_length(batch["bytes"]).to_numpy(zero_copy_only=False)))
            start = 0
            for at in np.flatnonzero(np.append(a[0] != anchor, a[1:] != a[:-1])).tolist():
                if held + size[at] - size[start] >= shard:
                    yield settle([*parts, batch.slice(start, at - start)])
                    parts, held, start = [], 0, at
            parts.append(batch.slice(start))
            held += int(size[-1] - size[start])
            anchor = a[-1]
        if parts:
            yield settle(parts)

    return strings.mapInArrow(run, "s1 long, s2 long, `from` int, `to` int, first long")


def merged_spans(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted((s["start"], s["end"]) for s in spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def cut_out(rows: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, kept, spans) from rows (doc_id, text, cuts): spans are merged, kept is the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            sizes, kept, spans = [], [], []
            for text, cuts in zip(batch["text"], batch["cuts"]):
                data = text.as_py().encode()
                found = merged_spans(cuts.as_py() or [])
                ends = [0, *(e for _, e in found)]
                starts = [*(s for s, _ in found), len(data)]
                sizes.append(len(data))
                kept.append(b"".join(data[a:b] for a, b in zip(ends, starts)) if found else data)
                spans.append([{"start": a, "end": b} for a, b in found])
            yield pa.record_batch(
                [batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, span)],
                ["doc_id", "n_bytes", "kept", "spans"],
            )

    return rows.mapInArrow(run, "doc_id long, n_bytes long, kept binary, spans array<struct<start: int, end: int>>")


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard: int = SHARD, bucket: int = BUCKET, fold: int = FOLD
) -> DataFrame:
    """(doc_id, n_bytes, kept, spans) of each row of ``docs(doc_id, text)``.

    Each byte covered by a string of ``length`` bytes that also starts in a document with a smaller
    doc_id goes; ``kept`` is what stays, ``spans`` the removed runs. Strings are judged on the input, as
    UTF-8 bytes; a null text is empty. Copies of a text need no sort: all but those with the smallest
    doc_id go whole if they have ``length`` bytes. Rows without doc_id neither lose bytes nor make
    others lose any. Repeated rows stay repeated and do not cut each other, as their ids are equal.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    named = docs.select("doc_id", text.alias("text"))
    named = named.withColumns({"t": F.xxhash64("text"), "t2": F.xxhash64("text", F.lit("second"))})
    long = named.where((F.octet_length("text") >= length) & F.col("doc_id").isNotNull())
    ids = materialise(long.select("doc_id", "t", "t2", F.octet_length("text").alias("n")).distinct())
    owners = ids.groupBy("t", "t2").agg(F.min("doc_id").alias("first"))

    buckets = (ids.agg(F.sum("n")).first()[0] or 0) // bucket + 1
    rows = anchor_rows(long, length, gram, buckets).repartition("bucket").sortWithinPartitions("bucket")
    spans = shared_anchors(rows, fold).groupBy("t").agg(F.collect_list(F.struct("anchor", "at", "windows")).alias("spans"))
    spans = materialise(spans.join(owners, "t").select(F.col("first").alias("doc_id"), "t", "spans"))
    found = materialise(cut_stretches(long.select("doc_id", "t", "text").join(spans, ["doc_id", "t"]), length))
    strings = found.groupBy("anchor", "bytes").agg(F.min("doc_id").alias("first"))
    name = {"s1": F.xxhash64("bytes"), "s2": F.xxhash64("bytes", F.lit("second"))}
    strings = strings.withColumns(name).repartition("anchor").sortWithinPartitions("anchor")
    owned = materialise(sort_shards(strings, length, shard))
    repeats = found.withColumns(name).select("s1", "s2", "doc_id", "t", "at").join(owned, ["s1", "s2"])
    repeats = repeats.where("first < doc_id").select(
        "doc_id", "t", F.expr("at + `from`").alias("start"), F.expr(f"at + `to` - 1 + {length}").alias("end")
    )
    copies = ids.join(owners, ["t", "t2"]).where("doc_id > first").select("doc_id", "t", F.lit(0), "n")
    cuts = repeats.union(copies).groupBy("doc_id", "t").agg(F.collect_list(F.struct("start", "end")).alias("cuts"))
    return cut_out(named.select("doc_id", "t", "text").join(materialise(cuts), ["doc_id", "t"], "left"))
