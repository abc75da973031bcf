"""Joins documents whose sets of word n-grams are alike, by prefixes under several global token orders.

Two sets of a Jaccard similarity of at least ``percent`` / 100 share a token among the first few of each
under *every* order of all tokens. A set that has as many tokens of its own as the prefix is long has no such
token once those are put first, and goes; a share of all tokens, below a bound of their hash, tells this of most
sets. What is left is ordered three times, each time rare tokens first and then
by another hash; pairs come from the lists of the first order and must pass the others before they are verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemaloom.llm.common import connected_components, with_fields
from schemaloom.runtime import broadcast_if_small, materialise

SHINGLE = 3
PERCENT = 90
#: Shares of all tokens, by hash, that are looked at first, and then of the sets that are left.
SHARES = (0.2, 0.6)
#: Orders whose prefixes a pair must share, the one behind the lists included.
ORDERS = 3
#: Bits of a set's parities, and of the mask of a prefix.
BITS = 256
#: Sets of a list that are compared in one go; a longer list is dealt to tiles, which meet in pairs.
TILE = 2048
#: Rows (16 bytes each) of sets that may have a similar one, up to which they are broadcast to find their texts.
BROADCAST_KEYS = 2_000_000
#: Words whose hashes a worker keeps, and texts that leave it at once.
KEPT = 400_000
TEXTS = 256


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def tokens_of(text: str | None, hashes: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text (A-Z lower-cased).

    Fewer words than ``size`` are one shingle, none are none.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    found = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(size, len(found))
    total = np.full(len(found) - width + 1, width, np.uint64)
    for i in range(width):
        total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + found[i : len(found) - width + 1 + i])
    return np.unique(total)


def prefix_length(n, percent: int):
    """Tokens of a set of ``n`` of which a similar set must have at least one, for ints, arrays and SQL."""
    return n - (percent * n + 99) // 100 + 1


def partnered(n, percent: int):
    """Whether a set of ``n`` can be similar to a different one at all."""
    return 100 * n >= percent * (n + 1)


def prefix_column(n: Column, percent: int) -> Column:
    return n - F.ceil(n * percent / 100) + 1


def lists(values: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *(len(v) for v in values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*values, np.empty(0, np.int64)]).view(np.int64)))


def with_sets(docs: DataFrame, size: int, percent: int, names: tuple, whole: bool) -> DataFrame:
    """``docs`` without ``text`` but with the hash of its set, the set's size and the tokens: all if ``whole``, else
    the first share of those of sets that can have a similar one, once per set and batch."""
    bound = np.uint64(int(SHARES[0] * 2**32) << 32)
    rest = [f for f in docs.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for many in batches:
            seen: set[int] = set()
            for at in range(0, many.num_rows, TEXTS):
                batch = many.slice(at, TEXTS)
                keys, sizes, tokens = [], [], []
                for text in batch["text"]:
                    found = tokens_of(text.as_py(), hashes, size)
                    key = xxhash.xxh64_intdigest(found.view(np.uint8)) - (1 << 63)
                    keys.append(key)
                    sizes.append(len(found))
                    if not whole:
                        useless = key in seen or not partnered(len(found), percent)
                        found = found[: 0 if useless else np.searchsorted(found, bound)]
                        seen.add(key)
                    tokens.append(found.view(np.int64))
                columns = [batch[f.name] for f in rest]
                columns += [pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), lists(tokens)]
                yield pa.record_batch(columns, [*(f.name for f in rest), *names])

    kinds = dict(zip(names, ["long", "long", "array<long>"]))
    return docs.mapInArrow(run, with_fields(type(docs.schema)(rest), **kinds))


def hopeful(marked: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Those of ``classes(s, n, ...)`` that may have a similar set: fewer of the tokens in ``head`` are theirs alone than the
    prefix is long. A token's sets are not gathered; the least and the greatest of them tell."""
    tokens = marked.select("s", F.explode("head").alias("token"))  # map-side, a task's copies of a set are one
    alone = tokens.groupBy("token").agg(F.min("s").alias("s"), F.max("s").alias("last")).where("s = last")
    alone = alone.groupBy("s").agg(F.count(F.lit(1)).alias("alone"))
    found = classes.where(partnered(F.col("n"), percent)).join(alone, "s", "left")
    return found.where(F.coalesce("alone", F.lit(0)) < prefix_column(F.col("n"), percent)).drop("alone")


def shared_tokens(sets: DataFrame, percent: int) -> DataFrame:
    """(s, n, shared): the tokens of each set that another one has too, with the number of sets; sets with too many
    tokens of their own are out."""
    rows = sets.select("s", "n", F.explode("tokens").alias("token"))
    counts = rows.groupBy("token").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1")
    shared = rows.join(counts, "token").groupBy("s", "n").agg(F.collect_list(F.struct("sets", "token")).alias("shared"))
    return shared.where(F.col("n") - F.size("shared") < prefix_column(F.col("n"), percent))


def prefixes(shared: DataFrame, percent: int) -> DataFrame:
    """(token, s, n, c, parity, masks): a row per token of a set's prefix under the first order.

    ``c`` counts the shared tokens and ``parity`` has their number modulo 2 by hash; ``masks`` mark the prefixes
    under the other orders. Tokens of one set alone stand first in every order and need no row.
    """
    schema = "s long, n long, c long, parity binary, masks binary, prefix array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch["n"].to_numpy()
            c, parity, masks, first = [], [], [], []
            for size, row in zip(n.tolist(), batch["shared"]):
                sets, token = (x.to_numpy() for x in row.values.flatten())
                token = token.view(np.uint64)
                left = prefix_length(size, percent) - (size - len(token))
                c.append(len(token))
                bits = np.bincount(mixed(token ^ np.uint64(11)) % np.uint64(BITS), minlength=BITS) & 1
                parity.append(np.packbits(bits.astype(np.uint8)).tobytes())
                parts = []
                for order in range(ORDERS):
                    rare = np.frexp(sets)[1] // order if order else sets
                    chosen = token[np.lexsort((mixed(token + np.uint64(order)), rare))[:left]]
                    if not order:
                        first.append(chosen.view(np.int64))
                        continue
                    mask = np.zeros(BITS, np.uint8)
                    mask[mixed(chosen ^ np.uint64(13)) % np.uint64(BITS)] = 1
                    parts.append(np.packbits(mask).tobytes())
                masks.append(b"".join(parts))
            columns = [batch["s"], batch["n"], pa.array(c, pa.int64()), pa.array(parity), pa.array(masks), lists(first)]
            yield pa.record_batch(columns, ["s", "n", "c", "parity", "masks", "prefix"])

    found = shared.mapInArrow(run, schema)
    return found.select(F.explode("prefix").alias("token"), "s", "n", "c", "parity", "masks")


class Tile:
    """The sets of a list column, or some of them, as arrays."""

    def __init__(self, rows: pa.StructArray | None):
        if rows is None:
            return
        s, n, c, parity, masks, label = rows.flatten()
        self.s, self.n, self.c, self.label = (x.to_numpy() for x in (s, n, c, label))
        words = BITS // 64
        self.parity = np.frombuffer(b"".join(parity.to_pylist()), np.uint64).reshape(len(s), words)
        self.masks = np.frombuffer(b"".join(masks.to_pylist()), np.uint64).reshape(len(s), ORDERS - 1, words)

    def part(self, start: int, stop: int) -> Tile:
        tile = Tile(None)
        tile.__dict__ = {k: v[start:stop] for k, v in self.__dict__.items()}
        return tile


def candidates(a: Tile, b: Tile, same: bool, all_pairs: bool, percent: int) -> list[tuple[int, int]]:
    """Pairs between two tiles (or within one) of different labels that may be similar by sizes, shared tokens,
    parities and the prefixes of all orders; if not ``all_pairs``, only as many as connect what they connect."""
    _, label = np.unique(np.append(a.label, b.label), return_inverse=True)
    own = label[: len(a.s)]
    other = own if same else label[len(a.s) :]
    out = []
    for i in range(len(a.s)):
        j = np.flatnonzero(other != own[i])
        if same:
            j = j[j > i]
        n = a.n[i] + b.n[j]
        c = np.minimum(a.c[i], b.c[j])
        j = j[((100 + percent) * c >= percent * n) & (100 * np.minimum(a.n[i], b.n[j]) >= percent * np.maximum(a.n[i], b.n[j]))]
        if len(j):
            apart = np.bitwise_count(a.parity[i] ^ b.parity[j]).sum(axis=1, dtype=np.int64)
            most = a.c[i] + b.c[j] - apart
            fits = (100 + percent) * most >= 2 * percent * (a.n[i] + b.n[j])
            j = j[fits & (a.masks[i] & b.masks[j]).any(axis=2).all(axis=1)]
        if len(j) and not all_pairs:
            groups, first = np.unique(other[j], return_index=True)
            j = j[first]
            label[np.isin(label, groups)] = own[i]  # own and other are parts of label
        out += zip([int(a.s[i])] * len(j), b.s[j].tolist())
    return out


def candidate_pairs(rows: DataFrame, all_pairs: bool, percent: int, tile: int) -> DataFrame:
    """Distinct (u, v) from rows (token, s, n, c, parity, masks, label) of the lists; those of one label alone are out.

    A long list is dealt to tiles by hash, and each pair of its tiles is one row, so that no list is held whole.
    """
    counts = rows.groupBy("token").agg(
        F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("parts"), F.min("label").alias("a"), F.max("label").alias("b")
    )
    counts = counts.where("a <> b").select("token", "parts")
    dealt = rows.join(counts, "token").withColumn("p", F.pmod(F.xxhash64("s"), "parts").cast("int"))
    member = F.struct("s", "n", "c", "parity", "masks", "label")
    tiles = materialise(
        dealt.groupBy("token", "parts", "p").agg(F.sort_array(F.collect_list(member)).alias("x"))
    )
    empty = F.slice("x", 1, 0)
    alone = tiles.select("x", empty.alias("y"), F.lit(True).alias("same"))
    long = tiles.where("parts > 1")
    left = long.select("token", "p", "x")
    right = long.where("p > 0").select("token", F.col("x").alias("y"), F.explode(F.expr("sequence(0, p - 1)")).alias("p"))
    both = left.join(right, ["token", "p"]).select("x", "y", F.lit(False).alias("same"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int]] = []
            every = [Tile(batch[c].flatten()) for c in ("x", "y")]
            ends = [np.cumsum([0, *pc.list_value_length(batch[c]).to_pylist()]).tolist() for c in ("x", "y")]
            for i, same in enumerate(batch["same"].to_pylist()):
                a, b = (t.part(e[i], e[i + 1]) for t, e in zip(every, ends))
                found += candidates(a, a if same else b, same, all_pairs, percent)
            if found:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found)], ["u", "v"])

    pairs = alone.union(both).mapInArrow(run, "u long, v long")
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets have the similarity, by their whole sets."""
    one = sets.select(F.col("s").alias("u"), F.col("tokens").alias("x"))
    two = sets.select(F.col("s").alias("v"), F.col("tokens").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    near = (100 + percent) * common >= percent * (F.size("x") + F.size("y"))
    return pairs.join(one, "u").join(two, "v").where(near).select("u", "v")


def groups(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, tile: int = TILE) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of ``docs(doc_id, text)``.

    Rows link when ``100 * intersection >= percent * union`` of their sets of distinct shingles (of 64-bit
    hashes); component_id is the smallest doc_id that links reach. Rows without words (null and empty texts too)
    have the size 0, link with nothing and keep their own doc_id. Equal sets always link. Repeated rows stay
    repeated; a null doc_id takes part but is never the smallest, and stands alone as null. No rows, no rows.

    Links are searched twice. First a list gives only as many candidates as connect it, so that a
    large group of near copies costs a row per copy; then, with the links that held, all candidates between
    different components. So no link is lost that joins components.
    """
    named = docs.select("doc_id", "text", F.xxhash64("text").alias("key"))
    marked = materialise(with_sets(named, size, percent, ("s", "n", "head"), False))
    lowest = [F.min("doc_id").alias("low"), F.max("n").alias("n"), F.min(F.struct("key", "doc_id")).alias("row")]
    classes = materialise(marked.where("n > 0").groupBy("s").agg(*lowest))
    kept = hopeful(marked, classes, percent)
    kept = materialise(kept.select(F.col("row.key").alias("kept_key"), F.col("row.doc_id").alias("kept_id")))
    one = (F.col("key") == F.col("kept_key")) & F.col("doc_id").eqNullSafe(F.col("kept_id"))
    texts = named.join(broadcast_if_small(kept, BROADCAST_KEYS), one, "left_semi").select("text")
    sets = materialise(with_sets(texts, size, percent, ("s", "n", "tokens"), True).dropDuplicates(["s"]))
    below = int(SHARES[1] * 2**32)
    longer = sets.select("s", F.filter("tokens", lambda x: F.shiftrightunsigned(x, 32) < below).alias("head"))
    shared = shared_tokens(hopeful(longer, sets, percent), percent)
    rows = materialise(prefixes(shared, percent))

    first = candidate_pairs(rows.withColumn("label", F.col("s")), False, percent, tile)
    links = materialise(verified(first, sets, percent))
    labels = connected_components(links).select(F.col("node").alias("s"), "label")
    again = rows.join(labels, "s", "left").withColumn("label", F.coalesce("label", "s"))
    more = materialise(verified(candidate_pairs(again, True, percent, tile), sets, percent))
    if more.take(1):
        labels = connected_components(links.union(more)).select(F.col("node").alias("s"), "label")

    known = classes.select("s", "low").join(labels, "s", "left").withColumn("label", F.coalesce("label", "s"))
    lowest = known.groupBy("label").agg(F.min("low").alias("first"))
    known = known.join(lowest, "label").select("s", F.col("first").alias("component_id"))
    alone = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return marked.join(known, "s", "left").select("doc_id", F.col("n").alias("n_shingles"), alone.alias("component_id"))
