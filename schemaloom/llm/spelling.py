"""Groups spelling variants: words one edit apart, found by a frontier of states over a trie that is a table.

The trie is cut down to nodes that branch or end a word; an edge carries the letters up to the next one. Words that
differ by one edit part at a branching node of either's own path, so the states without an edit are the nodes
of a word's path, and those with one start at its siblings (a replaced letter) or at the edge of the letter after next (a
deleted one). An edit in the second half of a word is looked for in the trie of the words, one in the first half
in the trie of the reversed words, so that no state starts near a root, where all words meet.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemaloom.runtime import materialise

#: Code points that a word has at least, and its least occurrences over all documents.
LEAST_LENGTH = 7
LEAST_COUNT = 2
#: A near word is a word's form if it is so many times as frequent.
FACTOR = 10
#: Words that a task counts before it hands the counts on.
COUNTED = 300_000
#: Lengths that an edge tells apart; longer words share a bit.
LENGTHS = 62


def letters(least: int) -> re.Pattern:
    """Maximal runs of at least ``least`` letters a-z and U+00C0 to U+00FF, in UTF-8 after A-Z were lower-cased."""
    return re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf]){%d,}" % least)


def words_of(doc_id, text: str | None, pattern: re.Pattern, least: int, damage: int | None) -> Counter:
    """Runs of a text with their counts. With ``damage``, a run loses the code point crc32 % length where ``damage`` divides the
    crc32 of ``<doc_id>:<run>``; a null doc_id is empty there."""
    found = Counter(pattern.findall((text or "").encode().lower()))
    if not damage:
        return found
    out: Counter = Counter()
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in found.items():
        h = zlib.crc32(run, start)
        if h % damage == 0:
            word = run.decode()
            at = h % len(word)
            run = (word[:at] + word[at + 1 :]).encode()
            if len(word) <= least:
                continue
        out[run] += n
    return out


def word_counts(
    docs: DataFrame, least: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, damage: int | None = None
) -> DataFrame:
    """(word, n) of ``docs(doc_id, text)``: words of at least ``least`` code points that occur ``least_count`` times, summed
    per task before the shuffle. Null and empty texts have none."""
    pattern = letters(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def rows() -> pa.RecordBatch:
            words = pa.array(list(counts), pa.binary()).cast(pa.string())
            out = pa.record_batch([words, pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                counts.update(words_of(doc_id, text.as_py(), pattern, least, damage))
                if len(counts) >= COUNTED:
                    yield rows()
        yield rows()

    parts = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def path_rows(words: DataFrame) -> DataFrame:
    """(w, back, depth, node, c): the nodes of each word's path from its middle on, in the trie of the words and, with the
    word reversed, in that of the reversed ones.

    A node is a 64-bit hash of the letters up to it, ``c`` the next letter or -1 at the word's end.
    """

    def rows(texts: list[str], back: bool) -> pa.RecordBatch:
        code = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
        n = np.array([len(t) for t in texts], np.int64)
        start = np.cumsum(n) - n
        place = np.arange(len(code)) - np.repeat(start, n)
        salt = np.uint64(0x9E3779B97F4A7C15 if back else 0xD1B54A32D192ED03)
        each = mixed((place.astype(np.uint64) << np.uint64(24) ^ code.astype(np.uint64)) * salt + salt)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(each)])
        half = (n + 1) // 2 if back else n // 2
        many = n - half + 1
        owner = np.repeat(np.arange(len(n)), many)
        depth = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many) + half[owner]
        node = mixed((total[start[owner] + depth] - total[start[owner]]) ^ salt)
        c = np.append(code, -1)[start[owner] + depth]
        c[depth == n[owner]] = -1
        columns = [pa.array(texts, pa.string()).take(pa.array(owner)), pa.array(np.full(len(owner), back))]
        columns += [pa.array(depth.astype(np.int32)), pa.array(node.view(np.int64)), pa.array(c.astype(np.int32))]
        return pa.record_batch(columns, ["w", "back", "depth", "node", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["word"].to_pylist()
            if texts:
                yield rows(texts, False)
                yield rows([t[::-1] for t in texts], True)

    return words.select("word").mapInArrow(run, "w string, back boolean, depth int, node long, c int")


def bit(length: Column) -> Column:
    """The bit of a word length in an edge's ``lengths``."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.least(length, F.lit(LENGTHS)).cast("int"))


def has_bit(lengths: Column, length: Column) -> Column:
    return F.call_function("shiftright", lengths, F.least(length, F.lit(LENGTHS)).cast("int")).bitwiseAND(1) == 1


def steps_of(rows: DataFrame) -> DataFrame:
    """(w, back, steps): the nodes (depth, node, c, terminal) of each path where words part or one ends, in order."""
    kept = rows.groupBy("node").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high or low = -1")
    kept = kept.select("node", (F.col("low") == -1).alias("terminal"))
    step = F.struct("depth", "node", "c", "terminal")
    return rows.join(kept, "node").groupBy("w", "back").agg(F.sort_array(F.collect_list(step)).alias("steps"))


def edges_of(steps: DataFrame) -> DataFrame:
    """(node, c, label, child, child_ends, lengths): the trie as a table, one row per edge, with the lengths of the
    words below it."""
    pairs = F.expr("transform(sequence(0, size(steps) - 2), i -> struct(steps[i] as a, steps[i + 1] as b))")
    found = steps.where(F.size("steps") > 1).select("w", F.explode(pairs).alias("e"))
    found = found.select(
        F.col("e.a.node").alias("node"),
        F.col("e.a.c").alias("c"),
        F.expr("substring(w, e.a.depth + 1, e.b.depth - e.a.depth)").alias("label"),
        F.col("e.b.node").alias("child"),
        F.col("e.b.terminal").alias("child_ends"),
        bit(F.length("w")).alias("lengths"),
    )
    return found.groupBy("node", "c", "label", "child", "child_ends").agg(F.bit_or("lengths").alias("lengths"))


def near_pairs(words: DataFrame, least: int = LEAST_LENGTH) -> DataFrame:
    """(word, other): all pairs of ``words(word)`` that differ by exactly one inserted, deleted or replaced code point, both
    ways round.

    The frontier holds states (w, pos, node) with one edit behind them: ``pos`` letters of the word are read, and
    ``node`` is where the edited word stands. Each round joins it with the edges on (node, next letter) and goes
    on where the rest of the edge's label is read as well, until no state has letters left.
    """
    rows = materialise(path_rows(words))
    steps = materialise(steps_of(rows))
    edges = materialise(edges_of(steps))

    at = steps.select("w", "back", F.length("w").alias("n"), F.explode("steps").alias("at"))
    at = at.select("w", "back", "n", "at.*").withColumnRenamed("c", "own").where("own <> -1")
    state = ["w", "back", "n", "want", "pos", F.col("child").alias("node"), F.col("child_ends").alias("ends")]
    size = F.length("label")
    replaced = at.join(edges, "node").where(has_bit(F.col("lengths"), F.col("n")) & (F.col("c") != F.col("own")))
    replaced = replaced.where("substring(w, depth + 2, length(label) - 1) = substring(label, 2)")
    replaced = replaced.withColumns({"want": F.col("n"), "pos": F.col("depth") + size}).select(*state)
    # Of a run of equal letters the last one is deleted.
    shorter = at.where((F.col("n") > least) & F.expr("substring(w, depth + 1, 1) <> substring(w, depth + 2, 1)"))
    ended = shorter.where("depth = n - 1 and terminal").select("w", "back", "node")
    deleted = shorter.where("depth < n - 1").withColumn("c", F.expr("ascii(substring(w, depth + 2, 1))"))
    deleted = deleted.join(edges, ["node", "c"]).where(has_bit(F.col("lengths"), F.col("n") - 1))
    deleted = deleted.where("substring(w, depth + 2, length(label)) = label")
    deleted = deleted.withColumns({"want": F.col("n") - 1, "pos": F.col("depth") + 1 + size}).select(*state)

    frontier, found = materialise(replaced.unionByName(deleted)), ended
    while True:
        found = found.unionByName(frontier.where("pos = n and ends").select("w", "back", "node"))
        going = frontier.where("pos < n").withColumn("c", F.expr("ascii(substring(w, pos + 1, 1))"))
        if not going.take(1):
            break
        met = going.join(edges, ["node", "c"]).where(has_bit(F.col("lengths"), F.col("want")))
        met = met.where("substring(w, pos + 1, length(label)) = label").withColumn("pos", F.col("pos") + size)
        frontier = materialise(met.drop("node").select(*state))

    ends = rows.where("c = -1").select("node", F.expr("if(back, reverse(w), w)").alias("other"))
    pairs = found.join(ends, "node").select(F.expr("if(back, reverse(w), w)").alias("word"), "other")
    return pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("word").alias("other"))).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms(word, form)``: the last of the forms of forms; each round doubles the way."""
    links = materialise(forms.select("word", F.col("form").alias("root")))
    while True:
        after = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = materialise(links.join(after, "root", "left").select("word", F.coalesce("next", "root").alias("root"), "next"))
        going = links.where("next is not null").take(1)
        links = links.drop("next")
        if not going:
            return links


def variants(words: DataFrame, least: int = LEAST_LENGTH, factor: int = FACTOR) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each row of ``words(word, n)``, whose words are distinct.

    A word's form is the most frequent of its near words (ties: the smallest in code-point order) if that is
    ``factor`` times as frequent as the word, else null; its root is where the forms of forms end, the word
    itself without any. Words have ``least`` code points at least. No words in, no rows out.
    """
    words = materialise(words.select("word", "n"))
    pairs = near_pairs(words, least).join(words.select(F.col("word").alias("other"), F.col("n").alias("m")), "other")
    best = F.min(F.struct((-F.col("m")).alias("m"), F.col("other").alias("form"))).alias("best")
    near = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    known = words.join(near, "word", "left").withColumn("form_n", -F.col("best.m"))
    has_form = F.col("form_n") >= F.lit(factor) * F.col("n")
    known = materialise(
        known.select(
            "word",
            F.when(has_form, F.col("best.form")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(has_form, F.col("form_n")).alias("form_n"),
        )
    )
    last = roots(known.where("form is not null"))
    known = known.join(last, "word", "left").withColumn("root", F.coalesce("root", "word"))
    return known.select("word", "form", "root", "n", "n_near", "form_n")
