"""Quality rules with host-level verdicts, in column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemaloom.llm.common import WORD, let
from schemaloom.runtime import materialise

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_SYMBOL_PERCENT = 10
MAX_DUP_LINE_PERCENT = 30
MEAN_WORD_CHARS = (2, 15)
#: A host is refused when its shrunk share of failing documents is above this.
MAX_HOST_RATE = 0.5
#: Strength of the prior (in documents) where the hosts' rates do not vary or there is one host.
DEFAULT_STRENGTH = 10.0


def repeated_words(words: Column) -> Column:
    """How many words lie in a 3-word window that is found twice or more.

    The windows' hashes are sorted with their places, so that equal windows are neighbours; the places
    found are merged in order. Work grows with n log n of the words, all within the row.
    """

    def windows(w: Column) -> Column:
        def one(i: Column) -> Column:
            key = F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2))
            return F.struct(key.alias("h"), i.alias("i"))

        return F.sort_array(F.transform(F.sequence(F.lit(1), F.size(w) - 2), one))

    def places(s: Column) -> Column:
        def same(x: Column, j: Column) -> Column:
            near = [F.coalesce(F.get(s, j + d)["h"] == x["h"], F.lit(False)) for d in (-1, 1)]
            return near[0] | near[1]

        return F.sort_array(F.transform(F.filter(s, same), lambda x: x["i"]))

    def covered(places: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit(-9).alias("last"))

        def step(acc: Column, i: Column) -> Column:
            n = acc["n"] + F.least(F.lit(3), i - acc["last"])
            return F.struct(n.alias("n"), i.alias("last"))

        return F.aggregate(places, start, step, lambda acc: acc["n"])

    def count(w: Column) -> Column:
        return F.when(F.size(w) >= 4, covered(let(windows(w), places))).otherwise(F.lit(0))

    return let(words, count)


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, host (the source) and the base counts of each row of ``docs(doc_id, text, source)``.

    A null text counts as one without words. Rows are judged one by one, so repeated ids stay repeated.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    return docs.select(
        "doc_id",
        F.col("source").alias("host"),
        F.size(words).cast("long").alias("n_words"),
        F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x)).cast("long").alias("n_lines"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(words).cast("long").alias("n_repeat_words"),
    )


def failures(counts: DataFrame) -> DataFrame:
    """Add base_failed and failed (any rule) to the base counts. An empty text fails for its length."""
    base = f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words"
    symbols = f"100 * n_symbols > {MAX_SYMBOL_PERCENT} * word_chars"
    lines = f"100 * n_dup_lines > {MAX_DUP_LINE_PERCENT} * n_lines"
    low, high = MEAN_WORD_CHARS
    length = f"word_chars < {low} * n_words or word_chars > {high} * n_words"
    return counts.withColumn("base_failed", F.expr(base)).withColumn(
        "failed", F.expr(f"base_failed or {symbols} or {lines} or {length}")
    )


def host_verdicts(judged: DataFrame) -> DataFrame:
    """(host, host_docs, host_failed, host_rate, host_refused) of documents judged by rules.

    The beta prior is fitted to the hosts' rates by moments: with mean m and variance v its strength is
    m(1-m)/v - 1 (at least 1; DEFAULT_STRENGTH where v is 0), and a host's rate is shrunk towards m by
    it. A null host is a host of its own. One row per host; the prior is a single row.
    """
    hosts = judged.groupBy("host").agg(
        F.count(F.lit(1)).alias("host_docs"), F.count_if("failed").alias("host_failed")
    )
    prior = hosts.agg(
        F.avg(F.expr("host_failed / host_docs")).alias("m"), F.var_pop(F.expr("host_failed / host_docs")).alias("v")
    ).select("m", F.expr(f"case when v > 1e-12 then greatest(m * (1 - m) / v - 1, 1) else {DEFAULT_STRENGTH} end").alias("s"))
    rate = F.expr("(host_failed + m * s) / (host_docs + s)")
    return (
        hosts.join(F.broadcast(prior))  # one row
        .withColumn("host_rate", rate)
        .withColumn("host_refused", F.col("host_rate") > MAX_HOST_RATE)
        .drop("m", "s")
    )


def judge(docs: DataFrame) -> DataFrame:
    """Base counts, host figures and ``kept`` for each row of ``docs(doc_id, text, source)``.

    The counts are written once, since both the hosts' sums and the verdicts read them. Other columns
    are not read, so their names cannot clash. No rows in, no rows out.
    """
    judged = materialise(failures(base_counts(docs)))
    hosts = host_verdicts(judged)
    joined = judged.join(hosts.withColumnRenamed("host", "of"), F.col("host").eqNullSafe(F.col("of")), "left").drop("of")
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.col("host_refused"))
