"""Lines that many pages of a site share are dropped, in column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemaloom.llm.common import WORD, free_name, hash128
from schemaloom.runtime import materialise

#: In the documents table (query, SQL and pipeline) a line goes when more than this share of its site's pages
#: has it. A site mixes languages, so a header of a fifth of one language's pages stands on 1 to 5 % of the site's.
MAX_RATIO = 0.01
#: ... and at least so many pages, so that the few near copies of a page do not make its lines boilerplate.
MIN_PAGES = 5
#: What a caller gets who names no ratio: only lines that a site of a dozen pages shows without doubt.
CAUTIOUS_RATIO, CAUTIOUS_PAGES = 0.2, 3


def line_key(line: Column) -> Column:
    return hash128(F.btrim(line, F.lit(" \t\n\x0b\f\r")))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def boilerplate(docs: DataFrame, max_ratio: float = CAUTIOUS_RATIO, min_pages: int = CAUTIOUS_PAGES) -> DataFrame:
    """(host, keys): the line keys that count as boilerplate on each host of ``docs(text, source)``.

    A page is a distinct text of a host, so copies of one page count once and cannot make their own
    lines boilerplate. Lines are compared without white space at their ends; lines without a word do
    not count. Only hashes are shuffled. A host's list has at most (mean lines of a page) / max_ratio
    entries, whatever the number of pages. Rows without text or source do not count.
    """
    keys = F.array_distinct(F.transform(F.filter(lines_of(F.col("text")), lambda x: x.rlike(WORD)), line_key))
    pages = docs.where("text is not null and source is not null").select(
        F.col("source").alias("host"), hash128(F.col("text")).alias("page"), keys.alias("keys")
    )
    pages = materialise(pages.dropDuplicates(["host", "page"]).select("host", "keys"))
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    lines = pages.select("host", F.explode("keys").alias("key")).groupBy("host", "key").agg(F.count(F.lit(1)).alias("n"))
    common = lines.where(F.col("n") >= min_pages).join(totals, "host").where(F.col("n") > max_ratio * F.col("pages"))
    return materialise(common.groupBy("host").agg(F.collect_list("key").alias("keys")))


def drop_boilerplate(docs: DataFrame, max_ratio: float = CAUTIOUS_RATIO, min_pages: int = CAUTIOUS_PAGES) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``; all rows and columns stay.

    Adds n_lines and n_dropped (with underscores in front if ``docs`` has such columns). Lines without
    a word stay. A null text stays null with 0 lines; a row without source stays as it is. A host's
    rows are joined with one short list, so a hot host is split by the join and gathers nothing.
    """
    found = boilerplate(docs, max_ratio, min_pages)
    host, keys = free_name(docs, "host_of_list"), free_name(docs, "keys_of_list")
    n_lines, n_dropped = free_name(docs, "n_lines"), free_name(docs, "n_dropped")
    joined = docs.join(found.toDF(host, keys), F.col("source") == F.col(host), "left")
    kept = F.filter(
        lines_of(F.col("text")), lambda line: ~(line.rlike(WORD) & F.array_contains(F.col(keys), line_key(line)))
    )
    cut = F.when(F.col(keys).isNull(), lines_of(F.col("text"))).otherwise(kept)
    before = F.coalesce(F.size(lines_of(F.col("text"))), F.lit(0)).cast("long")
    joined = joined.withColumn(n_lines, F.when(F.col("text").isNull(), F.lit(0).cast("long")).otherwise(before))
    joined = joined.withColumn(keys, cut)
    left = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(keys)).cast("long")
    joined = joined.withColumn(n_dropped, F.col(n_lines) - left)
    joined = joined.withColumn("text", F.array_join(keys, "\n"))
    return joined.select(*docs.columns, n_lines, n_dropped)
