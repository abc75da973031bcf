"""Sample values and schema documents: one searchable text per table and per database."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from schemaloom.functions.text import flatten_text, strip
from schemaloom.operators.catalogue import Table, union_all
from schemaloom.runtime import small_frame

SAMPLES_PER_COLUMN = 5
ORIGINAL_NAME_CHARS = 80


def _text_columns(table: Table) -> list[str]:
    skipped = (T.BinaryType, T.ArrayType, T.MapType, T.StructType)
    return [f.name for f in table.frame.schema.fields if not isinstance(f.dataType, skipped)]


def _smallest_in_task(columns: list[str], keep: int):
    """Keep the ``keep`` smallest distinct values per column while one task reads its rows.

    Only values below the greatest kept one are looked at; values are compared by their bytes, as Spark does.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, pa.Array] = {}
        for batch in batches:
            for c, values in zip(columns, batch.columns):
                if c in best and len(best[c]) == keep:
                    values = values.filter(pc.less(values, best[c][-1]))
                values = pc.unique(values).drop_null()
                if len(values):
                    values = pc.unique(pa.concat_arrays([values, *([best[c]] if c in best else [])]))
                    best[c] = values.take(pc.sort_indices(values)[:keep])
        for c, values in best.items():
            yield pa.record_batch([pa.array([c] * len(values), pa.string()), values.cast(pa.string())], ["column", "value"])

    return run


def sample_values(tables: list[Table], keep: int = SAMPLES_PER_COLUMN) -> DataFrame:
    """(database, table, column, position, value): the smallest distinct texts per column.

    Every task reduces its rows to ``keep`` values per column before anything is
    shuffled, so the exchange does not grow with the number of rows or distinct values.
    """
    parts = []
    for t in tables:
        names = _text_columns(t)
        texts = t.frame.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in names])
        found = texts.mapInArrow(_smallest_in_task(names, keep), "column string, value string")
        parts.append(found.select(F.lit(t.database).alias("database"), F.lit(t.name).alias("table"), "*"))
    order = Window.partitionBy("database", "table", "column").orderBy("value")
    return (
        union_all(parts)
        .distinct()
        .withColumn("position", F.row_number().over(order))
        .filter(F.col("position") <= keep)
    )


def shown_samples(samples: DataFrame) -> DataFrame:
    """Samples as they appear in a document: one short line each, no commas."""
    shown = F.replace(flatten_text(F.col("value")), F.lit(","), F.lit(";"))
    return samples.withColumn("value", shown).filter("value <> ''")


def first_values(table: Table, order_by: list[str], keep: int = SAMPLES_PER_COLUMN) -> DataFrame:
    """First non-null values per column in a declared row order, repeats included.

    Per column, a task keeps ``keep`` rows while it reads two columns; nothing is sorted.
    """
    place = [F.lit(table.database).alias("database"), F.lit(table.name).alias("table")]
    heads = [
        table.frame.filter(F.col(f"`{c}`").isNotNull())
        .orderBy(*order_by)
        .limit(keep)
        .select(*place, F.lit(c).alias("column"), *[F.col(o).alias(f"__{o}") for o in order_by], F.col(f"`{c}`").cast("string").alias("value"))
        for c in _text_columns(table)
    ]
    hidden = [f"__{o}" for o in order_by]
    order = Window.partitionBy("column").orderBy(*hidden)
    return union_all(heads).withColumn("position", F.row_number().over(order)).drop(*hidden)


def table_documents(
    columns: DataFrame,
    types: DataFrame,
    keys: DataFrame,
    links: DataFrame,
    samples: DataFrame | None = None,
    kind: str = "user",
    key_style: str = "dotted",
    with_database: bool = True,
    with_originals: bool = True,
) -> DataFrame:
    """One document per table: (id, database, table, kind, text).

    All inputs are catalogue-sized. They meet on (database, table, column), and one
    aggregate per table puts the columns in order. ``key_style`` writes a link as
    ``a -> t.b`` (``dotted``) or ``a -> t(b)`` (``call``).
    """
    name = ["database", "table", "column"]
    if key_style == "call":
        target = F.format_string("%s(%s)", "ref_table", "ref_column")
    else:
        target = F.concat("ref_table", F.lit("."), "ref_column", F.when(F.col("inferred"), " (inferred)").otherwise(""))
    linked = links.groupBy(*name).agg(F.array_sort(F.collect_list(target)).alias("targets"))
    known = (
        columns.join(types, name, "left")
        .join(keys.select(*name, F.lit(True).alias("is_key")), name, "left")
        .join(linked, name, "left")
    )
    listed = F.lit(None).cast("string")
    if samples is not None:
        values = F.array_sort(F.collect_list(F.struct("position", "value")))
        shown = samples.groupBy(*name).agg(F.array_join(values["value"], ", ").alias("shown"))
        known, listed = known.join(shown, name, "left"), F.col("shown")
    column = F.struct(
        "column_no",
        "column",
        flatten_text(F.col("original_column"), ORIGINAL_NAME_CHARS).alias("original"),
        (F.col("original_column") != F.col("column")).alias("renamed"),
        F.coalesce("type", "base_type").alias("type"),
        "is_key",
        "targets",
        listed.alias("shown"),
    )
    grouped = known.groupBy("database", "table").agg(
        F.array_sort(F.collect_list(column)).alias("cols"), F.any_value("original_table").alias("original_table")
    )
    cols, none = F.col("cols"), F.array().cast("array<string>")

    def when_any(found, head: str, one_line: str | None = None):
        """A heading with its lines, or one line, when there is something to show."""
        lines = F.concat(F.array(F.lit(head)), found) if one_line is None else F.array(
            F.concat(F.lit(head), F.array_join(found, one_line))
        )
        return F.when(F.size(found) > 0, lines).otherwise(none)

    def picked(test, shape):
        return F.transform(F.filter(cols, test), shape)

    parts = []
    if with_database:
        parts.append(F.array(F.concat(F.lit("DATABASE: "), "database")))
    parts.append(F.array(F.concat(F.lit("TABLE: "), "table")))
    if with_originals:
        original = F.concat(F.lit("ORIGINAL NAME: "), flatten_text(F.col("original_table"), ORIGINAL_NAME_CHARS))
        parts.append(F.when(F.col("original_table") != F.col("table"), F.array(original)).otherwise(none))
    parts.append(F.array(F.lit("COLUMNS:")))
    parts.append(F.transform(cols, lambda c: F.format_string("- %s (%s)", c["column"], c["type"])))
    if with_originals:
        renamed = picked(lambda c: c["renamed"], lambda c: F.concat(c["column"], F.lit(" = "), c["original"]))
        parts.append(when_any(renamed, "ORIGINAL COLUMN NAMES: ", "; "))
    parts.append(when_any(picked(lambda c: c["is_key"], lambda c: c["column"]), "PRIMARY KEYS: ", ", "))
    arrows = picked(
        lambda c: c["targets"].isNotNull(),
        lambda c: F.transform(c["targets"], lambda t: F.concat(F.lit("- "), c["column"], F.lit(" -> "), t)),
    )
    parts.append(when_any(F.flatten(arrows), "FOREIGN KEYS:"))
    if samples is not None:
        lines = picked(lambda c: c["shown"].isNotNull(), lambda c: F.format_string("- %s: %s", c["column"], c["shown"]))
        parts.append(when_any(lines, "SAMPLE VALUES:"))
    return grouped.select(
        F.concat_ws("::", "database", "table").alias("id"),
        "database",
        "table",
        F.lit(kind).alias("kind"),
        F.array_join(F.concat(*parts), "\n").alias("text"),
    )


def database_documents(documents: DataFrame, headed: bool = True, gap: str = "\n\n") -> DataFrame:
    """One document per database: (id, database, table_count, text).

    ``documents`` are table documents without their DATABASE line, at most a few hundred
    short texts per database.
    """
    texts = F.array_join(F.array_sort(F.collect_list(F.struct("table", "text"))).getField("text"), gap)
    head = F.concat(F.lit("DATABASE: "), "database", F.lit(gap)) if headed else F.lit("")
    return (
        documents.groupBy("database")
        .agg(texts.alias("body"), F.count(F.lit(1)).alias("table_count"))
        .select(
            F.col("database").alias("id"), "database", "table_count", F.concat(head, F.col("body")).alias("text")
        )
    )


def table_explorer(columns: DataFrame, types: DataFrame, keys: DataFrame, links: DataFrame, nullable: DataFrame) -> DataFrame:
    """Per column: type, nullable, key flag, first link and its target, and the column count."""
    name = ["database", "table", "column"]
    first_link = links.groupBy(*name).agg(
        F.min(F.struct("ref_table", "ref_column")).alias("target")
    )
    counted = Window.partitionBy("database", "table")
    return (
        columns.withColumn("column_count", F.count(F.lit(1)).over(counted))
        .join(types, name, "left")
        .join(nullable, name, "left")
        .join(keys.select(*name, F.lit(True).alias("primary_key")), name, "left")
        .join(first_link, name, "left")
        .select(
            *name,
            "column_no",
            "column_count",
            F.coalesce("type", "base_type").alias("type"),
            F.coalesce("nullable", F.lit(True)).alias("nullable"),
            F.coalesce("primary_key", F.lit(False)).alias("primary_key"),
            F.col("target").isNotNull().alias("foreign_key"),
            F.col("target.ref_table").alias("references_table"),
            F.col("target.ref_column").alias("references_column"),
        )
    )


def document_values(documents: DataFrame) -> DataFrame:
    """Lower-case sample values of each document, one row per occurrence."""
    return documents.select("id", F.explode(sample_phrases(F.col("text"))).alias("value"))


def sample_phrases(text):
    """Comma-separated values on the lines after the first ``SAMPLE VALUES:`` line."""
    lines = F.transform(F.split(text, "\n"), strip)
    mark = F.array_position(lines, "SAMPLE VALUES:").cast("int")
    after = F.when(mark > 0, F.slice(lines, mark + 1, F.size(lines))).otherwise(F.array().cast("array<string>"))
    valued = F.filter(after, lambda x: x.startswith("-") & x.contains(":"))
    right = F.transform(valued, lambda x: F.regexp_replace(x, r"(?s)^[^:]*:", ""))
    values = F.flatten(F.transform(right, lambda x: F.split(x, ",")))
    return F.filter(F.transform(values, lambda v: F.lower(strip(v))), lambda v: v != "")


def value_frequency(documents: DataFrame, top: int = 30) -> DataFrame:
    """The ``top`` most frequent sample values; equal counts in value order."""
    counts = document_values(documents).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "value").limit(top)


def named_value_counts(documents: DataFrame, names: list[str]) -> DataFrame:
    """Frequency of the named values, 0 for those that never occur."""
    asked = small_frame(documents.sparkSession, [(n,) for n in names], "value string")
    counts = (
        document_values(documents)
        .join(F.broadcast(asked), "value", "left_semi")
        .groupBy("value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return asked.join(counts, "value", "left").select("value", F.coalesce("n", F.lit(0)).alias("n"))


def ingest_summary(columns: DataFrame, row_counts: DataFrame, links: DataFrame, row_cap: int) -> DataFrame:
    """Per table: original name, columns, rows (all of them), relationships, a warning above ``row_cap``."""
    shape = columns.groupBy("database", "table", "original_table").agg(F.count(F.lit(1)).alias("columns"))
    target = F.concat("column", F.lit(" -> "), "ref_table", F.lit("."), "ref_column")
    related = links.groupBy("database", "table").agg(F.array_sort(F.collect_list(target)).alias("relationships"))
    over = F.col("rows") > row_cap
    return (
        shape.join(row_counts, ["database", "table"])
        .join(related, ["database", "table"], "left")
        .select(
            "database",
            "table",
            "original_table",
            "columns",
            "rows",
            F.coalesce("relationships", F.array().cast("array<string>")).alias("relationships"),
            F.when(
                over, F.format_string(f"Table '%s' has more than {row_cap:,} rows.", "original_table")
            ).alias("warning"),
        )
    )


def row_counts(tables: list[Table]) -> DataFrame:
    return union_all(
        [
            t.frame.agg(F.count(F.lit(1)).alias("rows")).select(
                F.lit(t.database).alias("database"), F.lit(t.name).alias("table"), "rows"
            )
            for t in tables
        ]
    )


def dataset_report(frame: DataFrame, name: str, database_column: str) -> DataFrame:
    """Rows, distinct databases and columns of a question set."""
    return frame.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct(database_column).alias("databases")
    ).select(F.lit(name).alias("dataset"), "rows", "databases", F.lit(len(frame.columns)).alias("columns"))
