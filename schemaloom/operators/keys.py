"""Primary keys and links between tables, proposed by name and verified on the data."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from schemaloom.functions.values import affinity
from schemaloom.operators.catalogue import Table, base_type, union_all
from schemaloom.runtime import small_frame

MIN_INCLUDED = 0.9
KEY_SEARCH_COLUMNS = 3
#: log2 of the registers of a column's sketch; its estimate has a standard error of 1.6 %.
SKETCH_BITS = 12
#: A column is ruled out by its sketch below this share of distinct values, over thirty standard errors from unique.
HOPELESS = 0.5


def compatible(left_type: Column, right_type: Column) -> Column:
    """Same affinity, or both numeric."""
    numbers = ["INTEGER", "REAL", "NUMERIC"]
    a, b = affinity(left_type), affinity(right_type)
    return (a == b) | (a.isin(numbers) & b.isin(numbers))


def _numeric(kind: str) -> bool:
    return kind in ("INTEGER", "REAL", "DATETIME")


def uniqueness(tables: list[Table], columns: dict[tuple[str, str], list[str]]) -> DataFrame:
    """Uniqueness profile of the named columns; ``columns`` maps (database, table) to names.

    Each table is scanned once and each row becomes (column number, value) pairs. They are
    counted per value first, so a hot value is combined before the shuffle and no distinct
    set is held in one task.
    """
    names: list[tuple] = []
    parts = []
    for t in tables:
        pairs = []
        for c in columns.get((t.database, t.name), []):
            value = F.col(f"`{c}`").cast("string").alias("value")
            pairs.append(F.struct(F.lit(len(names)).alias("col_no"), value))
            names.append((len(names), t.database, t.name, c))
        if pairs:
            parts.append(t.frame.select(F.inline(F.array(*pairs))))
    values = union_all(parts).groupBy("col_no", "value").agg(F.count(F.lit(1)).alias("n"))
    profile = values.groupBy("col_no").agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)).alias("non_null"),
        F.count("value").alias("distinct"),
    )
    spark = tables[0].frame.sparkSession
    named = small_frame(spark, names, "col_no int, database string, table string, column string")
    unique = (F.col("rows") == F.col("non_null")) & (F.col("rows") == F.col("distinct"))
    return profile.join(F.broadcast(named), "col_no").drop("col_no").withColumn("is_unique", unique)


Names = dict[tuple[str, str], list[str]]


def distinct_estimates(tables: list[Table], columns: Names) -> DataFrame:
    """(database, table, column, rows, non_null, estimate): one scan per table, one row per column out of it.

    The estimate comes from HyperLogLog sketches, so a task holds a fixed number of registers per column and
    nothing of the values is shuffled.
    """
    parts = []
    for t in tables:
        found = []
        for c in columns.get((t.database, t.name), []):
            value = F.col(f"`{c}`").cast("string")
            names = [F.lit(x).alias(n) for x, n in ((t.database, "database"), (t.name, "table"), (c, "column"))]
            counts = [F.count(F.lit(1)).alias("rows"), F.count(value).alias("non_null")]
            estimate = F.hll_sketch_estimate(F.hll_sketch_agg(value, SKETCH_BITS))
            found.append(F.struct(*names, *counts, F.coalesce(estimate, F.lit(0)).alias("estimate")))
        if found:
            parts.append(t.frame.agg(F.array(*found).alias("found")).select(F.inline("found")))
    return union_all(parts)


def unique_columns(
    tables: list[Table], columns: Names, hashed: Callable[[Column], Column] = F.xxhash64
) -> set[tuple[str, str, str]]:
    """(database, table, column) of the named columns that have rows, no nulls and no value twice.

    Sketches rule out most columns in the scan. What is left is shuffled as two 64-bit hashes: a first hash that
    occurs once is one value, one that occurs again with the same second hash is a value that repeats. A column
    without repeats in which different values share a first hash is counted by its values. The result is as small
    as the catalogue.
    """
    if not any(columns.get((t.database, t.name)) for t in tables):
        return set()
    likely = distinct_estimates(tables, columns).where(
        (F.col("rows") > 0) & (F.col("non_null") == F.col("rows")) & (F.col("estimate") >= HOPELESS * F.col("rows"))
    )
    likely = {tuple(r) for r in likely.select("database", "table", "column").collect()}
    parts, names = [], []
    for t in tables:
        pairs = []
        for c in columns.get((t.database, t.name), []):
            if (t.database, t.name, c) in likely:
                value = F.col(f"`{c}`").cast("string")
                second = F.xxhash64(value, F.lit("second"))
                number = F.lit(len(names)).alias("col_no")
                pairs.append(F.struct(number, hashed(value).alias("first"), second.alias("second")))
                names.append((t.database, t.name, c))
        if pairs:
            parts.append(t.frame.select(F.inline(F.array(*pairs))))
    if not names:
        return set()
    each = union_all(parts).groupBy("col_no", "first").agg(
        F.count(F.lit(1)).alias("n"), F.min("second").alias("low"), F.max("second").alias("high")
    )
    again, alike = F.col("n") > 1, F.col("low") == F.col("high")
    verdicts = each.groupBy("col_no").agg(F.max(again & alike).alias("twice"), F.max(again & ~alike).alias("mixed"))
    rows = verdicts.where("not twice").collect()
    found = {names[r.col_no] for r in rows if not r.mixed}
    unclear: Names = {}
    for database, table, column in (names[r.col_no] for r in rows if r.mixed):
        unclear.setdefault((database, table), []).append(column)
    if unclear:
        proven = uniqueness(tables, unclear).where("is_unique").select("database", "table", "column")
        found |= {tuple(r) for r in proven.collect()}
    return found


def looks_like_key(table: str, column: str) -> bool:
    name, stem = column.lower(), table.lower().rstrip("s")
    return name.endswith("id") and (name == "id" or name.endswith("_id") or name.startswith(stem))


def key_columns_to_test(tables: list[Table]) -> dict[tuple[str, str], list[str]]:
    found = {}
    for t in tables:
        names = [c for c in t.frame.columns[:KEY_SEARCH_COLUMNS] if looks_like_key(t.name, c)]
        if names:
            found[t.database, t.name] = names
    return found


def primary_keys(
    tables: list[Table], columns: DataFrame, unique: set[tuple[str, str, str]] | None = None
) -> DataFrame:
    """(database, table, column): first key-like column that is unique and never null.

    ``unique`` gives what is known of the columns of ``columns_to_prove``, so that they are not read again.
    """
    wanted = key_columns_to_test(tables)
    unique = unique_columns(tables, wanted) if unique is None else unique
    named = [(*t, c) for t, names in wanted.items() for c in names if (*t, c) in unique]
    order = Window.partitionBy("database", "table").orderBy("column_no")
    return (
        small_frame(columns.sparkSession, named, "database string, table string, column string")
        .join(columns, ["database", "table", "column"])
        .withColumn("rn", F.row_number().over(order))
        .filter("rn = 1")
        .select("database", "table", "column")
    )


@dataclass(frozen=True)
class Candidate:
    """A possible link, in the order in which candidates are preferred on a tie."""

    child: Table
    column: str
    parent: Table
    ref_column: str
    order: int


def _plurals(stem: str) -> set[str]:
    return {stem, stem + "s", stem + "es"} | ({stem[:-1] + "ies"} if stem.endswith("y") else set())


def link_candidates(
    tables: list[Table], declared: set[tuple[str, str]] = frozenset(), skip_child_keys: bool = False
) -> list[Candidate]:
    """Pairs that agree by name and type; decided on metadata before any data is read.

    ``declared`` names the (database, table) whose links are already known.
    ``skip_child_keys`` leaves out plain ``id`` columns as children (off by default).
    """
    by_name: dict[tuple[str, str], list[tuple[Table, str, str]]] = {}
    for t in tables:
        for f in t.frame.schema.fields:
            by_name.setdefault((t.database, f.name.lower()), []).append((t, f.name, base_type(f.dataType)))
    found = []
    for child in tables:
        if (child.database, child.name) in declared:
            continue
        for f in child.frame.schema.fields:
            name, kind = f.name.lower(), base_type(f.dataType)
            if skip_child_keys and name == "id":
                continue
            same = [
                p
                for p in by_name[child.database, name]
                if name.endswith(("id", "_code", "_key", "_no"))
                or [k.lower() for k in p[0].declared_keys] == [name]
            ]
            by_stem = [
                p
                for p in by_name.get((child.database, "id"), [])
                if name.endswith("_id") and p[0].name.lower() in _plurals(name[:-3])
            ]
            for parent, ref_column, ref_kind in same + by_stem:
                if parent is child:
                    continue
                if kind == ref_kind or (_numeric(kind) and _numeric(ref_kind)):
                    found.append((child, f.name, parent, ref_column))
    position = {id(t): n for n, t in enumerate(tables)}
    found.sort(key=lambda c: (position[id(c[0])], c[1], position[id(c[2])], c[2].frame.columns.index(c[3])))
    return [Candidate(*c, order=n) for n, c in enumerate(found)]


def _comparable(table: Table, column: str, kind: str) -> DataFrame:
    """Values as text of the type in which both columns of a candidate are compared."""
    value = F.col(f"`{column}`")
    if kind == "number":
        # Exact for whole numbers; what does not fit is compared as its own text.
        value = F.coalesce(value.try_cast("decimal(38,18)").cast("string"), value.cast("string"))
    elif kind == "whole":
        value = value.cast("bigint")
    elif kind == "time":
        value = value.cast("timestamp_ntz").cast("string")
    else:
        value = value.cast("string")
    return table.frame.select(value.alias("value")).filter("value is not null")


def _comparison(c: Candidate) -> str:
    types = c.child.frame.schema[c.column].dataType, c.parent.frame.schema[c.ref_column].dataType
    kinds = {base_type(t) for t in types}
    if all(isinstance(t, T.IntegralType) for t in types):
        return "whole"
    if types[0] == types[1] or kinds == {"INTEGER"}:
        return "text"
    if kinds <= {"INTEGER", "REAL"}:
        return "number"
    return "time" if kinds == {"DATETIME"} else "text"


def inclusion(candidates: list[Candidate]) -> DataFrame:
    """Share of non-null child values found in the parent column, one row per candidate.

    The parent column must be unique. Child values are counted per value before the
    join, so a hot value costs one row and meets at most one parent row. Whole numbers are
    compared as such, which is as exact as their texts and shuffles less.
    """
    whole = [c for c in candidates if _comparison(c) == "whole"]
    texts = [c for c in candidates if _comparison(c) != "whole"]
    return union_all([_included(same) for same in (whole, texts) if same])


def _included(candidates: list[Candidate]) -> DataFrame:
    """The shares of ``inclusion`` for candidates that are all compared as whole numbers, or all as texts."""
    children: dict[tuple, list[Candidate]] = {}
    parents: dict[tuple, list[Candidate]] = {}
    for c in candidates:
        kind = _comparison(c)
        children.setdefault((c.child.database, c.child.name, c.column, kind), []).append(c)
        parents.setdefault((c.parent.database, c.parent.name, c.ref_column, kind), []).append(c)

    def pair_numbers(groups: dict[tuple, list[Candidate]]) -> Column:
        """Candidates of the column numbered ``col_no``; a list known before the scan."""
        numbers = F.array(*[F.array(*[F.lit(c.order) for c in group]) for group in groups.values()])
        return F.explode(F.element_at(numbers, F.col("col_no") + 1)).alias("pair")

    child = union_all(
        [
            _comparable(group[0].child, column, kind).withColumn("col_no", F.lit(n))
            for n, ((_, _, column, kind), group) in enumerate(children.items())
        ]
    )
    child = child.groupBy("col_no", "value").agg(F.count(F.lit(1)).alias("n"))
    parent = union_all(
        [
            _comparable(group[0].parent, column, kind).withColumn("col_no", F.lit(n))
            for n, ((_, _, column, kind), group) in enumerate(parents.items())
        ]
    )
    child = child.select(pair_numbers(children), "value", "n")
    parent = parent.select(pair_numbers(parents), "value", F.lit(True).alias("found"))
    return (
        child.join(parent, ["pair", "value"], "left")
        .groupBy("pair")
        .agg((F.sum(F.when(F.col("found"), F.col("n")).otherwise(0)) / F.sum("n")).alias("ratio"))
    )


LINK_SCHEMA = (
    "pair int, database string, table string, column string, ref_table string, ref_column string"
)


def parent_columns(candidates: list[Candidate]) -> Names:
    wanted: Names = {}
    for c in candidates:
        names = wanted.setdefault((c.parent.database, c.parent.name), [])
        if c.ref_column not in names:
            names.append(c.ref_column)
    return wanted


def columns_to_prove(tables: list[Table], declared: set[tuple[str, str]] = frozenset()) -> Names:
    """All columns whose uniqueness keys and links ask for; decided on metadata."""
    wanted = parent_columns(link_candidates(tables, declared))
    for table, names in key_columns_to_test(tables).items():
        wanted[table] = list(dict.fromkeys(wanted.get(table, []) + names))
    return wanted


def unique_parents(tables: list[Table], candidates: list[Candidate]) -> set[tuple[str, str, str]]:
    """Names of the parent columns that are unique; as small as the catalogue."""
    return unique_columns(tables, parent_columns(candidates))


def infer_links(
    tables: list[Table],
    declared: set[tuple[str, str]] = frozenset(),
    skip_child_keys: bool = False,
    unique: set[tuple[str, str, str]] | None = None,
) -> DataFrame:
    """Best verified link per child column: unique parent, at least 90 % of values found.

    Cheap tests run first: names and types on metadata, then uniqueness of the few
    parent columns, and only for the survivors the scan of the child columns.
    """
    candidates = link_candidates(tables, declared, skip_child_keys)
    unique = unique_parents(tables, candidates) if unique is None else unique
    candidates = [c for c in candidates if (c.parent.database, c.parent.name, c.ref_column) in unique]
    spark = tables[0].frame.sparkSession
    pairs = small_frame(
        spark,
        [
            (c.order, c.child.database, c.child.name, c.column, c.parent.name, c.ref_column)
            for c in candidates
        ],
        LINK_SCHEMA,
    )
    if not candidates:
        return pairs.drop("pair").selectExpr("*", "cast(null as double) ratio", "true inferred")
    best = Window.partitionBy("database", "table", "column").orderBy(F.desc("ratio"), "pair")
    return (
        inclusion(candidates)
        .filter(F.col("ratio") >= MIN_INCLUDED)
        .join(F.broadcast(pairs), "pair")
        .withColumn("rn", F.row_number().over(best))
        .filter("rn = 1")
        .select(
            "database", "table", "column", "ref_table", "ref_column", "ratio", F.lit(True).alias("inferred")
        )
    )


def composite_links(rows: DataFrame) -> DataFrame:
    """One row per constraint; its columns in position order (a handful per constraint)."""
    parts = F.array_sort(F.collect_list(F.struct("position", "column", "ref_column")))
    return rows.groupBy("database", "table", "constraint", "ref_table").agg(parts.alias("parts")).select(
        "database",
        "table",
        "constraint",
        "ref_table",
        F.col("parts.column").alias("columns"),
        F.col("parts.ref_column").alias("ref_columns"),
    )
