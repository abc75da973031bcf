"""The catalogue of a set of databases: tables and columns as rows.

Column names and Spark types come from table metadata and never from the data,
so these frames are as small as the number of columns.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from schemaloom.runtime import small_frame

MAX_NAME_CHARS = 64

COLUMN_SCHEMA = (
    "database string, table string, original_table string, table_no int, "
    "column string, original_column string, column_no int, base_type string"
)


@dataclass
class Table:
    """One table of a database; ``original`` is the name it came with."""

    database: str
    name: str
    frame: DataFrame
    original: str = ""
    original_columns: list[str] = field(default_factory=list)
    declared_keys: list[str] = field(default_factory=list)

    def __post_init__(self):
        self.original = self.original or self.name
        self.original_columns = self.original_columns or list(self.frame.columns)


def safe_name(raw: str, fallback: str, used: set[str]) -> str:
    """A distinct ``[A-Za-z0-9_]`` name; ``used`` holds lower-case names already given."""
    ascii_text = unicodedata.normalize("NFKD", str(raw)).encode("ascii", "ignore").decode()
    name = "_".join(re.findall("[A-Za-z0-9]+", ascii_text)) or fallback
    if name[0].isdigit():
        name = f"{fallback}_{name}"
    name = name[:MAX_NAME_CHARS].rstrip("_") or fallback
    variants = (name if n == 1 else f"{name}_{n}" for n in range(1, len(used) + 2))
    chosen = next(v for v in variants if v.lower() not in used)
    used.add(chosen.lower())
    return chosen


def with_safe_names(database: str, original: str, frame: DataFrame, used: set[str]) -> Table:
    """Rename a table and its columns to safe names, keeping the originals beside them."""
    taken: set[str] = set()
    names = [safe_name(c, "col", taken) for c in frame.columns]
    return Table(
        database, safe_name(original, "table", used), frame.toDF(*names), original, list(frame.columns)
    )


def base_type(data_type: T.DataType) -> str:
    """Type known from the schema alone; ``infer_types`` refines it from the data."""
    if isinstance(data_type, (T.BooleanType, T.IntegralType)):
        return "INTEGER"
    if isinstance(data_type, (T.DoubleType, T.FloatType, T.DecimalType)):
        return "REAL"
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "DATETIME"
    if isinstance(data_type, T.BinaryType):
        return "BLOB"
    return "TEXT"


def columns_frame(spark: SparkSession, tables: list[Table]) -> DataFrame:
    rows = [
        (t.database, t.name, t.original, table_no, f.name, t.original_columns[i], i + 1, base_type(f.dataType))
        for table_no, t in enumerate(tables, 1)
        for i, f in enumerate(t.frame.schema.fields)
    ]
    return small_frame(spark, rows, COLUMN_SCHEMA)


def infer_types(tables: list[Table]) -> DataFrame:
    """(database, table, column, type): one map-side aggregate per table, one row out each."""
    parts = []
    for t in tables:
        verdicts, kinds = [], {}
        for f in t.frame.schema.fields:
            c = F.col(f"`{f.name}`")
            kind = kinds[f.name] = base_type(f.dataType)
            if kind == "REAL":
                value = c.cast("double")
                present = c.isNotNull() & ~F.isnan(value)
                whole = (value == F.rint(value)) & (F.abs(value) < float(2**53))
                ok = F.bool_and(F.when(present, whole))
            elif isinstance(f.dataType, T.DateType):
                ok = F.count(c) > 0
            elif kind == "DATETIME":
                ok = F.bool_and(c == F.date_trunc("day", c))
            else:
                continue
            verdicts.append(F.coalesce(ok, F.lit(False)).alias(f.name))
        flags = t.frame.agg(*verdicts, F.lit(1).alias("__one"))
        narrowed = {"REAL": ("INTEGER", "REAL"), "DATETIME": ("DATE", "DATETIME")}
        pairs = [
            F.struct(
                F.lit(name).alias("column"),
                F.when(F.col(f"`{name}`"), narrowed[kind][0]).otherwise(narrowed[kind][1]).alias("type")
                if kind in narrowed
                else F.lit(kind).alias("type"),
            )
            for name, kind in kinds.items()
        ]
        parts.append(
            flags.select(
                F.lit(t.database).alias("database"), F.lit(t.name).alias("table"), F.inline(F.array(*pairs))
            )
        )
    return union_all(parts)


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Balanced union, so that the plan stays shallow for many tables."""
    while len(frames) > 1:
        frames = [
            frames[i].unionByName(frames[i + 1]) if i + 1 < len(frames) else frames[i]
            for i in range(0, len(frames), 2)
        ]
    return frames[0]
