"""Cell rules: null words, storable values, declared types, result cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from schemaloom.functions.text import strip

# Words that stand for a missing value.
NULL_WORDS = ["", "null", "none", "nan", "na", "n/a"]
EXACT_NULL_WORDS = ["NULL", "null", "None", "none"]

MAX_BINARY_BYTES = 64 * 1024
MAX_CELL_CHARS = 5000

SAFE_TYPE = r"^[A-Za-z][A-Za-z ]{0,30}(\(\s*\d{1,4}(\s*,\s*\d{1,4})?\s*\))?$"


def null_words_to_null(text: Column) -> Column:
    return F.when(~F.lower(strip(text)).isin(NULL_WORDS), text)


def exact_null_words_to_null(text: Column) -> Column:
    return F.when(~text.isin(EXACT_NULL_WORDS), text)


def affinity(declared: Column) -> Column:
    """Storage class of a declared type, by the substrings it contains."""
    name = F.upper(declared)
    return (
        F.when(name.contains("INT"), "INTEGER")
        .when(name.rlike("CHAR|CLOB|TEXT"), "TEXT")
        .when(name.contains("BLOB") | (name == ""), "BLOB")
        .when(name.rlike("REAL|FLOA|DOUB"), "REAL")
        .otherwise("NUMERIC")
    )


def declared_type(declared: Column) -> Column:
    """Display form of a declared type; unusual text falls back to its affinity."""
    text = F.regexp_replace(strip(F.coalesce(declared, F.lit(""))), r"\s+", " ")
    return (
        F.when(text == "", "ANY").when(text.rlike(SAFE_TYPE), F.upper(text)).otherwise(affinity(text))
    )


def storable(column: Column, data_type: T.DataType) -> Column:
    """Value kept for a column of ``data_type`` when a table is taken in."""
    if isinstance(data_type, T.BooleanType):
        return column.cast("int")
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(column) & (F.abs(column) != float("inf")), column)
    if isinstance(data_type, T.DecimalType):
        return column.cast("double")
    if isinstance(data_type, T.BinaryType):
        return F.when(F.length(column) <= MAX_BINARY_BYTES, column)
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(column, "yyyy-MM-dd HH:mm:ss")
    if isinstance(data_type, T.DateType):
        return F.date_format(column, "yyyy-MM-dd")
    if isinstance(data_type, (T.IntegralType, T.StringType)):
        return column
    return column.cast("string")


def result_cell(column: Column, data_type: T.DataType) -> Column:
    """Value shown to a reader: numbers and booleans stay, the rest becomes bounded text."""
    if isinstance(data_type, (T.BooleanType, T.IntegralType, T.DoubleType, T.FloatType)):
        return column
    if isinstance(data_type, T.BinaryType):
        text = F.make_valid_utf8(column.cast("string"))
    else:
        text = column.cast("string")
    return F.when(
        F.length(text) > MAX_CELL_CHARS, F.concat(F.substring(text, 1, MAX_CELL_CHARS), F.lit("..."))
    ).otherwise(text)


def comparable_cell(column: Column, data_type: T.DataType, digits: int = 6) -> Column:
    """Text under which two result cells are compared; doubles use a fixed number of digits."""
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        return F.round(column, digits).cast(f"decimal(38,{digits})").cast("string")
    if isinstance(data_type, T.BinaryType):
        return F.make_valid_utf8(column.cast("string"))
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss")
    return column.cast("string")
