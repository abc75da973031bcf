"""Guarded SELECT and the shape in which results are shown."""

from __future__ import annotations

import re
import threading
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from schemaloom.functions.rules import keyword_view
from schemaloom.functions.values import result_cell
from schemaloom.operators.audit import judge_statements
from schemaloom.runtime import small_frame

MAX_ROWS = 1_000
TIMEOUT_SECONDS = 10.0
MAX_KEY_CHARS = 200
PAGE_ROWS = 20


# Names that may stand before a bracket: functions that read nothing but their arguments, types, keywords.
ALLOWED_CALLS = frozenset(
    """
    abs avg cast ceil ceiling char_length coalesce concat concat_ws count date date_add date_format date_sub
    current_date current_timestamp datediff day dayofmonth dayofweek dense_rank exp extract first_value floor
    greatest hour if ifnull instr isnotnull isnull lag now std
    last_value lead least left length ln locate log lower lpad ltrim max min minute mod month ntile nullif nvl
    power quarter rank replace reverse right round row_number rpad rtrim second sign sqrt stddev substr substring
    sum to_date trim truncate try_cast upper variance year
    decimal numeric varchar
    all and any as between by case distinct else except exists from having in inner intersect interval is join
    like not on or order over partition select some then union using values when where with
    """.split()
)
CALL = r"([A-Za-z_][A-Za-z0-9_]*|`)\s*\("
# Files named as tables, context words that need no bracket, comments that hide a bracket.
SPARK_ONLY = r"(?i)\b(?:avro|binaryfile|csv|delta|json|orc|parquet|text|xml)\s*\.\s*`|\bcurrent_(?:user|schema|database|catalog)\b|\bsession_user\b|/\*|--"
# Expressions of an analysed statement that tell about the session or its files, however they were written.
SESSION_FACTS = frozenset(
    """
    CallMethodViaReflection CurrentCatalog CurrentDatabase CurrentUser InputFileBlockLength InputFileBlockStart
    InputFileName SparkVersion TryReflect
    """.split()
)


class Refused(ValueError):
    """The statement did not pass the rules."""


@dataclass
class Result:
    columns: list[str]
    rows: list[tuple]
    truncated: bool


def check_statement(spark: SparkSession, sql: str, database: str) -> None:
    verdict = judge_statements(small_frame(spark, [(sql, database)], "sql string, database string")).first()
    if not verdict["allowed"]:
        raise Refused(f"{verdict['category']}: {verdict['reason']}")
    _check_calls(spark, sql)


def _check_calls(spark: SparkSession, sql: str) -> None:
    """The rules know the functions of a database server; the statement runs on Spark, which has more."""
    view = keyword_view(F.col("sql"))
    calls = F.transform(F.regexp_extract_all(view, F.lit(CALL), F.lit(1)), F.lower)
    found = small_frame(spark, [(sql,)], "sql string").select(calls.alias("calls"), view.alias("view")).first()
    refused = sorted(set(found["calls"]) - ALLOWED_CALLS)
    if refused:
        raise Refused(f"function_not_allowed: {', '.join(refused)}")
    if re.search(SPARK_ONLY, found["view"]):
        raise Refused("function_not_allowed: files, session facts and comments are refused")


def guarded_select(spark: SparkSession, sql: str, database: str) -> DataFrame:
    """The statement as a DataFrame, after the rules have allowed it."""
    check_statement(spark, sql, database)
    frame = spark.sql(sql.strip().rstrip(";"))
    _check_plan(frame)
    return frame


def _check_plan(frame: DataFrame) -> None:
    """Refuse what only analysis can tell: ``user`` is a column where the tables have one, else the account."""
    plan = frame._jdf.queryExecution().analyzed().toJSON()
    found = {name.rsplit(".", 1)[-1] for name in re.findall(r'"class":"([\w.$]+)"', plan)} & SESSION_FACTS
    if found:
        raise Refused(f"function_not_allowed: {', '.join(sorted(found))}")


def run_capped(
    spark: SparkSession, sql: str, database: str, max_rows: int = MAX_ROWS, timeout: float = TIMEOUT_SECONDS
) -> Result:
    """Rows up to the cap and whether there were more; its jobs are cancelled after ``timeout``."""
    frame = guarded_select(spark, sql, database).limit(max_rows + 1)
    sc = spark.sparkContext
    tag = f"guarded-{uuid.uuid4().hex}"
    timed_out = threading.Event()

    def stop():
        timed_out.set()
        sc.cancelJobsWithTag(tag)

    timer = threading.Timer(timeout, stop)
    sc.addJobTag(tag)
    timer.start()
    try:
        fetched = [tuple(r) for r in frame.collect()]
    except Exception as error:
        if timed_out.is_set():
            raise TimeoutError("Query exceeded the time limit and was cancelled.") from error
        raise
    finally:
        timer.cancel()
        sc.removeJobTag(tag)
    return Result(frame.columns, fetched[:max_rows], len(fetched) > max_rows)


def shown_rows(frame: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Result as it is shown: short keys, bounded cells; all rows, or at most ``max_rows``."""
    cells = [
        result_cell(F.col(f"`{f.name}`"), f.dataType).alias(f.name[:MAX_KEY_CHARS]) for f in frame.schema.fields
    ]
    shown = frame.select(*cells)
    return shown if max_rows is None else shown.limit(max_rows)


def page(frame: DataFrame, number: int, order: list, per_page: int = PAGE_ROWS) -> DataFrame:
    """Rows of one page (from 0) in a declared order.

    Only the first ``(number + 1) * per_page`` rows are ever sorted together.
    """
    head = frame.orderBy(*order).limit((number + 1) * per_page)
    rn = F.row_number().over(Window.orderBy(*order))
    return head.withColumn("__rn", rn).filter(F.col("__rn") > number * per_page).drop("__rn")


def result_json(frame: DataFrame, query: str, order: list[str], max_rows: int | None = None) -> DataFrame:
    """(query, json): the rows of each query, or the first ``max_rows``, as one JSON text."""
    values = [c for c in frame.columns if c != query and c not in order] + order
    numbered = frame.withColumn("__rn", F.row_number().over(Window.partitionBy(query).orderBy(*order)))
    rows = F.array_sort(F.collect_list(F.struct("__rn", F.struct(*values).alias("row"))))
    return (
        (numbered if max_rows is None else numbered.filter(F.col("__rn") <= max_rows))
        .groupBy(query)
        .agg(F.to_json(F.transform(rows, lambda r: r["row"])).alias("json"))
    )
