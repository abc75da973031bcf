"""Sinks: appended tables, reconciled loads, the partitioned document store, result files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.operators.evaluation import RESULT_COLUMNS


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def replace(rows: DataFrame, path: str) -> None:
    """Drop and reload a table, or rebuild a whole index."""
    rows.write.mode("overwrite").parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def load_if_empty(rows: DataFrame, path: str) -> bool:
    """Append only to a target without rows; tells whether it did."""
    spark = rows.sparkSession
    if exists(spark, path) and not spark.read.parquet(path).isEmpty():
        return False
    append(rows, path)
    return True


def reconcile(source_counts: DataFrame, target_counts: DataFrame) -> DataFrame:
    """(table, source_rows, target_rows, matches) for counts (table, rows) of both sides."""
    s = source_counts.select("table", F.col("rows").alias("source_rows"))
    t = target_counts.select("table", F.col("rows").alias("target_rows"))
    zero = F.lit(0).cast("bigint")
    return s.join(t, "table", "full").select(
        "table",
        F.coalesce("source_rows", zero).alias("source_rows"),
        F.coalesce("target_rows", zero).alias("target_rows"),
        F.col("source_rows").eqNullSafe(F.col("target_rows")).alias("matches"),
    )


def require_reconciled(report: DataFrame) -> None:
    wrong = report.filter(~F.col("matches")).limit(20).collect()
    if wrong:
        raise ValueError("Row counts differ: " + ", ".join(r["table"] for r in wrong))


def load_report(loads: DataFrame) -> DataFrame:
    """Per database: ok, tables and rows, from one row (database, table, ok, rows) per table."""
    return loads.groupBy("database").agg(
        F.bool_and("ok").alias("ok"),
        F.count(F.lit(1)).alias("tables"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
    )


def load_totals(report: DataFrame) -> DataFrame:
    return report.agg(
        F.count_if("ok").alias("succeeded"),
        F.count_if(~F.col("ok")).alias("failed"),
        F.coalesce(F.sum("tables"), F.lit(0)).alias("tables"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
    )


# --- document store: one folder per database -----------------------------------------


def write_documents(documents: DataFrame, path: str) -> None:
    """Replace the documents of exactly the databases in ``documents``; others stay.

    Rebalancing gives each folder few files, and splits a very large database over tasks.
    """
    (
        documents.hint("rebalance", F.col("database"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("database")
        .parquet(path)
    )


def read_documents(spark: SparkSession, path: str, database: str | None = None) -> DataFrame:
    """All documents, or those of one database (read from its folder only)."""
    documents = spark.read.parquet(path)
    return documents if database is None else documents.filter(F.col("database") == database)


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """New rows, and the old rows whose id is not among them."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def lookup(documents: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return documents.join(ids.select(key), key, "left_semi")


def write_results(results: DataFrame, path: str) -> None:
    """Evaluation results as CSV with the fixed header; quotes inside a cell are doubled."""
    results.select(*RESULT_COLUMNS).write.mode("overwrite").csv(
        path,
        header=True,
        quote='"',
        escape='"',
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )
