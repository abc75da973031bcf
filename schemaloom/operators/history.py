"""Query history: append, retention, search and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEPT_PER_OWNER = 200
INTERNAL_COLUMNS = ["owner"]
SHOWN_BARS = 12


def newest_first(*prefix) -> list[Column]:
    return [*prefix, F.desc("ts"), F.desc("id")]


def append(history: DataFrame, fresh: DataFrame, now: Column) -> DataFrame:
    """History plus new rows: ids go on from the highest one, time is ``now``.

    New rows carry their arrival number ``arrival`` (1, 2, ...), so ids need no global
    sort; only the highest id, one number, is read ahead.
    """
    last = history.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    stamped = fresh.withColumn("id", F.col("arrival") + F.lit(last)).withColumn("ts", now).drop("arrival")
    return history.unionByName(stamped)


def retain(history: DataFrame, keep: int = KEPT_PER_OWNER) -> DataFrame:
    """The ``keep`` newest rows of each owner; the window limit cuts rows before the shuffle."""
    order = Window.partitionBy("owner").orderBy(*newest_first())
    return history.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= keep).drop("rn")


def visible(history: DataFrame) -> DataFrame:
    return history.drop(*INTERNAL_COLUMNS)


def of_owner(history: DataFrame, owner) -> DataFrame:
    return visible(history.filter(F.col("owner") == owner))


def counted_by_owner(history: DataFrame) -> DataFrame:
    """Every owner's number of rows and newest id."""
    return history.groupBy("owner").agg(
        F.count(F.lit(1)).alias("count"), F.max_by("id", F.struct("ts", "id")).alias("newest_id")
    )


def one_item(history: DataFrame, requests: DataFrame) -> DataFrame:
    """Rows asked for by (owner, id); an id of another owner finds nothing."""
    return visible(history.join(requests.select("owner", "id"), ["owner", "id"], "left_semi"))


def without_items(history: DataFrame, requests: DataFrame) -> DataFrame:
    """History without the rows named by (owner, id)."""
    return history.join(requests.select("owner", "id"), ["owner", "id"], "left_anti")


def without_owners(history: DataFrame, owners: DataFrame) -> DataFrame:
    return history.join(owners.select("owner"), "owner", "left_anti")


def search(history: DataFrame, words: str, database: str = "all") -> DataFrame:
    """Rows whose question, statement or database contains the words, in one database or all."""
    value = words.strip().lower()
    found = F.lit(True)
    if value:
        parts = [F.lower(F.coalesce(c, F.lit(""))).contains(value) for c in ("question", "sql", "database")]
        found = parts[0] | parts[1] | parts[2]
    if database != "all":
        found = found & (F.col("database") == database)
    return history.filter(found)


def database_names(history: DataFrame) -> DataFrame:
    return history.filter("database is not null and database <> ''").select("database").distinct().orderBy("database")


def half_up(value: Column) -> Column:
    return F.floor(value + 0.5)


def totals(history: DataFrame) -> DataFrame:
    """Queries, rows and mean latency over all rows; a missing latency counts as 0."""
    latency = F.avg(F.coalesce("latency_ms", F.lit(0.0)))
    return history.agg(
        F.count(F.lit(1)).alias("queries"),
        F.coalesce(F.sum("row_count"), F.lit(0)).alias("rows"),
        F.coalesce(half_up(latency), F.lit(0)).alias("mean_latency"),
    )


def monitor_totals(history: DataFrame) -> DataFrame:
    """Rows, databases and mean latency over the rows that have one."""
    return history.agg(
        F.coalesce(F.sum("row_count"), F.lit(0)).alias("rows"),
        F.coalesce(half_up(F.avg("latency_ms")), F.lit(0)).alias("mean_latency"),
        F.count_distinct(F.when(F.col("database") != "", F.col("database"))).alias("databases"),
    )


def latest_bars(history: DataFrame, bars: int = SHOWN_BARS) -> DataFrame:
    """The latest rows, oldest first, with a bar height from 6 to 100."""
    latest = history.orderBy(*newest_first()).limit(bars)
    latency = F.coalesce("latency_ms", F.lit(0.0))
    highest = F.greatest(F.max(latency).over(Window.partitionBy()), F.lit(1.0))
    return latest.select("id", "ts", F.greatest(F.lit(6.0), latency / highest * 100).alias("height")).orderBy(
        "ts", "id"
    )


def named_like(databases: DataFrame, words: str) -> DataFrame:
    value = words.strip().lower()
    return databases.filter(F.lower("database").contains(value)) if value else databases
