"""Which database and which tables a question needs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from schemaloom.functions.text import plain_name
from schemaloom.runtime import broadcast_if_small

SHOWN_DATABASES = 5
MAX_TABLES, MAX_USER_TABLES, FALLBACK_TABLES = 5, 8, 3
BRIDGE_MIN_SCORE = 2

# Pairs of tables whose linking tables are always added.
FORCED_PAIRS = [("student", "course")]


def route(questions: DataFrame, scores: DataFrame, databases: DataFrame) -> DataFrame:
    """One decision per question: the database, or a question back with the likely ones.

    ``scores`` holds (q_id, database, score) for pairs that score; every other database
    counts as 0. At most five names per question are kept while ranking.
    """
    ordered = databases.select("database").distinct().orderBy(F.lower("database"), "database")
    first_names = [r[0] for r in ordered.limit(SHOWN_DATABASES).collect()]
    if not first_names:
        raise ValueError("No databases to route to.")
    single = len(first_names) == 1

    same = Window.partitionBy("q_id", "name").orderBy(F.desc("score"), F.lower("database"))
    ranking = Window.partitionBy("q_id").orderBy(F.desc("score"), F.lower("database"))
    top = (
        scores.filter("score > 0")
        .withColumn("name", plain_name(F.col("database")))
        .withColumn("copy", F.row_number().over(same))
        .filter("copy = 1")
        .withColumn("rank", F.row_number().over(ranking))
        .filter(F.col("rank") <= SHOWN_DATABASES)
        .groupBy("q_id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "database", "score"))).alias("top"))
    )
    hits = F.coalesce(F.col("top.database"), F.array().cast("array<string>"))
    unscored = F.array_except(F.array(*[F.lit(n) for n in first_names]), hits)
    best = F.coalesce(F.try_element_at("top.score", F.lit(1)), F.lit(0))
    second = F.coalesce(F.try_element_at("top.score", F.lit(2)), F.lit(0))
    confident = (best > 0) & (F.lit(single) | (best > second))
    candidates = F.slice(F.concat(hits, unscored), 1, SHOWN_DATABASES)
    return (
        questions.select("q_id")
        .join(top, "q_id", "left")
        .select(
            "q_id",
            F.when(confident, F.try_element_at(hits, F.lit(1))).otherwise("").alias("database"),
            candidates.alias("candidates"),
            best.alias("best_score"),
            second.alias("second_score"),
            F.when(confident, "")
            .otherwise(
                F.concat(
                    F.lit("Which database should I query? Available likely matches are: "),
                    F.array_join(candidates, ", "),
                    F.lit("."),
                )
            )
            .alias("question_back"),
        )
    )


def select_tables(ranked: DataFrame, user_databases: bool = False) -> DataFrame:
    """Adds ``selected`` (rank, table, score): the positive tables up to the limit, else the first three.

    ``ranked`` has one row (q_id, database, tables) per question; everything up to the
    context is decided inside that row, without a shuffle.
    """
    limit = MAX_USER_TABLES if user_databases else MAX_TABLES
    ordered = F.array_sort(
        F.transform("tables", lambda t: F.struct((-t["score"]).alias("minus"), t["table"].alias("table")))
    )
    ranked = ranked.withColumn("__ordered", ordered)
    positive = F.filter("__ordered", lambda t: t["minus"] < 0)
    picked = F.when(F.size(positive) > 0, F.slice(positive, 1, limit)).otherwise(
        F.slice("__ordered", 1, FALLBACK_TABLES)
    )
    selected = F.transform(
        picked,
        lambda t, i: F.struct((i + 1).alias("rank"), t["table"].alias("table"), (-t["minus"]).alias("score")),
    )
    return ranked.withColumn("selected", selected).drop("__ordered")


def link_graph(links: DataFrame) -> DataFrame:
    """Tables and the set of tables each refers to (bounded by the columns of a table)."""
    return (
        links.select(
            "database", plain_name(F.col("table")).alias("table"), plain_name(F.col("ref_table")).alias("ref")
        )
        .groupBy("database", "table")
        .agg(F.array_sort(F.collect_set("ref")).alias("refs"))
    )


def add_bridges(
    selected: DataFrame, links: DataFrame, pairs: list[tuple[str, str]] = FORCED_PAIRS
) -> DataFrame:
    """Adds ``bridges`` and ``forced``: unselected tables that connect selected ones.

    A bridge refers to at least two selected tables with a score of 2 or more. A forced
    bridge refers to both tables of a named pair that the question selected. The links of
    a database arrive as one small row.
    """
    edges = links.groupBy("database", "table").agg(F.collect_set(F.lower("ref_table")).alias("refs"))
    graph = edges.groupBy("database").agg(F.array_sort(F.collect_list(F.struct("table", "refs"))).alias("edges"))
    names = F.transform("selected", lambda t: F.lower(t["table"]))
    strong = F.transform(
        F.filter("selected", lambda t: t["score"] >= BRIDGE_MIN_SCORE), lambda t: F.lower(t["table"])
    )
    joined = (
        selected.join(broadcast_if_small(graph), "database", "left")
        .withColumn("__names", names)
        .withColumn("__strong", strong)
    )
    free = F.filter(
        F.coalesce("edges", F.array().cast("array<struct<table:string,refs:array<string>>>")),
        lambda e: ~F.array_contains(F.col("__names"), F.lower(e["table"])),
    )

    def both_ends(edge):
        met = F.lit(False)
        for a, b in pairs:
            chosen = F.array_contains("__names", a) & F.array_contains("__names", b)
            met = met | (chosen & F.array_contains(edge["refs"], a) & F.array_contains(edge["refs"], b))
        return met

    bridges = F.filter("__free", lambda e: F.size(F.array_intersect(e["refs"], F.col("__strong"))) >= 2)
    return (
        joined.withColumn("__free", free)
        .withColumn("bridges", F.transform(bridges, lambda e: e["table"]))
        .withColumn("forced", F.transform(F.filter("__free", both_ends), lambda e: e["table"]))
        .select(*selected.columns, "bridges", "forced")
    )


def assemble_context(chosen: DataFrame, documents: DataFrame) -> DataFrame:
    """(q_id, context, tables, chars): texts of the selected tables by score, then bridges.

    The texts of a database arrive as one small row; only names travel with a question.
    """
    texts = documents.groupBy("database").agg(
        F.map_from_entries(F.collect_list(F.struct("table", "text"))).alias("texts")
    )
    tables = F.array_distinct(F.concat("selected.table", "bridges", "forced"))
    context = F.array_join(F.transform("all_tables", lambda t: F.col("texts")[t]), "\n\n")
    return (
        chosen.withColumn("all_tables", tables)
        .join(broadcast_if_small(texts), "database")
        .select("q_id", context.alias("context"), F.col("all_tables").alias("tables"))
        .withColumn("chars", F.length("context"))
    )


def router_benchmark(questions: DataFrame, predictions: DataFrame, databases: int = 5) -> DataFrame:
    """Accuracy in percent on the first question of each of the first ``databases`` databases."""
    first = questions.groupBy("database").agg(F.min("q_id").alias("q_id"))
    chosen = first.orderBy("q_id").limit(databases)
    right = F.lower("predicted") == F.lower("database")
    return (
        chosen.join(predictions.select("q_id", F.col("database").alias("predicted")), "q_id", "left")
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(right).alias("correct"),
        )
        .withColumn("accuracy", F.round(F.try_divide(F.col("correct") * 100.0, "total"), 2))
    )
