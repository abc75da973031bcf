"""Scoring predicted results against gold results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from schemaloom.functions.rules import has_order_by
from schemaloom.functions.text import clean_sql, normal_sql, strip
from schemaloom.functions.values import comparable_cell
from schemaloom.runtime import broadcast_if_small, materialise

# Accepted headers of a gold question file, in order of preference.
DATABASE_HEADERS = ["database", "db_id", "db", "database_id"]
QUESTION_HEADERS = ["question", "natural_language", "nl_question"]
SQL_HEADERS = ["query", "sql", "gold_sql", "gold_query"]

# Columns of an evaluation result file.
RESULT_COLUMNS = [
    "index", "database", "question", "gold_sql", "predicted_sql", "gold_result", "predicted_result",
    "sql_exact_match", "execution_correct", "validation_valid", "validation_message", "execution_error",
    "rag_tables", "clarification_clear", "clarification_question", "latency_seconds", "llm_calls", "status",
]

PREDICTION_FAILURES = ["validation_failed", "execution_failed", "error", "rag_retrieval_failed"]
NO_CONTEXT = "\nNo schema context retrieved."


def _header(columns: list[str], accepted: list[str], what: str) -> str:
    present = {c.strip().lower(): c for c in columns}
    for name in accepted:
        if name in present:
            return present[name]
    raise ValueError(f"Could not find {what} column. Expected one of: " + ", ".join(accepted))


def gold_questions(rows: DataFrame, index: str) -> DataFrame:
    """(index, database, question, gold_sql) from a file with any accepted header."""
    database = _header(rows.columns, DATABASE_HEADERS, "database")
    question = _header(rows.columns, QUESTION_HEADERS, "question")
    sql = _header(rows.columns, SQL_HEADERS, "SQL")
    text = {name: strip(F.coalesce(F.col(f"`{name}`"), F.lit(""))) for name in (database, question, sql)}
    return rows.filter((text[database] != "") & (text[question] != "") & (text[sql] != "")).select(
        F.col(index).alias("index"),
        text[database].alias("database"),
        text[question].alias("question"),
        clean_sql(text[sql]).alias("gold_sql"),
    )


def comparable_rows(frame: DataFrame, value_columns: list[str], digits: int = 6) -> Column:
    """The row as an array of texts, by position; names do not matter."""
    return F.array(*[comparable_cell(F.col(c), frame.schema[c].dataType, digits) for c in value_columns])


def same_in_order(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """(query, matches) where rows (query, position, row) agree at every position."""
    p = predicted.select("query", "position", F.struct("row").alias("p"))
    g = gold.select("query", "position", F.struct("row").alias("g"))
    return (
        p.join(g, ["query", "position"], "full")
        .groupBy("query")
        .agg(F.bool_and(F.col("p").eqNullSafe(F.col("g"))).alias("matches"))
    )


def same_as_bag(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """(query, matches) where rows (query, row) occur equally often on both sides.

    Rows are counted with their sign in one aggregate, so the two sides are never joined
    and equal rows are combined before the shuffle. Null cells are equal to null cells.
    """
    signed = predicted.select("query", "row", F.lit(1).alias("n")).unionByName(
        gold.select("query", "row", F.lit(-1).alias("n"))
    )
    return (
        signed.groupBy("query", "row")
        .agg(F.sum("n").alias("n"))
        .groupBy("query")
        .agg((F.max(F.abs("n")) == 0).alias("matches"))
    )


def results_match(predicted: DataFrame, gold: DataFrame, statements: DataFrame) -> DataFrame:
    """(query, matches): by position when either statement orders its rows, else as a bag.

    ``statements`` has (query, predicted_sql, gold_sql, predicted_ok, gold_ok); a result
    that is missing altogether never matches, and two empty results do.
    """
    ordered = statements.select(
        "query", (has_order_by(F.col("predicted_sql")) | has_order_by(F.col("gold_sql"))).alias("ordered")
    )
    flags = broadcast_if_small(ordered)
    p, g = predicted.join(flags, "query"), gold.join(flags, "query")
    by_position = same_in_order(p.filter("ordered"), g.filter("ordered"))
    as_bag = same_as_bag(p.filter("not ordered"), g.filter("not ordered"))
    return statements.join(by_position.unionByName(as_bag), "query", "left").select(
        "query",
        (F.col("predicted_ok") & F.col("gold_ok") & F.coalesce("matches", F.lit(True))).alias("matches"),
    )


def exact_match(predicted_sql: Column, gold_sql: Column) -> Column:
    return normal_sql(predicted_sql) == normal_sql(gold_sql)


def status(row_error: Column) -> Column:
    """Status of a question from its flags; ``row_error`` is the text of a failure outside SQL."""
    upper = F.upper(row_error)
    quota = row_error.rlike("QUOTA_FAILURE|RESOURCE_EXHAUSTED|429|(?i:quota)")
    unavailable = row_error.contains("503") | upper.contains("UNAVAILABLE")
    return (
        F.when(F.col("gold_error") != "", "gold_execution_failed")
        .when(~F.col("has_context"), "rag_retrieval_failed")
        .when((row_error != "") & quota, "quota_failure")
        .when((row_error != "") & unavailable, "service_unavailable")
        .when(row_error != "", "error")
        .when(~F.col("validation_valid"), "validation_failed")
        .when(F.col("execution_error") != "", "execution_failed")
        .when(F.col("execution_correct"), "correct")
        .otherwise("incorrect")
    )


def summary(results: DataFrame) -> DataFrame:
    """Totals, rates in percent, failure groups, mean latency and calls; safe on no rows."""
    total = F.count(F.lit(1))

    def rate(name: str) -> Column:
        return F.round(F.coalesce(F.try_divide(F.count_if(F.col(name)) * 100.0, total), F.lit(0.0)), 2)

    def having(*names: str) -> Column:
        return F.count_if(F.col("status").isin(*names))

    latency = F.sum(F.coalesce("latency_seconds", F.lit(0.0)))
    return results.agg(
        total.alias("total"),
        F.count_if("sql_exact_match").alias("exact"),
        rate("sql_exact_match").alias("exact_percent"),
        F.count_if("execution_correct").alias("execution"),
        rate("execution_correct").alias("execution_percent"),
        F.count_if("validation_valid").alias("valid"),
        rate("validation_valid").alias("valid_percent"),
        having(*PREDICTION_FAILURES).alias("prediction_failures"),
        having("quota_failure").alias("quota_failures"),
        having("service_unavailable").alias("service_unavailable"),
        having("gold_execution_failed").alias("gold_failures"),
        F.round(F.coalesce(F.try_divide(latency, total), F.lit(0.0)), 3).alias("mean_latency"),
        F.coalesce(F.sum("llm_calls"), F.lit(0)).alias("llm_calls"),
    )


def resume(inputs: DataFrame, done: DataFrame) -> DataFrame:
    """Inputs whose index is not among the finished results."""
    return inputs.join(done.select("index").distinct(), "index", "left_anti")


def merge_results(inputs: DataFrame, done: DataFrame, fresh: DataFrame) -> DataFrame:
    """Finished and fresh results of the inputs, in input order."""
    kept = done.join(inputs.select("index"), "index", "left_semi")
    return kept.unionByName(fresh).orderBy("index")


def first_n(inputs: DataFrame, n: int) -> DataFrame:
    """The first ``n`` questions by index; 0 keeps all."""
    return inputs.orderBy("index").limit(n) if n > 0 else inputs


def table_list(value: Column) -> Column:
    """Names from a JSON list, or text split at ``|``, or at ``,``, or a single name."""
    text = strip(F.coalesce(value, F.lit("")))
    # A JSON list is read permissively; its items are kept as text.
    parsed = F.from_json(text, "array<string>")
    is_list = text.startswith("[") & parsed.isNotNull()
    parts = (
        F.when(is_list, parsed)
        .when(text.contains("|"), F.split(text, r"\|"))
        .when(text.contains(","), F.split(text, ","))
        .otherwise(F.array(text))
    )
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def lookup_context(questions: DataFrame, documents: DataFrame, hits: DataFrame) -> DataFrame:
    """(q_id, source, contexts): recorded tables, else vector hits, else a fixed line.

    ``questions`` has (q_id, database, tables); ``hits`` has (q_id, id, rank), the vector
    hits inside the question's database. Lists are as short as the recorded tables or ``k``.
    """
    texts = documents.select("id", "text").filter("text <> ''")
    named = questions.select("q_id", "database", F.posexplode("tables").alias("rank", "name")).select(
        "q_id", F.concat_ws("::", "database", strip(F.col("name"))).alias("id"), "rank", F.lit(1).alias("stage")
    )
    wanted = named.unionByName(hits.select("q_id", "id", "rank", F.lit(2).alias("stage")))
    listed = F.array_sort(F.collect_list(F.struct("stage", "rank", "text")))
    found = (
        wanted.join(broadcast_if_small(texts), "id").groupBy("q_id").agg(listed.alias("found"))
    )
    best = F.filter("found", lambda x: x["stage"] == F.col("found")[0]["stage"])
    return questions.join(found, "q_id", "left").select(
        "q_id",
        F.when(F.col("found").isNull(), "none")
        .when(F.col("found")[0]["stage"] == 1, "recorded")
        .otherwise("vector")
        .alias("source"),
        F.coalesce(
            F.transform(best, lambda x: x["text"]),
            F.array(F.concat(F.lit("DATABASE: "), "database", F.lit(NO_CONTEXT))),
        ).alias("contexts"),
    )


def metric_means(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, mean, n): texts that are not numbers are left out; no numbers gives ``N/A``."""
    values = rows.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(m).alias("metric"), F.col(m).cast("string").try_cast("double").alias("value"))
                    for m in metrics
                ]
            )
        )
    )
    clean = F.when(~F.isnan("value"), F.col("value"))
    return values.groupBy("metric").agg(
        F.when(F.count(clean) > 0, F.format_string("%.4f", F.avg(clean))).otherwise("N/A").alias("mean"),
        F.count(clean).alias("n"),
    )


def numbered(rows: DataFrame, query: str, order: list[str]) -> DataFrame:
    """Positions (from 1) of the rows of each query in a declared order.

    Rows are range-partitioned by query and order, numbered inside each range, and shifted
    by the rows of the earlier ranges. A query with very many rows spans many ranges, so it
    is never sorted in one task. The ranges are written once, as two steps read them.
    """
    ranged = materialise(rows.repartitionByRange(query, *order).withColumn("__range", F.spark_partition_id()))
    inside = Window.partitionBy(query, "__range").orderBy(*order)
    before = Window.partitionBy(query).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(query, "__range")
        .agg(F.count(F.lit(1)).alias("__n"))
        .select(query, "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    )
    return (
        ranged.withColumn("__inside", F.row_number().over(inside))
        .join(offsets, [query, "__range"])
        .withColumn("position", F.col("__before") + F.col("__inside"))
        .drop("__range", "__inside", "__before")
    )
