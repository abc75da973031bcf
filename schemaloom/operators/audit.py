"""Batch scans of questions, SQL logs, answers and grant lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from schemaloom.functions import rules
from schemaloom.functions.text import strip
from schemaloom.runtime import broadcast_if_small

SAFE_PRIVILEGES = ["SELECT", "USAGE"]


def category_counts(frame: DataFrame, category: str = "category") -> DataFrame:
    return frame.groupBy(category).agg(F.count(F.lit(1)).alias("n"))


def _prepared(log: DataFrame) -> DataFrame:
    """Views of each statement, computed once per row and read by all rules."""
    sql, pieces = F.col("__sql"), F.col("__pieces")
    return (
        log.withColumn("__sql", strip(F.coalesce("sql", F.lit(""))))
        .withColumn("__pieces", rules.sql_pieces(sql))
        .withColumns(
            {
                "__active": F.lower(strip(F.col("database"))),
                "__keywords": F.upper(rules.keyword_view(sql, pieces)),
                "__identifiers": F.upper(rules.identifier_view(sql, pieces)),
                "__open": rules.has_open_quote(sql, pieces),
                "__others": rules.qualifying_databases(sql),
            }
        )
    )


def _danger() -> list[tuple[Column, Column]]:
    user_database = F.col("__active").rlike(rules.USER_DATABASE)
    return rules.dangerous_cases(
        F.col("__sql"), F.col("__keywords"), F.col("__identifiers"), F.col("__open"), user_database
    )


def judge_statements(log: DataFrame) -> DataFrame:
    """Adds ``allowed``, ``category`` and ``reason`` to statements (sql, database); row-local."""
    verdict = rules.statement_verdict(
        F.col("__sql"), F.col("__active"), F.col("__keywords"), _danger(), F.col("__others")
    )
    return _prepared(log).withColumn("__verdict", verdict).select(*log.columns, "__verdict.*")


def dangerous_statements(log: DataFrame) -> DataFrame:
    """Statements with a dangerous construct, with its category and reason."""
    return (
        _prepared(log)
        # Generated rows keep the filter above the rules, so that they run once per row.
        .select(*log.columns, F.inline_outer(F.array(rules.first_match(_danger(), F.lit(None)))))
        .filter("category is not null")
        .drop("allowed")
    )


def rule_pass_rate(cases: DataFrame, blocked: Column) -> DataFrame:
    """Blocked, total and the share blocked in percent."""
    return cases.agg(
        F.count_if(blocked).alias("blocked"),
        F.count(F.lit(1)).alias("total"),
        F.round(F.try_divide(F.count_if(blocked) * 100.0, F.count(F.lit(1))), 2).alias("percent"),
    )


def _first_word(text: Column, words: list[str], shape: str) -> Column:
    """First of ``words``, in list order, that occurs in ``text``; ``''`` for none."""
    return F.coalesce(*[F.when(text.rlike(shape % w), w) for w in words], F.lit(""))


def _tables_by_database(columns: DataFrame) -> DataFrame:
    """One row per database with its table names; a catalogue holds at most a few hundred."""
    return columns.groupBy("database").agg(F.collect_set(F.lower("table")).alias("known_tables"))


def check_read_only(log: DataFrame, columns: DataFrame) -> DataFrame:
    """Adds ``valid`` and ``message``: write words first, then tables that do not exist.

    Row-local after one join with the small per-database table list.
    """
    known = broadcast_if_small(_tables_by_database(columns))
    word = _first_word(F.upper("sql"), rules.WRITE_WORDS, r"\b%s\b")
    missing = F.array_sort(
        F.array_distinct(
            F.array_except(
                rules.referenced_tables(F.col("sql")), F.coalesce("known_tables", F.array().cast("array<string>"))
            )
        )
    )
    message = (
        F.when(word != "", F.concat(F.lit("Forbidden SQL operation: "), word))
        .when(
            F.size(missing) > 0,
            F.concat(F.lit("Tables not present in database: "), F.array_join(missing, ", ")),
        )
        .otherwise("SQL passed basic validation.")
    )
    return (
        log.join(known, "database", "left")
        .withColumn("message", message)
        .withColumn("valid", F.col("message") == "SQL passed basic validation.")
        .drop("known_tables")
    )


def check_against_catalogue(log: DataFrame, columns: DataFrame) -> DataFrame:
    """Adds ``valid`` and ``message``: write words, tables, database prefixes, then columns.

    The catalogue arrives as one small row per database (its tables and its
    ``table.column`` names), so a log of any size is checked without a shuffle.
    """
    shape = columns.groupBy("database").agg(
        F.collect_set(F.lower("table")).alias("known_tables"),
        F.collect_set(F.lower(F.concat_ws(".", "table", "column"))).alias("known_columns"),
    )
    shape = broadcast_if_small(shape)
    sql, no_names = F.col("sql"), F.array().cast("array<string>")
    known_tables = F.coalesce("known_tables", no_names)
    refused = _first_word(F.upper(sql), rules.WRITE_WORDS, "%s ")
    missing_tables = F.filter(rules.referenced_tables(sql), lambda t: ~F.array_contains(known_tables, t))
    prefixes = F.regexp_extract_all(
        sql, F.lit(r"(?i)(?:FROM|JOIN)\s+([A-Za-z0-9_]+)\.[A-Za-z0-9_]+"), F.lit(1)
    )
    foreign = F.filter(prefixes, lambda p: F.lower(p) != F.lower("database"))
    # Words after a table that are not its alias.
    not_alias = ["on", "where", "join", "left", "right", "inner", "outer", "group", "order", "limit"]
    aliases = F.filter(
        F.col("pairs"),
        lambda p: F.array_contains(known_tables, p["table"]) & ~p["alias"].isin(not_alias),
    )

    def resolved(reference: Column) -> Column:
        """``table.column`` behind ``prefix.column``; null when the prefix is unknown."""
        prefix, name = F.split_part(reference, F.lit("."), F.lit(1)), F.split_part(reference, F.lit("."), F.lit(2))
        declared = F.filter(F.col("aliases"), lambda p: p["alias"] == prefix)
        table = F.when(F.array_contains(known_tables, prefix), prefix).otherwise(
            F.try_element_at(declared, F.lit(-1))["table"]
        )
        return F.when(table.isNotNull(), F.concat_ws(".", table, name))

    used = F.array_compact(F.transform(rules.column_references(sql), resolved))
    missing_columns = F.array_sort(F.array_except(F.array_distinct(used), F.col("known_columns")))
    message = (
        F.when(refused != "", F.concat(F.lit("Forbidden SQL operation: "), refused))
        .when(
            F.size("missing_tables") > 0,
            F.concat(F.lit("Tables not present in database: "), F.array_join("missing_tables", ", ")),
        )
        .when(
            F.size("foreign") > 0,
            F.format_string(
                "SQL references database '%s' instead of '%s'.", F.try_element_at("foreign", F.lit(1)), "database"
            ),
        )
        .when(
            F.size("missing_columns") > 0,
            F.concat(F.lit("Columns not present in retrieved schema: "), F.array_join("missing_columns", ", ")),
        )
        .otherwise("SQL is valid.")
    )
    return (
        log.join(shape, "database", "left")
        .withColumn("pairs", rules.alias_pairs(sql))
        .withColumn("aliases", aliases)
        .withColumns({"missing_tables": missing_tables, "foreign": foreign, "missing_columns": missing_columns})
        .select(*log.columns, message.alias("message"))
        .withColumn("valid", F.col("message") == "SQL is valid.")
    )


def audit_grants(lines: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """Distinct findings (account, finding) for grant lines (account, line).

    ``allowed`` is the list of databases that may be read (column ``database``).
    """
    text = F.col("line")
    granted = r"(?is)^\s*GRANT\s+(.+?)\s+ON\s+(.+?)\s+TO\s"
    scoped = lines.select(
        "account",
        text.rlike(granted).alias("is_grant"),
        (text.rlike(r"(?is)^\s*GRANT\s+[^\s].*\s+TO\s") & ~text.rlike(granted)).alias("is_role"),
        F.regexp_replace(F.regexp_extract(text, granted, 1), r"\([^)]*\)", "").alias("privileges"),
        strip(F.regexp_extract(text, granted, 2)).alias("object"),
        text.rlike(r"(?i)\bWITH\s+GRANT\s+OPTION\b").alias("grant_option"),
    )
    name = F.regexp_replace(strip(F.split("object", r"\.").getItem(0)), "^[`'\"]+|[`'\"]+$", "")
    name = F.lower(F.replace(F.replace(name, F.lit("\\_"), F.lit("_")), F.lit("\\%"), F.lit("%")))
    is_global = F.col("object").isin("*.*", "*")
    privileges = F.array_distinct(
        F.filter(F.transform(F.split("privileges", ","), lambda p: F.upper(strip(p))), lambda p: p != "")
    )
    facts = scoped.select(
        "account",
        "is_grant",
        "is_role",
        "grant_option",
        is_global.alias("is_global"),
        F.when(~is_global, name).alias("database"),
        privileges.alias("privileges"),
    )
    if allowed is not None:
        listed = broadcast_if_small(allowed.select("database", F.lit(True).alias("listed")).distinct())
        facts = facts.join(listed, "database", "left")
        outside = F.col("listed").isNull()
    else:
        outside = F.lit(False)
    scope = F.when(F.col("is_global"), "all databases (*.*)").otherwise(
        F.concat(F.lit("database `"), "database", F.lit("`"))
    )
    excess = F.array_sort(F.array_except("privileges", F.array(*[F.lit(p) for p in SAFE_PRIVILEGES])))
    reads = F.array_contains("privileges", "SELECT")
    system = F.col("database").isin(rules.SYSTEM_DATABASES)
    own_grant = F.col("is_grant")
    findings = F.array_compact(
        F.array(
            F.when(
                F.col("is_role"),
                F.lit("The account has role grants that cannot be verified here; check them manually."),
            ),
            F.when(
                own_grant & (F.size(excess) > 0),
                F.concat(F.lit("Excess privileges on "), scope, F.lit(": "), F.array_join(excess, ", "), F.lit(".")),
            ),
            F.when(
                own_grant & F.col("grant_option"), F.concat(F.lit("GRANT OPTION is held on "), scope, F.lit("."))
            ),
            F.when(
                own_grant & reads & F.col("is_global"),
                F.lit("SELECT is granted on ALL databases (*.*), including the system schemas."),
            ),
            F.when(
                own_grant & reads & ~F.col("is_global") & system,
                F.concat(F.lit("SELECT is granted on the system schema `"), "database", F.lit("`.")),
            ),
        )
    )
    direct = facts.select("account", F.explode(findings).alias("finding")).distinct()
    names = (
        facts.filter(own_grant & reads & ~F.col("is_global") & ~system & outside)
        .select("account", "database")
        .distinct()
    )
    # Five names per account are shown; the rest is only counted.
    order = Window.partitionBy("account").orderBy("database")
    first = names.withColumn("rn", F.row_number().over(order)).filter("rn <= 5")
    listed = F.array_join(F.array_sort(F.collect_list("database")), ", ")
    shown = (
        first.groupBy("account")
        .agg(listed.alias("names"))
        .join(names.groupBy("account").agg(F.count(F.lit(1)).alias("n")), "account")
    )
    more = F.when(F.col("n") > 5, F.concat(F.lit(" (+"), (F.col("n") - 5).cast("string"), F.lit(" more)"))).otherwise("")
    beyond = shown.select(
        "account",
        F.concat(
            F.lit("SELECT is granted on databases outside the allow-list: "), "names", more, F.lit(".")
        ).alias("finding"),
    )
    return direct.unionByName(beyond)
