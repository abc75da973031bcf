"""Guarded SELECT, result shaping and evaluation over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from schemaloom.functions.rules import has_order_by
from schemaloom.functions.text import normal_sql
from schemaloom.operators import evaluation, guarded
from schemaloom.plans.inputs import STATEMENTS_SQL, TABLES, filled, filled_sql, load, statements, tables
from schemaloom.plans.registered import query


def _views(spark, sf_dir):
    """The shop tables under their names, for statements that arrive as text."""
    for t in tables(spark, sf_dir):
        if t.database == "shop":
            t.frame.createOrReplaceTempView(t.name)


def _shop_sql() -> str:
    return ", ".join(
        f"{t} as (select {', '.join(f'{o} as {c}' for o, c in cols.items())} from {'main.' if t == s else ''}{s})"
        for d, t, s, cols in TABLES
        if d == "shop"
    )


def _guarded(spark, sf_dir, sql):
    _views(spark, sf_dir)
    return guarded.guarded_select(spark, sql, "shop")


# One statement per relational shape. The text is the same on both engines.
SHAPES = {
    "q5_filter_like_order": """
        SELECT id, name, balance FROM customers
        WHERE balance > 1000 AND name LIKE '%7%' AND segment <> 'BUILDING' ORDER BY balance, id""",
    "q6_inner_join": """
        SELECT T1.name, T2.order_id, T2.total_price FROM customers AS T1
        JOIN orders AS T2 ON T1.id = T2.customer_id WHERE T2.priority = '1-URGENT'""",
    "q6b_three_table_join": """
        SELECT T3.name AS nation, T1.segment, round(sum(T2.total_price), 2) AS total FROM customers AS T1
        JOIN orders AS T2 ON T1.id = T2.customer_id JOIN nations AS T3 ON T1.nation_id = T3.id
        GROUP BY T3.name, T1.segment""",
    "q7_group_having": """
        SELECT customer_id, count(*) AS n, round(sum(total_price), 2) AS total FROM orders
        GROUP BY customer_id HAVING count(*) > 10""",
    "q8_count_avg": """
        SELECT count(*) AS n, round(avg(CASE WHEN status = 'F' THEN total_price END), 2) AS mean_price FROM orders
        WHERE priority <> '5-LOW'""",
    "q9_common_table": """
        WITH spent AS (SELECT customer_id, sum(total_price) AS total FROM orders GROUP BY customer_id)
        SELECT name, round(total, 2) AS total FROM customers JOIN spent ON customers.id = spent.customer_id
        WHERE total > (SELECT avg(total) FROM spent)""",
    "q9b_recursive": """
        WITH RECURSIVE steps(n, quantity) AS (
          SELECT 1, CAST(max(quantity) AS DOUBLE) FROM lineitems
          UNION ALL SELECT n + 1, quantity / 2 FROM steps WHERE quantity > 1)
        SELECT n, quantity FROM steps""",
    "q10_in_subquery": """
        SELECT count(*) AS n FROM lineitems WHERE part_id IN (SELECT id FROM parts WHERE size > 40)""",
    "q11_distinct_limit": "SELECT DISTINCT segment FROM customers ORDER BY segment LIMIT 5",
}


def _shape_query(name: str, sql: str):
    with_shop = _shop_sql()
    text = sql.strip()
    if text.startswith("WITH RECURSIVE"):
        oracle = f"with recursive {with_shop}, {text.removeprefix('WITH RECURSIVE')}"
    elif text.startswith("WITH"):
        oracle = f"with {with_shop}, {text.removeprefix('WITH')}"
    else:
        oracle = f"with {with_shop} {text}"

    @query(name, oracle)
    def run(spark, sf_dir):
        if name == "q9b_recursive":
            # The rules refuse UNION, so a recursive statement is run beside them.
            _views(spark, sf_dir)
            return spark.sql(text)
        return _guarded(spark, sf_dir, text)

    return run


for _name, _sql in SHAPES.items():
    _shape_query(_name, _sql)


@query(
    "q1_capped_select",
    """with r as (select o_orderkey as order_id, o_totalprice as total_price, row_number() over (order by o_totalprice desc, o_orderkey) as rn
        from orders where o_orderstatus = 'F')
      select order_id, total_price, (select count(*) > 1000 from r) as truncated from r where rn <= 1000""",
)
def capped_select(spark, sf_dir):
    """Top rows by price up to the cap of a result, and whether there were more."""
    _views(spark, sf_dir)
    sql = "SELECT order_id, total_price FROM orders WHERE status = 'F' ORDER BY total_price DESC, order_id"
    found = guarded.run_capped(spark, sql, "shop", timeout=600)
    rows = [(*r, found.truncated) for r in found.rows]
    return spark.createDataFrame(rows, "order_id bigint, total_price double, truncated boolean")


@query(
    "q2_shown_cells",
    """select doc_id, case when length(text) > 5000 then left(text, 5000) || '...' else text end as text,
        case when length(text) > 5000 then left(text, 5000) || '...' else text end as body,
        n_chars > 100 as long, cast(n_chars / 7.0 as double) as ratio from documents""",
)
def shown_cells(spark, sf_dir):
    rows = load(spark, sf_dir, "documents").select(
        "doc_id",
        "text",
        F.encode("text", "UTF-8").alias("body"),
        (F.col("n_chars") > 100).alias("long"),
        (F.col("n_chars") / F.lit(7.0)).cast("double").alias("ratio"),
    )
    return guarded.shown_rows(rows, max_rows=None)


@query(
    "q3_page",
    """select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20 offset 60""",
)
def page(spark, sf_dir):
    rows = load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return guarded.page(rows, 3, [F.desc("o_totalprice"), F.asc("o_orderkey")])


@query(
    "q4_result_json",
    """select o_custkey, '[' || string_agg('{"priority":"' || o_orderpriority || '","order_id":' || o_orderkey || '}', ','
        order by o_orderkey) || ']' as json from orders group by o_custkey""",
)
def result_json(spark, sf_dir):
    rows = load(spark, sf_dir, "orders").select(
        "o_custkey", F.col("o_orderpriority").alias("priority"), F.col("o_orderkey").alias("order_id")
    )
    return guarded.result_json(rows, "o_custkey", ["order_id"])


# --- evaluation: one question per customer, its result is the customer's orders -------


def _gold(spark, sf_dir):
    return load(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("query"),
        F.col("o_orderkey").alias("key"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_totalprice").alias("price"),
        F.col("o_orderstatus").alias("status"),
    )


def _predicted(spark, sf_dir):
    """Gold rows with planted faults: dear orders are missing, some cheap prices are null."""
    gold = _gold(spark, sf_dir)
    cheap = (F.col("priority") == "5-LOW") & (F.col("price") < 20000)
    return gold.filter("price < 460000").withColumn("price", F.when(~cheap, F.col("price")))


def _rows(frame, order=None):
    """Comparable rows, with their positions when an order is named."""
    row = evaluation.comparable_rows(frame, ["priority", "price"]).alias("row")
    if order is None:
        return frame.select("query", row)
    return evaluation.numbered(frame, "query", order).select("query", "position", row)


GOLD_SQL = """
gold as (select o_custkey as query, o_orderkey as key, o_orderpriority as priority, o_totalprice as price,
         o_orderstatus as status from orders),
predicted as (select query, key, priority, case when not (priority = '5-LOW' and price < 20000) then price end as price,
         status from gold where price < 460000)"""

# Statements per customer; a fifth of them orders its rows.
ORDERED = ["SELECT 1", "SELECT 1 order by 1", "SELECT 1", "SELECT priority FROM orders", "SELECT borderby FROM orders"]


def _statements(spark, sf_dir):
    key = F.col("c_custkey")
    return load(spark, sf_dir, "customer").select(
        key.alias("query"),
        filled(ORDERED, F.pmod(key, F.lit(len(ORDERED)))).alias("predicted_sql"),
        F.lit("SELECT 1").alias("gold_sql"),
        (F.col("c_acctbal") > -800).alias("predicted_ok"),
        (F.col("c_acctbal") < 9900).alias("gold_ok"),
    )


BAG_SQL = """
bag as (
  select query, coalesce(max(abs(n)), 0) = 0 as matches from (
    select query, priority, price, sum(n) as n from (
      select query, priority, price, 1 as n from predicted union all select query, priority, price, -1 from gold)
    group by all) group by query)"""
ORDER_SQL = """
pp as (select query, row_number() over (partition by query order by status, key) as pos, priority, price from predicted),
gg as (select query, row_number() over (partition by query order by key) as pos, priority, price from gold),
ordered as (
  select coalesce(pp.query, gg.query) as query, bool_and(pp.query is not null and gg.query is not null
    and pp.priority is not distinct from gg.priority and pp.price is not distinct from gg.price) as matches
  from pp full join gg on pp.query = gg.query and pp.pos = gg.pos group by 1)"""


@query(
    "e1_comparable_rows",
    """select event_id, event_type || '|' || cast(cast(round(value, 6) as decimal(38,6)) as varchar) || '|' ||
        strftime(ts, '%Y-%m-%dT%H:%M:%S') || '|' || cast(user_id as varchar) || '|' || md5(props) as cells from events""",
)
def comparable(spark, sf_dir):
    rows = load(spark, sf_dir, "events")
    cells = evaluation.comparable_rows(rows, ["event_type", "value", "ts", "user_id"])
    return rows.select(
        "event_id", F.array_join(F.concat(cells, F.array(F.md5("props"))), "|").alias("cells")
    )


@query(
    "e2_has_order_by",
    rf"""with {STATEMENTS_SQL} select id, regexp_matches(sql, '(?i)\bORDER\s+BY\b') as ordered from statements""",
)
def order_by_flags(spark, sf_dir):
    return statements(spark, sf_dir).select("id", has_order_by(F.col("sql")).alias("ordered"))


@query("e3_same_in_order", f"with {GOLD_SQL}, {ORDER_SQL} select query, matches from ordered")
def same_in_order(spark, sf_dir):
    return evaluation.same_in_order(
        _rows(_predicted(spark, sf_dir), ["status", "key"]), _rows(_gold(spark, sf_dir), ["key"])
    )


@query("e4_same_as_bag", f"with {GOLD_SQL}, {BAG_SQL} select query, matches from bag")
def same_as_bag(spark, sf_dir):
    return evaluation.same_as_bag(_rows(_predicted(spark, sf_dir)), _rows(_gold(spark, sf_dir)))


MATCH_SQL = f"""
st as (select c_custkey as query, {filled_sql(ORDERED, f"c_custkey % {len(ORDERED)}")} as predicted_sql,
       c_acctbal > -800 and c_acctbal < 9900 as ok from customer),
matched as (
  select st.query, ok and coalesce(case when regexp_matches(predicted_sql, '(?i)\\border\\s+by\\b')
                                       then ordered.matches else bag.matches end, true) as matches
  from st left join bag using (query) left join ordered using (query))"""


def _matches(spark, sf_dir):
    return evaluation.results_match(
        _rows(_predicted(spark, sf_dir), ["status", "key"]),
        _rows(_gold(spark, sf_dir), ["key"]),
        _statements(spark, sf_dir),
    )


@query("e4b_results_match", f"with {GOLD_SQL}, {ORDER_SQL}, {BAG_SQL}, {MATCH_SQL} select query, matches from matched")
def results_match(spark, sf_dir):
    return _matches(spark, sf_dir)


NORMAL_SQL = r"""trim(replace(regexp_replace(lower(case when ends_with(S, ';') then S else S || ';' end), '\s+', ' ', 'g'), ' ;', ';'))""".replace(
    "S", r"regexp_replace(regexp_replace(sql, '(?i)```sql|```', '', 'g'), '^\s+|\s+$', '', 'g')"
)


@query(
    "e5_exact_match",
    rf"""with {STATEMENTS_SQL}, g as (select id, sql, case when id % 2 = 0 then upper(sql) || ' ;' else sql || '  ' || id end as gold from statements)
      select id, {NORMAL_SQL} as normal, {NORMAL_SQL} = {NORMAL_SQL.replace("(sql,", "(gold,")} as exact from g""",
)
def exact_match(spark, sf_dir):
    sql = F.col("sql")
    gold = F.when(F.pmod("id", F.lit(2)) == 0, F.concat(F.upper(sql), F.lit(" ;"))).otherwise(
        F.concat(sql, F.lit("  "), F.col("id").cast("string"))
    )
    return statements(spark, sf_dir).select(
        "id", normal_sql(sql).alias("normal"), evaluation.exact_match(sql, gold).alias("exact")
    )


ERRORS = ["", "", "", "", "HTTP 429 RESOURCE_EXHAUSTED", "Service Unavailable", "503", "Quota reached", "boom"]


def _results(spark, sf_dir):
    """One evaluation row per customer; flags come from the compared results and the balance."""
    balance, key = F.col("c_acctbal"), F.col("c_custkey")
    flags = load(spark, sf_dir, "customer").select(
        key.alias("query"),
        F.when(balance > 9500, "Gold SQL error").otherwise("").alias("gold_error"),
        (F.col("c_mktsegment") != "MACHINERY").alias("has_context"),
        filled(ERRORS, F.pmod(F.col("c_nationkey"), F.lit(len(ERRORS)))).alias("row_error"),
        (balance > 0).alias("validation_valid"),
        F.when(balance < 300, "no such column").otherwise("").alias("execution_error"),
        (F.pmod(key, F.lit(3)) == 0).alias("sql_exact_match"),
        F.when(balance > 500, F.round(balance / 1000, 3)).alias("latency_seconds"),
        F.pmod(key, F.lit(4)).alias("llm_calls"),
    )
    joined = flags.join(_matches(spark, sf_dir), "query").withColumnRenamed("matches", "execution_correct")
    return joined.withColumn("status", evaluation.status(F.col("row_error")))


RESULTS_SQL = f"""
flags as (
  select c_custkey as query, case when c_acctbal > 9500 then 'Gold SQL error' else '' end as gold_error,
    c_mktsegment <> 'MACHINERY' as has_context, {filled_sql(ERRORS, f"c_nationkey % {len(ERRORS)}")} as row_error,
    c_acctbal > 0 as validation_valid, case when c_acctbal < 300 then 'no such column' else '' end as execution_error,
    c_custkey % 3 = 0 as sql_exact_match, case when c_acctbal > 500 then round(c_acctbal / 1000, 3) end as latency_seconds,
    c_custkey % 4 as llm_calls from customer),
results as (
  select flags.*, matches as execution_correct, case when gold_error <> '' then 'gold_execution_failed'
    when not has_context then 'rag_retrieval_failed'
    when row_error <> '' and (contains(row_error, '429') or contains(lower(row_error), 'quota')
      or contains(row_error, 'RESOURCE_EXHAUSTED')) then 'quota_failure'
    when row_error <> '' and (contains(row_error, '503') or contains(upper(row_error), 'UNAVAILABLE')) then 'service_unavailable'
    when row_error <> '' then 'error' when not validation_valid then 'validation_failed'
    when execution_error <> '' then 'execution_failed' when matches then 'correct' else 'incorrect' end as status
  from flags join matched using (query))"""
ALL_RESULTS = f"with {GOLD_SQL}, {ORDER_SQL}, {BAG_SQL}, {MATCH_SQL}, {RESULTS_SQL}"


@query("e6_status", f"{ALL_RESULTS} select query, status from results")
def status(spark, sf_dir):
    return _results(spark, sf_dir).select("query", "status")


@query(
    "e7_summary",
    f"""{ALL_RESULTS} select count(*) as total, count(*) filter (sql_exact_match) as exact,
      round(count(*) filter (sql_exact_match) * 100.0 / count(*), 2) as exact_percent,
      count(*) filter (execution_correct) as execution,
      round(count(*) filter (execution_correct) * 100.0 / count(*), 2) as execution_percent,
      count(*) filter (validation_valid) as valid, round(count(*) filter (validation_valid) * 100.0 / count(*), 2) as valid_percent,
      count(*) filter (status in ('validation_failed', 'execution_failed', 'error', 'rag_retrieval_failed')) as prediction_failures,
      count(*) filter (status = 'quota_failure') as quota_failures,
      count(*) filter (status = 'service_unavailable') as service_unavailable,
      count(*) filter (status = 'gold_execution_failed') as gold_failures,
      round(sum(coalesce(latency_seconds, 0)) / count(*), 3) as mean_latency, cast(sum(llm_calls) as bigint) as llm_calls
      from results""",
)
def summary(spark, sf_dir):
    return evaluation.summary(_results(spark, sf_dir))


def _inputs(spark, sf_dir):
    return load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("index"), "o_custkey")


def _done(spark, sf_dir):
    return (
        load(spark, sf_dir, "orders")
        .filter("o_orderstatus = 'F'")
        .select(F.col("o_orderkey").alias("index"), F.lit("done").alias("state"))
    )


@query(
    "e8_resume",
    """select o_orderkey as "index", case when o_orderstatus = 'F' then 'done' else 'fresh' end as state,
      cast(row_number() over (order by o_orderkey) as bigint) as position from orders""",
)
def resume(spark, sf_dir):
    inputs, done = _inputs(spark, sf_dir), _done(spark, sf_dir)
    fresh = evaluation.resume(inputs, done).select("index", F.lit("fresh").alias("state"))
    merged = evaluation.merge_results(inputs, done, fresh)
    return evaluation.numbered(merged.withColumn("run", F.lit(0)), "run", ["index"]).drop("run")


@query("e9_first_n", """select o_orderkey as "index", o_custkey from orders order by o_orderkey limit 100""")
def first_n(spark, sf_dir):
    return evaluation.first_n(_inputs(spark, sf_dir), 100)


LISTS = ['["{a}", " {b} ", ""]', "{a}| {b} ||", "{a}, {b},", "  {a} ", "", '["{a}"', "[{n}, {n}]"]


@query(
    "e10_table_lists",
    rf"""with v as (select p_partkey, trim({filled_sql(LISTS, f"p_partkey % {len(LISTS)}", a="p_name", b="p_brand", n="p_size")}) as v from part),
      parts as (select p_partkey, case when json_valid(v) and v like '[%' then list_transform(json_extract_string(v, '$[*]'), lambda x: x)
        when contains(v, '|') then string_split(v, '|') when contains(v, ',') then string_split(v, ',') else [v] end as xs from v)
      select p_partkey, array_to_string(list_filter(list_transform(xs, lambda x: trim(x)), lambda x: x <> ''), ';') as names from parts""",
)
def table_lists(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    choice = F.pmod("p_partkey", F.lit(len(LISTS)))
    value = filled(LISTS, choice, a=F.col("p_name"), b=F.col("p_brand"), n=F.col("p_size"))
    return part.select("p_partkey", F.array_join(evaluation.table_list(value), ";").alias("names"))


@query(
    "e12_metric_means",
    """with m as (select 'faithfulness' as metric, try_cast(case when p_size < 10 then 'n/a' else cast(p_size as varchar) end as double) as v from part
        union all select 'answer_relevancy', p_retailprice / 1000 from part
        union all select 'context_precision', try_cast(p_brand as double) from part)
      select metric, coalesce(printf('%.4f', avg(v)), 'N/A') as mean, count(v) as n from m group by metric""",
)
def metric_means(spark, sf_dir):
    rows = load(spark, sf_dir, "part").select(
        F.when(F.col("p_size") < 10, "n/a").otherwise(F.col("p_size").cast("string")).alias("faithfulness"),
        (F.col("p_retailprice") / 1000).alias("answer_relevancy"),
        F.col("p_brand").alias("context_precision"),
    )
    return evaluation.metric_means(rows, rows.columns)
