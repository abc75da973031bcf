"""SQL text of the schema index: the independent form the counterpart queries read.

Written per column from the table list, as a person would write it for DuckDB.
"""

from __future__ import annotations

from schemaloom.plans.inputs import TABLES, literal

# Column classes of the given tables; everything not listed is text.
INTEGERS = {
    "c_custkey", "c_nationkey", "o_orderkey", "o_custkey", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
    "p_partkey", "p_size", "s_suppkey", "s_nationkey", "n_nationkey", "n_regionkey", "r_regionkey", "doc_id",
    "n_chars", "quality", "toxic", "vec_id", "label", "item_id", "event_id", "user_id", "page_id", "conv_id", "turn",
}
REALS = {
    "c_acctbal", "o_totalprice", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "p_retailprice", "s_acctbal",
    "value",
}
TIMES = {"o_orderdate", "l_shipdate", "ts"}
ARRAYS = {"embedding"}


def each_column():
    for table_no, (database, table, source, columns) in enumerate(TABLES, 1):
        for column_no, (original, column) in enumerate(columns.items(), 1):
            yield table_no, database, table, source, column_no, original, column


def columns_sql() -> str:
    rows = ",\n    ".join(
        f"({literal(d)}, {literal(t)}, {literal(s)}, {tn}, {literal(c)}, {literal(o)}, {cn})"
        for tn, d, t, s, cn, o, c in each_column()
    )
    return (
        "columns_(database, tab, original_table, table_no, col, original_column, column_no) as (values\n    "
        f"{rows})"
    )


def types_sql() -> str:
    parts = []
    for _, d, t, s, _, o, c in each_column():
        head = f"select {literal(d)} as database, {literal(t)} as tab, {literal(c)} as col"
        if o in INTEGERS:
            parts.append(f"{head}, 'INTEGER' as type")
        elif o in REALS:
            parts.append(
                f"{head}, case when bool_and({o} = round({o}) and abs({o}) < 9007199254740992) "
                f"then 'INTEGER' else 'REAL' end as type from {s}"
            )
        elif o in TIMES:
            parts.append(
                f"{head}, case when bool_and({o} = date_trunc('day', {o})) then 'DATE' else 'DATETIME' end as type "
                f"from {s}"
            )
        else:
            parts.append(f"{head}, 'TEXT' as type")
    return "types_ as (\n  " + "\n  union all ".join(parts) + ")"


# Key-like columns among the first three of each table, in order.
KEY_TESTS = [
    ("shop", "customers", "customer", "c_custkey", "id"),
    ("shop", "customers", "customer", "c_nationkey", "nation_id"),
    ("shop", "orders", "orders", "o_orderkey", "order_id"),
    ("shop", "orders", "orders", "o_custkey", "customer_id"),
    ("shop", "lineitems", "lineitem", "l_orderkey", "order_id"),
    ("shop", "lineitems", "lineitem", "l_partkey", "part_id"),
    ("shop", "lineitems", "lineitem", "l_suppkey", "supplier_id"),
    ("shop", "parts", "part", "p_partkey", "id"),
    ("shop", "suppliers", "supplier", "s_suppkey", "id"),
    ("shop", "suppliers", "supplier", "s_nationkey", "nation_id"),
    ("shop", "nations", "nation", "n_nationkey", "id"),
    ("shop", "nations", "nation", "n_regionkey", "region_id"),
    ("shop", "regions", "region", "r_regionkey", "id"),
    ("library", "documents", "documents", "doc_id", "doc_id"),
    ("library", "labels", "labels", "doc_id", "doc_id"),
    ("library", "embeddings", "embeddings", "vec_id", "vec_id"),
    ("library", "benchmark", "benchmark", "item_id", "item_id"),
    ("web", "events", "events", "event_id", "event_id"),
    ("web", "events", "events", "user_id", "user_id"),
    ("web", "pages", "pages", "page_id", "page_id"),
    ("web", "conversations", "conversations", "conv_id", "conv_id"),
]


def profile_sql() -> str:
    return "profile_ as (\n  " + "\n  union all ".join(
        f"select {literal(d)} as database, {literal(t)} as tab, {literal(c)} as col, {n} as test_no, "
        f"count(*) as n_rows, count({o}) as non_null, count(distinct {o}) as n_distinct from {s}"
        for n, (d, t, s, o, c) in enumerate(KEY_TESTS)
    ) + ")"


KEYS_SQL = """
keys_ as (
  select database, tab, arg_min(col, test_no) as col from profile_
  where n_rows > 0 and n_rows = non_null and n_rows = n_distinct group by 1, 2
)"""

# (database, child, child column, parent, parent column) proposed by the naming rules, in
# the order child table, child column, parent table, parent column.
_ID_TABLES = ["customers", "parts", "suppliers", "nations", "regions"]
LINK_PAIRS = (
    [("shop", "customers", "id", p, "id") for p in _ID_TABLES if p != "customers"]
    + [("shop", "customers", "nation_id", "suppliers", "nation_id"), ("shop", "customers", "nation_id", "nations", "id")]
    + [("shop", "orders", "order_id", "lineitems", "order_id"), ("shop", "orders", "customer_id", "customers", "id")]
    + [("shop", "lineitems", "order_id", "orders", "order_id")]
    + [("shop", "lineitems", "part_id", "parts", "id"), ("shop", "lineitems", "supplier_id", "suppliers", "id")]
    + [("shop", "parts", "id", p, "id") for p in _ID_TABLES if p != "parts"]
    + [("shop", "suppliers", "id", p, "id") for p in _ID_TABLES if p != "suppliers"]
    + [("shop", "suppliers", "nation_id", "customers", "nation_id"), ("shop", "suppliers", "nation_id", "nations", "id")]
    + [("shop", "nations", "id", p, "id") for p in _ID_TABLES if p != "nations"]
    + [("shop", "nations", "region_id", "regions", "id")]
    + [("shop", "regions", "id", p, "id") for p in _ID_TABLES if p != "regions"]
    + [("library", "documents", "doc_id", "labels", "doc_id"), ("library", "labels", "doc_id", "documents", "doc_id")]
)


def _source(database: str, table: str, column: str) -> tuple[str, str]:
    for d, t, source, columns in TABLES:
        if (d, t) == (database, table):
            return source, next(o for o, c in columns.items() if c == column)
    raise KeyError(table)


def ratios_sql() -> str:
    parts = []
    for n, (d, child, ccol, parent, pcol) in enumerate(LINK_PAIRS):
        cs, co = _source(d, child, ccol)
        ps, po = _source(d, parent, pcol)
        parts.append(
            f"select {n} as pair, {literal(d)} as database, {literal(child)} as tab, {literal(ccol)} as col, "
            f"{literal(parent)} as ref_tab, {literal(pcol)} as ref_col, "
            f"(select count(*) = count({po}) and count(*) = count(distinct {po}) and count(*) > 0 from {ps}) as uniq, "
            f"(select count(*) from {cs} where {co} in (select {po} from {ps})) * 1.0::double / "
            f"(select count({co}) from {cs}) as ratio"
        )
    return "ratios_ as (\n  " + "\n  union all ".join(parts) + ")"


LINKS_SQL = """
links_ as (
  select database, tab, col, ref_tab, ref_col, ratio from (
    select *, row_number() over (partition by database, tab, col order by ratio desc, pair) as rn
    from ratios_ where uniq and ratio >= 0.9
  ) where rn = 1
)"""


def samples_sql() -> str:
    parts = []
    for _, d, t, s, _, o, c in each_column():
        if o in ARRAYS:
            continue
        parts.append(
            f"select {literal(d)} as database, {literal(t)} as tab, {literal(c)} as col, v, "
            f"row_number() over (order by v) as pos from (select distinct cast({o} as varchar) as v from {s} "
            f"where {o} is not null order by v limit 5)"
        )
    return "samples_ as (\n  " + "\n  union all ".join(parts) + ")"


def flat_sql(text: str, limit: int = 40) -> str:
    line = f"regexp_replace(regexp_replace({text}, '[\\x00-\\x1f\\x7f]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')"
    return f"case when length({line}) > {limit} then left({line}, {limit - 1}) || '…' else {line} end"


SHOWN_SQL = f"""
shown_ as (
  select database, tab, col, pos, replace({flat_sql("v")}, ',', ';') as v from samples_
  where {flat_sql("v")} <> ''
)"""

_LINES = """
lines_ as (
  select database, tab, 2 as s, 0 as o, 'TABLE: ' || tab as t from columns_ where column_no = 1
  union all select database, tab, 1, 0, 'DATABASE: ' || database from columns_ where column_no = 1
  union all select distinct database, tab, 3, 0, 'ORIGINAL NAME: ' || original_table from columns_
    where original_table <> tab
  union all select database, tab, 4, 0, 'COLUMNS:' from columns_ where column_no = 1
  union all select database, tab, 5, column_no, '- ' || col || ' (' || type || ')'
    from columns_ join types_ using (database, tab, col)
  union all select database, tab, 6, 0, 'ORIGINAL COLUMN NAMES: ' ||
      string_agg(col || ' = ' || original_column, '; ' order by column_no)
    from columns_ where original_column <> col group by database, tab
  union all select database, tab, 7, 0, 'PRIMARY KEYS: ' || col from keys_
  union all select distinct database, tab, 8, 0, 'FOREIGN KEYS:' from links_
  union all select database, tab, 9, column_no, '- ' || col || ' -> ' || ref_tab || '.' || ref_col || ' (inferred)'
    from links_ join columns_ using (database, tab, col)
  union all select distinct database, tab, 10, 0, 'SAMPLE VALUES:' from shown_
  union all select database, tab, 11, any_value(column_no), '- ' || col || ': ' || string_agg(v, ', ' order by pos)
    from shown_ join columns_ using (database, tab, col) group by database, tab, col
)"""

DOCS_SQL = """
docs_ as (
  select database || '::' || tab as id, database, tab, string_agg(t, chr(10) order by s, o) as text
  from lines_ group by database, tab
),
dbdocs_ as (
  select database as d_id, count(*) as table_count,
         'DATABASE: ' || database || chr(10) || chr(10) || string_agg(text, chr(10) || chr(10) order by tab) as text
  from (select database, tab, string_agg(t, chr(10) order by s, o) as text from lines_ where s <> 1
        group by database, tab)
  group by database
)"""


def with_index(*extra: str) -> str:
    """``with`` clause holding the whole index, followed by more parts."""
    parts = [
        columns_sql(), types_sql(), profile_sql(), KEYS_SQL, ratios_sql(), LINKS_SQL, samples_sql(), SHOWN_SQL,
        _LINES, DOCS_SQL, *extra,
    ]
    return "with " + ",\n".join(p.strip() for p in parts)
