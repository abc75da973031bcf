"""Catalogue, profiling and schema documents over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from schemaloom.functions.text import flatten_text
from schemaloom.functions.values import (
    affinity,
    declared_type,
    exact_null_words_to_null,
    null_words_to_null,
    storable,
)
from schemaloom.operators import catalogue, documents, keys, registry
from schemaloom.plans import schema_sql as sx
from schemaloom.plans.inputs import filled, filled_sql, load, schema_index, tables
from schemaloom.plans.registered import query
from schemaloom.runtime import small_frame
from schemaloom.sources import readers

# Declared types as they appear in DDL; chosen per part.
DECLARED = [
    "varchar({size})", " int ", "unsigned  big int", "TEXT", "", "decimal(10, 2)", "double precision", "bool!",
    "point", "clob[{size}]", "datetime", "blob-{size}", "float#", "  ", "any", "tinyint({size})",
]
DECLARED_SQL = filled_sql(DECLARED, f"p_partkey % {len(DECLARED)}", size="p_size")
OTHER_SQL = filled_sql(DECLARED, f"(p_partkey + p_size) % {len(DECLARED)}", size="p_size")


def _declared(spark, sf_dir):
    n = F.lit(len(DECLARED))
    return load(spark, sf_dir, "part").select(
        "p_partkey",
        filled(DECLARED, F.pmod("p_partkey", n), size=F.col("p_size")).alias("declared"),
        filled(DECLARED, F.pmod(F.col("p_partkey") + F.col("p_size"), n), size=F.col("p_size")).alias("other"),
    )


def _affinity_sql(c: str) -> str:
    return (
        f"case when upper({c}) like '%INT%' then 'INTEGER' when regexp_matches(upper({c}), 'CHAR|CLOB|TEXT') then 'TEXT' "
        f"when upper({c}) like '%BLOB%' or {c} = '' then 'BLOB' "
        f"when regexp_matches(upper({c}), 'REAL|FLOA|DOUB') then 'REAL' else 'NUMERIC' end"
    )


@query(
    "c1_declared_types",
    rf"""
    with p as (select p_partkey, regexp_replace(trim({DECLARED_SQL}), '\s+', ' ', 'g') as d from part)
    select p_partkey, case when d = '' then 'ANY'
      when regexp_matches(d, '^[A-Za-z][A-Za-z ]{{0,30}}(\(\s*\d{{1,4}}(\s*,\s*\d{{1,4}})?\s*\))?$') then upper(d)
      else {_affinity_sql("d")} end as type from p""",
)
def declared_types(spark, sf_dir):
    return _declared(spark, sf_dir).select("p_partkey", declared_type(F.col("declared")).alias("type"))


@query(
    "c9c_compatible_types",
    rf"""
    with p as (select p_partkey, {_affinity_sql("a")} as a, {_affinity_sql("b")} as b
               from (select p_partkey, {DECLARED_SQL} as a, {OTHER_SQL} as b from part))
    select p_partkey, a as left_affinity, b as right_affinity,
      a = b or (a in ('INTEGER', 'REAL', 'NUMERIC') and b in ('INTEGER', 'REAL', 'NUMERIC')) as compatible from p""",
)
def compatible_types(spark, sf_dir):
    return _declared(spark, sf_dir).select(
        "p_partkey",
        affinity(F.col("declared")).alias("left_affinity"),
        affinity(F.col("other")).alias("right_affinity"),
        keys.compatible(F.col("declared"), F.col("other")).alias("compatible"),
    )


@query("c2_infer_types", f'with {sx.types_sql()} select database, tab as "table", col as "column", type from types_')
def infer_types(spark, sf_dir):
    return catalogue.infer_types(tables(spark, sf_dir))


@query(
    "c4_storable_values",
    """
    select event_id, cast(event_type = 'error' as int) as flag,
      case when event_type = 'view' or event_type = 'click' then null else value end as value,
      cast(value as double) as amount,
      strftime(ts, '%Y-%m-%d %H:%M:%S') as ts, strftime(ts, '%Y-%m-%d') as day from events""",
)
def storable_values(spark, sf_dir):
    kind, value = F.col("event_type"), F.col("value")
    cells = load(spark, sf_dir, "events").select(
        "event_id",
        (kind == "error").alias("flag"),
        F.when(kind == "view", float("nan")).when(kind == "click", float("inf")).otherwise(value).alias("value"),
        value.cast("decimal(20,6)").alias("amount"),
        "ts",
        F.to_date("ts").alias("day"),
    )
    return cells.select(*[storable(F.col(f.name), f.dataType).alias(f.name) for f in cells.schema.fields])


@query(
    "c4b_storable_bytes",
    """select doc_id, case when octet_length(encode(text)) <= 65536 then md5(text) end as kept from documents""",
)
def storable_bytes(spark, sf_dir):
    body = load(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("body"))
    return body.select("doc_id", F.md5(storable(F.col("body"), body.schema["body"].dataType)).alias("kept"))


def _spoilt(spark, sf_dir):
    """Orders and customers as text, with words for missing values in some cells."""
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    return load(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(status == "F", " N/A ").when(status == "P", "None").otherwise(status).alias("status"),
        F.when(priority == "5-LOW", "null").when(priority == "1-URGENT", "").otherwise(priority).alias("priority"),
        F.when(F.col("o_totalprice") > 400000, "NaN").otherwise(F.col("o_orderkey").cast("string")).alias("code"),
    )


SPOILT_SQL = """
    spoilt as (select o_orderkey,
      case o_orderstatus when 'F' then ' N/A ' when 'P' then 'None' else o_orderstatus end as status,
      case o_orderpriority when '5-LOW' then 'null' when '1-URGENT' then '' else o_orderpriority end as priority,
      case when o_totalprice > 400000 then 'NaN' else cast(o_orderkey as varchar) end as code from orders)"""


def _null_sql(c: str) -> str:
    return f"case when lower(trim({c})) not in ('', 'null', 'none', 'nan', 'na', 'n/a') then {c} end as {c}"


@query(
    "c5_null_words",
    f"with {SPOILT_SQL} select o_orderkey, {_null_sql('status')}, {_null_sql('priority')}, {_null_sql('code')} from spoilt",
)
def null_words(spark, sf_dir):
    rows = _spoilt(spark, sf_dir)
    return rows.select(
        "o_orderkey", *[null_words_to_null(F.col(c)).alias(c) for c in ("status", "priority", "code")]
    )


@query(
    "c6_exact_null_words",
    f"""with {SPOILT_SQL} select o_orderkey,
      case when status not in ('NULL', 'null', 'None', 'none') then status end as status,
      case when priority not in ('NULL', 'null', 'None', 'none') then priority end as priority from spoilt""",
)
def exact_null_words(spark, sf_dir):
    rows = _spoilt(spark, sf_dir)
    return rows.select(
        "o_orderkey", *[exact_null_words_to_null(F.col(c)).alias(c) for c in ("status", "priority")]
    )


@query(
    "c7_required_text",
    f"""with {SPOILT_SQL}, clean as (select o_orderkey, {_null_sql('status')}, {_null_sql('priority')} from spoilt)
      select o_orderkey, status, coalesce(priority, '') as priority from clean""",
)
def required_text(spark, sf_dir):
    return null_words(spark, sf_dir).select("o_orderkey", "status", "priority").fillna("", subset=["priority"])


ROW_CAP = 5_000


@query(
    "c8_row_caps",
    "with counts as ("
    + " union all ".join(
        f"select '{d}' as database, '{t}' as tab, '{s}' as original, count(*) as n from {s}" for d, t, s, _ in sx.TABLES
    )
    + f""") select database, tab as "table", least(n, {ROW_CAP}) as "rows", case when n > {ROW_CAP}
      then 'Table ''' || original || ''' was truncated to the first {ROW_CAP:,} rows.' end as warning from counts""",
)
def row_caps(spark, sf_dir):
    kept = []
    for t in tables(spark, sf_dir):
        frame, warning = readers.capped(t.frame, t.original, ROW_CAP)
        rows = frame.agg(F.count(F.lit(1)).alias("rows"))
        kept.append(
            rows.select(
                F.lit(t.database).alias("database"),
                F.lit(t.name).alias("table"),
                "rows",
                F.lit(warning).cast("string").alias("warning"),
            )
        )
    return catalogue.union_all(kept)


@query(
    "c9a_uniqueness",
    f"""with {sx.profile_sql()} select database, tab as "table", col as "column", n_rows as "rows", non_null,
      n_distinct as "distinct", n_rows = non_null and n_rows = n_distinct as is_unique from profile_""",
)
def uniqueness(spark, sf_dir):
    found = tables(spark, sf_dir)
    return keys.uniqueness(found, keys.key_columns_to_test(found))


@query(
    "c9b_inclusion",
    f"""with {sx.ratios_sql()} select database, tab as "table", col as "column", ref_tab as ref_table,
      ref_col as ref_column, round(ratio, 6) as ratio from ratios_ where uniq""",
)
def inclusion(spark, sf_dir):
    found = tables(spark, sf_dir)
    candidates = keys.link_candidates(found)
    unique = keys.unique_parents(found, candidates)
    candidates = [c for c in candidates if (c.parent.database, c.parent.name, c.ref_column) in unique]
    names = small_frame(
        spark,
        [(c.order, c.child.database, c.child.name, c.column, c.parent.name, c.ref_column) for c in candidates],
        keys.LINK_SCHEMA,
    )
    return (
        keys.inclusion(candidates).join(F.broadcast(names), "pair").drop("pair").withColumn("ratio", F.round("ratio", 6))
    )


LINKS_CTE = f"with {sx.ratios_sql()},{sx.LINKS_SQL}"


@query(
    "c9_infer_links",
    f"""{LINKS_CTE} select database, tab as "table", col as "column", ref_tab as ref_table, ref_col as ref_column,
      round(ratio, 6) as ratio from links_""",
)
def infer_links(spark, sf_dir):
    links = keys.infer_links(tables(spark, sf_dir))
    return links.drop("inferred").withColumn("ratio", F.round("ratio", 6))


@query(
    "c10_primary_keys",
    f"""with {sx.profile_sql()},{sx.KEYS_SQL} select database, tab as "table", col as "column" from keys_""",
)
def primary_keys(spark, sf_dir):
    found = tables(spark, sf_dir)
    return keys.primary_keys(found, catalogue.columns_frame(spark, found))


@query(
    "c11_sample_values",
    f"""with {sx.samples_sql()},{sx.SHOWN_SQL} select database, tab as "table", col as "column",
      cast(pos as int) as position, v as value from shown_""",
)
def sample_values(spark, sf_dir):
    return documents.shown_samples(documents.sample_values(tables(spark, sf_dir)))


FIRST_SQL = " union all ".join(
    f"""(select 'customers' as "table", '{n}' as "column", cast(row_number() over (order by c_custkey) as int) as position,
      cast({o} as varchar) as value from customer where {o} is not null order by c_custkey limit 5)"""
    for o, n in sx.TABLES[0][3].items()
)


@query("c11b_first_values", FIRST_SQL)
def first_values(spark, sf_dir):
    customers = tables(spark, sf_dir)[0]
    return documents.first_values(customers, ["id"]).drop("database")


@query(
    "c12_flatten_text",
    f"""select doc_id, {sx.flat_sql("text")} as short_text, {sx.flat_sql("text", 80)} as longer_text from documents""",
)
def flatten(spark, sf_dir):
    text = F.col("text")
    return load(spark, sf_dir, "documents").select(
        "doc_id", flatten_text(text).alias("short_text"), flatten_text(text, 80).alias("longer_text")
    )


@query("c13_table_documents", sx.with_index() + ' select id, database, tab as "table", text from docs_')
def table_documents(spark, sf_dir):
    return schema_index(spark, sf_dir).documents.drop("kind")


REFLECTED_SQL = """
reflected_ as (
  select database, tab, string_agg(t, chr(10) order by s, o) as text from (
    select database, tab, s, o, t from lines_ where s in (2, 4, 5, 7, 8)
    union all select database, tab, 9, column_no, '- ' || col || ' -> ' || ref_tab || '(' || ref_col || ')'
      from links_ join columns_ using (database, tab, col))
  group by database, tab)"""


@query(
    "c13b_reflected_documents",
    sx.with_index(REFLECTED_SQL) + ' select database, tab as "table", text from reflected_',
)
def reflected_documents(spark, sf_dir):
    index = schema_index(spark, sf_dir)
    return documents.table_documents(
        index.columns,
        index.types,
        index.keys,
        index.links,
        key_style="call",
        with_database=False,
        with_originals=False,
    ).select("database", "table", "text")


@query("c14_database_documents", sx.with_index() + " select d_id as database, table_count, text from dbdocs_")
def database_documents(spark, sf_dir):
    return schema_index(spark, sf_dir).database_documents().select("database", "table_count", "text")


@query(
    "c15_database_schema",
    sx.with_index(REFLECTED_SQL)
    + " select database, string_agg(text, chr(10) || chr(10) order by tab) as text from reflected_ group by database",
)
def database_schema(spark, sf_dir):
    index = schema_index(spark, sf_dir)
    parts = documents.table_documents(
        index.columns,
        index.types,
        index.keys,
        index.links,
        key_style="call",
        with_database=False,
        with_originals=False,
    )
    return documents.database_documents(parts, headed=False).select("database", "text")


@query(
    "c16_composite_links",
    """select 'shop' as database, 'fk_' || l_orderkey as "constraint", 'parts' as ref_table,
      string_agg('c' || l_linenumber || '_' || l_suppkey, ',' order by l_linenumber, 'c' || l_linenumber || '_' || l_suppkey,
        'p' || l_partkey) as "columns",
      string_agg('p' || l_partkey, ',' order by l_linenumber, 'c' || l_linenumber || '_' || l_suppkey,
        'p' || l_partkey) as ref_columns
      from lineitem group by l_orderkey""",
)
def composite_links(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").select(
        F.lit("shop").alias("database"),
        F.lit("lineitems").alias("table"),
        F.concat(F.lit("fk_"), "l_orderkey").alias("constraint"),
        F.lit("parts").alias("ref_table"),
        F.col("l_linenumber").alias("position"),
        F.concat(F.lit("c"), "l_linenumber", F.lit("_"), "l_suppkey").alias("column"),
        F.concat(F.lit("p"), "l_partkey").alias("ref_column"),
    )
    return (
        keys.composite_links(rows)
        .withColumns({c: F.array_join(c, ",") for c in ("columns", "ref_columns")})
        .drop("table")
    )


@query(
    "c17_table_explorer",
    sx.with_index()
    + """ select c.database, c.tab as "table", c.col as "column", cast(column_no as int) as column_no,
      count(*) over (partition by c.database, c.tab) as column_count, type,
      k.col is not null as primary_key, l.col is not null as foreign_key, ref_tab as references_table,
      ref_col as references_column
      from columns_ c join types_ using (database, tab, col)
      left join keys_ k using (database, tab, col) left join links_ l using (database, tab, col)""",
)
def table_explorer(spark, sf_dir):
    index = schema_index(spark, sf_dir)
    nullable = small_frame(
        spark,
        [(t.database, t.name, f.name, f.nullable) for t in index.tables for f in t.frame.schema.fields],
        "database string, table string, column string, nullable boolean",
    )
    return documents.table_explorer(index.columns, index.types, index.keys, index.links, nullable).drop("nullable")


@query(
    "c18_table_list",
    """select source as database, count(distinct lang) as tables, string_agg(distinct lang, ',' order by lang) as names
       from documents group by source""",
)
def table_list(spark, sf_dir):
    return (
        load(spark, sf_dir, "documents")
        .groupBy(F.col("source").alias("database"))
        .agg(F.count_distinct("lang").alias("tables"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("names"))
    )


@query(
    "c18b_database_list",
    """with allowed as (select distinct source as database from documents join labels using (doc_id) where quality = 1),
       seen as (select distinct source as database from documents where lang = 'de')
       select database from allowed where database in (select database from seen)
         or not exists (select 1 from allowed where database in (select database from seen))""",
)
def database_list(spark, sf_dir):
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    good = labels.filter("quality = 1").select("doc_id")
    allowed = docs.join(good, "doc_id", "left_semi").select(F.col("source").alias("database")).distinct()
    seen = docs.filter("lang = 'de'").select(F.col("source").alias("database"))
    return registry.visible_databases(allowed, seen)


LISTED = [" `{S}_{n}` ", "{s}", "mysql", "u_0123456789ab", "{S}-{n}", "", "`{s}_{n}`", "SYS"]


@query(
    "c19_allow_list",
    rf"""with names as (select case when lang = 'xx' then 1 when lang = 'en' then 2 else 3 end as priority,
        {filled_sql(LISTED, f"doc_id % {len(LISTED)}", S="upper(source)", s="source", n="doc_id")} as database from documents),
      clean as (select distinct priority, lower(regexp_replace(trim(database), '^`+|`+$', '', 'g')) as database from names),
      kept as (select * from clean where regexp_matches(database, '^[a-z0-9_]{{1,64}}$')
        and database not in ('mysql', 'information_schema', 'performance_schema', 'sys')
        and not regexp_matches(database, '^u_[0-9a-f]{{12}}$'))
      select database from kept where priority = (select min(priority) from kept)""",
)
def allow_list(spark, sf_dir):
    source, number = F.col("source"), F.col("doc_id")
    listed = load(spark, sf_dir, "documents").select(
        F.when(F.col("lang") == "xx", 1).when(F.col("lang") == "en", 2).otherwise(3).alias("priority"),
        filled(LISTED, F.pmod(number, F.lit(len(LISTED))), S=F.upper(source), s=source, n=number).alias("database"),
    )
    return registry.allow_list(listed)


@query(
    "c20_ingest_summary",
    sx.with_index(
        "counts_ as (" + " union all ".join(
            f"select '{d}' as database, '{t}' as tab, count(*) as n from {s}" for d, t, s, _ in sx.TABLES
        ) + ")",
        """rel_ as (select database, tab, string_agg(col || ' -> ' || ref_tab || '.' || ref_col, '|'
             order by col || ' -> ' || ref_tab || '.' || ref_col) as r from links_ group by 1, 2)""",
    )
    + f""" select database, tab as "table", any_value(original_table) as original_table, count(*) as "columns",
      any_value(n) as "rows", coalesce(any_value(r), '') as relationships,
      case when any_value(n) > 500000 then 'Table ''' || any_value(original_table) ||
        ''' has more than 500,000 rows.' end as warning
      from columns_ join counts_ using (database, tab) left join rel_ using (database, tab) group by database, tab""",
)
def ingest_summary(spark, sf_dir):
    index = schema_index(spark, sf_dir)
    report = documents.ingest_summary(
        index.columns, documents.row_counts(index.tables), index.links, readers.MAX_ROWS_PER_TABLE
    )
    return report.withColumn("relationships", F.array_join("relationships", "|"))


VALUES_CTE = """
values_ as (
  select id, lower(trim(unnest(string_split(regexp_replace(line, '^[^:]*:', ''), ',')))) as value
  from (select id, unnest(string_split(text[strpos(text, 'SAMPLE VALUES:'):], chr(10))) as line
        from docs_ where strpos(text, 'SAMPLE VALUES:') > 0)
  where line like '-%' and line like '%:%')"""


@query(
    "c21_value_frequency",
    sx.with_index(VALUES_CTE)
    + " select value, count(*) as n from values_ where value <> '' group by value order by n desc, value limit 30",
)
def value_frequency(spark, sf_dir):
    return documents.value_frequency(schema_index(spark, sf_dir).documents)


# Words whose frequency is reported.
NAMED_VALUES = ["document", "player", "student", "teacher", "school", "singer", "mountain climbing", "0", "1-urgent", "en"]


@query(
    "c21b_named_values",
    sx.with_index(VALUES_CTE)
    + f""" select name as value, (select count(*) from values_ v where v.value = name) as n
      from (select unnest([{', '.join(repr(v) for v in NAMED_VALUES)}]) as name)""",
)
def named_values(spark, sf_dir):
    return documents.named_value_counts(schema_index(spark, sf_dir).documents, NAMED_VALUES)


@query(
    "c21c_corpus_value_frequency",
    r"""with w as (select lower(trim(unnest(string_split(replace(text, chr(10), ' '), ',')))) as value from documents)
      select value, count(*) as n from w where value <> '' group by value order by n desc, value limit 30""",
)
def corpus_value_frequency(spark, sf_dir):
    """The same count over comma-separated pieces of every document."""
    lines = load(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("SAMPLE VALUES:\n- text: "), F.regexp_replace(F.col("text"), "\n", " ")).alias("text"),
    )
    return documents.value_frequency(lines)


@query(
    "c22_dataset_report",
    """select 'train' as dataset, count(*) as "rows", count(distinct source) as databases, 5 as "columns" from documents
       union all select 'test', count(*), count(distinct role), 4 from conversations""",
)
def dataset_report(spark, sf_dir):
    return documents.dataset_report(load(spark, sf_dir, "documents"), "train", "source").unionByName(
        documents.dataset_report(load(spark, sf_dir, "conversations"), "test", "role")
    )


FILE_NAMES = ["t{n}.csv", "T{n}.TSV", "book{n}.xlsx", "data{n}.sqlite", "dump{n}.sql", "x{n}.parquet", "t{n}.csv", "u{n}.csv"]
FILE_SQL = filled_sql(FILE_NAMES, f"(l_linenumber + l_orderkey) % {len(FILE_NAMES)}", n="l_partkey")


@query(
    "c23_upload_verdicts",
    rf"""
    with files as (select l_orderkey as upload, {FILE_SQL} as file,
        cast(case when l_quantity < 2 then 0 else l_extendedprice * 500 end as bigint) as bytes from lineitem),
    kinds as (select *, lower(regexp_extract(file, '\.([^.]+)$', 1)) as ext from files),
    judged as (select *, case when bytes = 0 then '''' || file || ''' is empty.'
        when ext = 'sql' then 'SQL dumps are not supported yet. Upload a .sqlite/.db file or CSV/Excel files instead.'
        when ext = 'xls' then 'Legacy .xls files are not supported. Save as .xlsx or .csv.'
        when ext = 'zip' then 'Archives are not supported. Upload the files directly.'
        when ext not in ('sqlite', 'sqlite3', 'db', 'csv', 'tsv', 'xlsx') then 'Unsupported file type ''.' || ext || '''.'
        end as problem from kinds),
    up as (select upload, count(*) as n, sum(bytes) as total, arg_min(problem, file) filter (problem is not null) as problem,
        count(*) filter (ext in ('sqlite', 'sqlite3', 'db')) as single,
        count(*) filter (ext in ('csv', 'tsv', 'xlsx')) as tabular from judged group by upload)
    select upload, case when n > 20 then 'Too many files (maximum 20).' when problem is not null then problem
        when total > 52428800 then 'Upload is too large (maximum 50 MB).'
        when single > 0 and tabular > 0 then 'Upload either one SQLite file or CSV/Excel files, not both.'
        when single > 1 then 'Upload exactly one SQLite file.' when single = 1 then 'single' else 'tabular' end as verdict
    from up""",
)
def upload_verdicts(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem")
    choice = F.pmod(F.col("l_linenumber") + F.col("l_orderkey"), F.lit(len(FILE_NAMES)))
    size = F.when(F.col("l_quantity") < 2, 0.0).otherwise(F.col("l_extendedprice") * 500)
    files = rows.select(
        F.col("l_orderkey").alias("upload"),
        filled(FILE_NAMES, choice, n=F.col("l_partkey")).alias("file"),
        F.round(size).cast("bigint").alias("bytes"),
    )
    return readers.upload_verdicts(files)

