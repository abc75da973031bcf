"""Readers and sinks, exercised on the given tables.

Sinks write whole tables to a fresh folder below the checkpoint folder and the query
reads them back, so that what is compared is what was written.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from schemaloom.operators import evaluation
from schemaloom.operators.catalogue import union_all
from schemaloom.operators.documents import row_counts
from schemaloom.plans.inputs import TABLES, Table, filled, filled_sql, load
from schemaloom.plans.registered import query
from schemaloom.runtime import scratch_path
from schemaloom.sources import readers, snapshots, store


@query(
    "s1_delimited_text",
    "select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority from orders",
)
def delimited_text(spark, sf_dir):
    """Orders written as `;`-separated text and read back with delimiter and type detection."""
    path = scratch_path(spark, "text")
    load(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"
    ).write.csv(path, header=True, sep=";")
    return readers.read_delimited(spark, path)


@query(
    "s2_delimiters",
    "select unnest([',', ';', 'TAB', '|']) as written, unnest([',', ';', 'TAB', '|']) as found",
)
def delimiters(spark, sf_dir):
    """Delimiter found in every file of customers written with each of the four."""
    parts = []
    for sep in readers.DELIMITERS:
        path = scratch_path(spark, "sep")
        load(spark, sf_dir, "customer").write.csv(path, header=True, sep=sep)
        found = readers.file_facts(spark, path).select(F.lit(sep).alias("written"), F.col("delimiter").alias("found"))
        parts.append(found.distinct())
    return union_all(parts).select(*[F.replace(c, F.lit("\t"), F.lit("TAB")).alias(c) for c in ("written", "found")])


@query(
    "s1b_mixed_folder",
    """select o_orderkey, case when o_orderkey % 3 = 1 then 'Café ' || o_custkey else 'n ' || o_custkey end as who,
         o_totalprice, case when o_orderkey % 3 < 2 then o_orderpriority end as o_orderpriority from orders""",
)
def mixed_folder(spark, sf_dir):
    """Orders in one folder: `,` in UTF-8, `;` in Latin-1, and tabs with columns in another order and one missing."""
    path, key = scratch_path(spark, "mixed"), F.col("o_orderkey")
    who = F.concat(F.when(key % 3 == 1, "Café ").otherwise("n "), "o_custkey").alias("who")
    orders = load(spark, sf_dir, "orders").select(key, who, "o_totalprice", "o_orderpriority")
    orders.where(key % 3 == 0).write.csv(path, header=True)
    orders.where(key % 3 == 1).write.csv(path, header=True, sep=";", encoding="ISO-8859-1", mode="append")
    last = orders.where(key % 3 == 2).select("o_totalprice", "who", "o_orderkey")
    last.write.csv(path, header=True, sep="\t", mode="append")
    return readers.read_delimited(spark, path)


@query(
    "s3_declared_columns",
    "select cast(c_custkey as varchar) as c_custkey, c_mktsegment, cast(c_nationkey as varchar) as c_nationkey from customer",
)
def declared_columns(spark, sf_dir):
    path = scratch_path(spark, "declared")
    load(spark, sf_dir, "customer").write.csv(path, header=True)
    return readers.read_declared(spark, path, ["c_custkey", "c_mktsegment", "c_nationkey"])


@query("s4_required_header", "select cast(s_suppkey as varchar) as s_suppkey, s_name from supplier")
def required_header(spark, sf_dir):
    path = scratch_path(spark, "header")
    load(spark, sf_dir, "supplier").select("s_suppkey", "s_name").write.csv(path, header=True)
    return readers.require_header(spark.read.csv(path, header=True), ["s_suppkey", "s_name"])


@query("s5_bounded_sample")
def bounded_sample(spark, sf_dir):
    return readers.bounded_sample(load(spark, sf_dir, "lineitem"))


# File names per document; the table is always called Table_<doc_id>.
FILES = ["Table_{n}.csv", "TABLE_{n}.CSV", "table-{n}.csv", "other_{n}.csv", "Table_{n}.txt"]


@query(
    "s6_match_files",
    rf"""with t as (select source as database, 'Table_' || doc_id as tab from documents),
      f as (select source as database, {filled_sql(FILES, f"doc_id % {len(FILES)}", n="doc_id")} as file from documents
        union all select source, 'Table_' || doc_id || '.csv' from documents where lang = 'fr'),
      c as (select *, regexp_replace(file, '(?i)\.csv$', '') as stem from f where lower(file) like '%.csv'),
      m as (select t.database, tab, file, case when file = tab || '.csv' then 1 when lower(stem) = lower(tab) then 2 else 3 end as rule
        from t join c on t.database = c.database
          and regexp_replace(lower(tab), '[^a-z0-9]', '', 'g') = regexp_replace(lower(stem), '[^a-z0-9]', '', 'g')),
      r as (select *, row_number() over (partition by database, tab order by rule, file) as rn from m)
      select database, tab as "table", file, cast(rule as int) as rule from r where rn = 1""",
)
def match_files(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    number = F.col("doc_id")
    tables = docs.select(F.col("source").alias("database"), F.concat(F.lit("Table_"), number).alias("table"))
    files = docs.select(
        F.col("source").alias("database"), filled(FILES, F.pmod(number, F.lit(len(FILES))), n=number).alias("file")
    ).unionByName(
        docs.filter("lang = 'fr'").select(
            F.col("source").alias("database"), F.concat(F.lit("Table_"), number, F.lit(".csv")).alias("file")
        )
    )
    return readers.match_files(files, tables)


# Schema text of one database per part; brands with a 3 have none.
DDL = """-- {name}
CREATE TABLE `db{n}`.`{kind}_head` (
  `id` int NOT NULL,
  `Size {size}` decimal(10, 2) DEFAULT {size},
  PRIMARY KEY (`id`, `no`)
);

create table `db{n}`.`lines` (
  `no` bigint,
  `head_id` int,
  PRIMARY KEY (`no`),
  FOREIGN KEY (`head_id`) REFERENCES `db{n}`.`{kind}_head` (`id`)
);
CREATE TABLE `other`.`x` (
  `a` int
);
"""


def _ddl(spark, sf_dir):
    number = F.col("p_partkey")
    text = filled(
        [DDL, "-- empty {name}"],
        F.col("p_brand").contains("3").cast("int"),
        n=number,
        name=F.col("p_name"),
        kind=F.lower("p_type"),
        size=F.col("p_size"),
    )
    return load(spark, sf_dir, "part").select(F.concat(F.lit("db"), number).alias("database"), text.alias("sql"))


DDL_SQL = """
parts_ as (select 'db' || p_partkey as database, lower(p_type) || '_head' as head, p_size, contains(p_brand, '3') as empty from part),
ddl as (
  select database, head as tab, 'column' as kind, 0 as ordinal, 0 as part, 'id' as name, 'int NOT NULL' as definition, null as ref_table, null as ref_column from parts_ where not empty
  union all select database, head, 'column', 1, 0, 'Size ' || p_size, 'decimal(10, 2) DEFAULT ' || p_size, null, null from parts_ where not empty
  union all select database, head, 'key', 2, 0, 'id', null, null, null from parts_ where not empty
  union all select database, head, 'key', 2, 1, 'no', null, null, null from parts_ where not empty
  union all select database, 'lines', 'column', 0, 0, 'no', 'bigint', null, null from parts_ where not empty
  union all select database, 'lines', 'column', 1, 0, 'head_id', 'int', null, null from parts_ where not empty
  union all select database, 'lines', 'key', 2, 0, 'no', null, null, null from parts_ where not empty
  union all select database, 'lines', 'link', 3, 0, 'head_id', null, head, 'id' from parts_ where not empty)"""


@query(
    "s7_parse_ddl",
    f"""with {DDL_SQL} select database, tab as "table", kind, cast(ordinal as int) as ordinal,
      cast(part as int) as part, name,
      definition, ref_table, ref_column from ddl""",
)
def parse_ddl(spark, sf_dir):
    return readers.parse_ddl(_ddl(spark, sf_dir))


@query(
    "s8_extraction_report",
    f"""with {DDL_SQL} select p.database, count(distinct tab) as tables from parts_ p left join ddl using (database) group by 1""",
)
def extraction_report(spark, sf_dir):
    statements = _ddl(spark, sf_dir)
    return readers.extraction_report(statements.select("database"), readers.parse_ddl(statements))


@query(
    "s9_gold_questions",
    """select event_id as "index", event_type as database, trim(props) as question,
        case when user_id > 75 then 'SELECT ' || user_id || ';' else 'SELECT ' || user_id || ';' end as gold_sql
       from events where event_type <> 'error' and value >= 5""",
)
def gold_questions(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select(
        "event_id",
        F.when(F.col("event_type") != "error", F.col("event_type")).otherwise("  ").alias(" DB_ID "),
        F.concat(F.lit("  "), "props", F.lit(" ")).alias("NL_Question"),
        F.when(F.col("value") < 5, None)
        .when(F.col("user_id") > 75, F.concat(F.lit("```sql\nSELECT "), F.col("user_id"), F.lit("\n```")))
        .otherwise(F.concat(F.lit(" SELECT "), F.col("user_id"), F.lit(";")))
        .alias("Query"),
    )
    return evaluation.gold_questions(rows, "event_id")


@query(
    "s11_append_sink",
    """select l_returnflag, count(*) as n, round(sum(l_quantity), 2) as quantity from
       (select * from lineitem union all select * from lineitem where l_returnflag = 'R') group by 1""",
)
def append_sink(spark, sf_dir):
    path, rows = scratch_path(spark, "append"), load(spark, sf_dir, "lineitem")
    store.append(rows, path)
    store.append(rows.filter("l_returnflag = 'R'"), path)
    written = spark.read.parquet(path)
    return written.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity")
    )


@query("s12_load_if_empty", "select o_orderstatus, count(*) as n from orders group by 1")
def load_if_empty(spark, sf_dir):
    """The second load finds rows and leaves the target as it is."""
    path, rows = scratch_path(spark, "empty"), load(spark, sf_dir, "orders")
    store.load_if_empty(rows, path)
    store.load_if_empty(rows, path)
    return spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("s13_replace", "select c_mktsegment, count(*) as n from customer where c_acctbal > 0 group by 1")
def replace(spark, sf_dir):
    path, rows = scratch_path(spark, "replace"), load(spark, sf_dir, "customer")
    store.replace(rows, path)
    store.replace(rows.filter("c_acctbal > 0"), path)
    return spark.read.parquet(path).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


def _loaded(spark, sf_dir):
    """(table, rows) before and after a load that skips over-long texts and negative balances."""
    skipped = {"documents": "n_chars <= 20000", "customer": "c_acctbal >= 0"}
    before = [Table("db", s, load(spark, sf_dir, s)) for _, _, s, _ in TABLES]
    after = [
        Table("db", t.name, t.frame.filter(skipped[t.name]) if t.name in skipped else t.frame) for t in before
    ]
    return row_counts(before), row_counts(after)


@query(
    "s14_reconcile",
    "with c as ("
    + " union all ".join(
        f"""select '{s}' as tab, count(*) as a, count(*) filter ({
            {'documents': 'n_chars <= 20000', 'customer': 'c_acctbal >= 0'}.get(s, 'true')}) as b from {s}"""
        for _, _, s, _ in TABLES
    )
    + ') select tab as "table", a as source_rows, b as target_rows, a = b as matches from c',
)
def reconcile(spark, sf_dir):
    return store.reconcile(*_loaded(spark, sf_dir))


def _loads(spark, sf_dir):
    """One load per supplier (database) and part (table): rows and whether all went well."""
    return (
        load(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").alias("database"), F.col("l_partkey").alias("table"))
        .agg(F.bool_and(F.col("l_quantity") < 50).alias("ok"), F.count(F.lit(1)).alias("rows"))
    )


LOADS_SQL = """
loads as (select l_suppkey as database, l_partkey as tab, bool_and(l_quantity < 50) as ok, count(*) as n from lineitem group by 1, 2),
report as (select database, bool_and(ok) as ok, count(*) as tables, cast(sum(n) as bigint) as "rows" from loads group by 1)"""


@query("s15_load_report", f"with {LOADS_SQL} select * from report")
def load_report(spark, sf_dir):
    return store.load_report(_loads(spark, sf_dir))


@query(
    "s15b_load_totals",
    f"""with {LOADS_SQL} select count(*) filter (ok) as succeeded, count(*) filter (not ok) as failed,
      cast(sum(tables) as bigint) as tables, cast(sum("rows") as bigint) as "rows" from report""",
)
def load_totals(spark, sf_dir):
    return store.load_totals(load_report(spark, sf_dir))


def _documents(spark, sf_dir):
    return load(spark, sf_dir, "documents").select(
        F.col("source").alias("database"), F.col("doc_id").alias("id"), "text"
    )


@query(
    "s16_replace_database",
    """select database, count(*) as n, cast(sum(length(text)) as bigint) as chars from (
        select source as database, text from documents where source not in ('src1', 'src2')
        union all select source, 'new ' || text from documents where source in ('src1', 'src2') and lang = 'en') group by 1""",
)
def replace_database(spark, sf_dir):
    """The documents of two databases are replaced; the folders of the others stay."""
    path, documents = scratch_path(spark, "index"), _documents(spark, sf_dir)
    store.write_documents(documents, path)
    english = load(spark, sf_dir, "documents").filter("source in ('src1', 'src2') and lang = 'en'")
    fresh = english.select(
        F.col("source").alias("database"), F.col("doc_id").alias("id"), F.concat(F.lit("new "), "text").alias("text")
    )
    store.write_documents(fresh, path)
    return (
        store.read_documents(spark, path)
        .groupBy("database")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
    )


def _failing(rows, column):
    """The same rows, of which one per thousand cannot be computed."""
    broken = F.raise_error(F.lit("broken row")).cast("string")
    return rows.withColumn(column, F.when(F.col("id") % 1000 == 7, broken).otherwise(F.concat(F.lit("new "), column)))


def _must_fail(rows, path, key=None):
    try:
        snapshots.commit(rows, path, key)
    except Exception as error:
        if "broken row" not in str(error):
            raise
    else:
        raise AssertionError("The write was expected to fail.")


@query(
    "s13b_failed_replace",
    "select source as database, count(*) as n, cast(sum(length(text)) as bigint) as chars from documents group by 1",
)
def failed_replace(spark, sf_dir):
    """A write that fails half-way leaves the table as it was."""
    path, documents = scratch_path(spark, "snapshot"), _documents(spark, sf_dir)
    snapshots.commit(documents, path)
    _must_fail(_failing(documents, "text"), path)
    counts = [F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")]
    return snapshots.current(spark, path).groupBy("database").agg(*counts)


@query(
    "s16b_failed_database",
    """select database, count(*) as n, cast(sum(length(text)) as bigint) as chars from (
        select source as database, text from documents where source <> 'src1'
        union all select source, 'new ' || text from documents where source = 'src1' and lang = 'en') group by 1""",
)
def failed_database(spark, sf_dir):
    """One database is replaced; then a write of all databases fails and changes none."""
    path, documents = scratch_path(spark, "snapshot"), _documents(spark, sf_dir)
    snapshots.commit(documents, path, "database")
    english = load(spark, sf_dir, "documents").filter("source = 'src1' and lang = 'en'")
    fresh = english.select(
        F.col("source").alias("database"), F.col("doc_id").alias("id"), F.concat(F.lit("new "), "text").alias("text")
    )
    snapshots.commit(fresh, path, "database")
    _must_fail(_failing(documents, "text"), path, "database")
    counts = [F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")]
    return snapshots.current(spark, path).groupBy("database").agg(*counts)


@query(
    "s17_upsert",
    """select doc_id as id, source as database, md5(text) as text from documents where doc_id not in (select doc_id from labels)
       union all select doc_id, 'labelled', md5('q' || quality || ' t' || toxic) from labels""",
)
def upsert(spark, sf_dir):
    old = _documents(spark, sf_dir)
    new = load(spark, sf_dir, "labels").select(
        F.lit("labelled").alias("database"),
        F.col("doc_id").alias("id"),
        F.concat(F.lit("q"), "quality", F.lit(" t"), "toxic").alias("text"),
    )
    return store.upsert(old, new).select("id", "database", F.md5("text").alias("text"))


@query("s18_rebuild", "select lang as database, count(*) as n from documents group by 1")
def rebuild(spark, sf_dir):
    path = scratch_path(spark, "rebuild")
    store.replace(_documents(spark, sf_dir), path)
    by_language = load(spark, sf_dir, "documents").select(F.col("lang").alias("database"), F.col("doc_id").alias("id"), "text")
    store.replace(by_language, path)
    return spark.read.parquet(path).groupBy("database").agg(F.count(F.lit(1)).alias("n"))


@query(
    "s19_lookup",
    "select doc_id as id, source as database, md5(text) as text from documents where doc_id in (select doc_id from labels where quality = 1)",
)
def lookup(spark, sf_dir):
    ids = load(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("id"))
    return store.lookup(_documents(spark, sf_dir), ids).select("id", "database", F.md5("text").alias("text"))


@query("s19b_lookup_database", "select doc_id as id, md5(text) as text from documents where source = 'src5'")
def lookup_database(spark, sf_dir):
    """One database of a partitioned index: only its folder is read."""
    path = scratch_path(spark, "lookup")
    store.write_documents(_documents(spark, sf_dir), path)
    return store.read_documents(spark, path, "src5").select("id", F.md5("text").alias("text"))


@query(
    "s20_result_sink",
    """select o_orderkey as "index", o_orderstatus as database, 'say "' || o_orderpriority || '", please' as question,
      round(o_totalprice, 2) as latency_seconds, o_orderpriority = '5-LOW' as sql_exact_match from orders""",
)
def result_sink(spark, sf_dir):
    path = scratch_path(spark, "results")
    known = {
        "index": F.col("o_orderkey"),
        "database": F.col("o_orderstatus"),
        "question": F.concat(F.lit('say "'), "o_orderpriority", F.lit('", please')),
        "latency_seconds": F.round("o_totalprice", 2),
        "sql_exact_match": F.col("o_orderpriority") == "5-LOW",
    }
    results = load(spark, sf_dir, "orders").select(
        *[known.get(c, F.lit("")).alias(c) for c in evaluation.RESULT_COLUMNS]
    )
    store.write_results(results, path)
    back = readers.require_header(
        spark.read.csv(path, header=True, quote='"', escape='"'), evaluation.RESULT_COLUMNS
    )
    return back.select(
        F.col("index").cast("bigint").alias("index"),
        "database",
        "question",
        F.col("latency_seconds").cast("double").alias("latency_seconds"),
        (F.col("sql_exact_match") == "true").alias("sql_exact_match"),
    )
