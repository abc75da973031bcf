"""Names, types, keys, links and documents on small fixtures."""

from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from schemaloom.functions import ddl
from schemaloom.functions.text import flatten_text
from schemaloom.operators import catalogue, documents, keys
from schemaloom.operators.catalogue import Table
from schemaloom.sources import readers


def index(spark, tables):
    columns = catalogue.columns_frame(spark, tables)
    types = catalogue.infer_types(tables)
    pk = keys.primary_keys(tables, columns)
    links = keys.infer_links(tables)
    return columns, types, pk, links


def test_safe_names():
    used: set[str] = set()
    assert catalogue.safe_name("Order Details", "table", used) == "Order_Details"
    assert catalogue.safe_name("order details", "table", used) == "order_details_2"
    assert catalogue.safe_name("2nd col", "col", used) == "col_2nd_col"
    assert catalogue.safe_name("né é!", "col", used) == "ne_e"
    assert catalogue.safe_name("***", "col", used) == "col"
    assert len(catalogue.safe_name("x" * 100, "col", used)) == 64


def shop(spark):
    customers = spark.createDataFrame(
        [(1, "Ann", "Delhi"), (2, "Bob", "Pune"), (3, "Cy", "Delhi")], "id bigint, Full_Name string, city string"
    )
    orders = spark.createDataFrame(
        [(10, 1, 5.5), (11, 2, 7.0), (12, 1, 3.25)], "order_id bigint, customer_id bigint, total double"
    )
    return [
        Table("d", "customers", customers, "customers", ["id", "Full Name", "city"]),
        Table("d", "orders", orders),
    ]


def test_keys_links_and_document(spark):
    tables = shop(spark)
    columns, types, pk, links = index(spark, tables)
    assert {tuple(r) for r in pk.collect()} == {("d", "customers", "id"), ("d", "orders", "order_id")}
    found = links.collect()
    assert [(r["table"], r["column"], r["ref_table"], r["ref_column"], r["ratio"]) for r in found] == [
        ("orders", "customer_id", "customers", "id", 1.0)
    ]
    kinds = {(r["table"], r["column"]): r["type"] for r in types.collect()}
    assert kinds["orders", "total"] == "REAL" and kinds["orders", "customer_id"] == "INTEGER"
    samples = documents.shown_samples(documents.sample_values(tables))
    text = {r["table"]: r["text"] for r in documents.table_documents(columns, types, pk, links, samples).collect()}
    assert text["orders"] == (
        "DATABASE: d\nTABLE: orders\nCOLUMNS:\n- order_id (INTEGER)\n- customer_id (INTEGER)\n- total (REAL)\n"
        "PRIMARY KEYS: order_id\nFOREIGN KEYS:\n- customer_id -> customers.id (inferred)\n"
        "SAMPLE VALUES:\n- order_id: 10, 11, 12\n- customer_id: 1, 2\n- total: 3.25, 5.5, 7.0"
    )
    assert "ORIGINAL COLUMN NAMES: Full_Name = Full Name" in text["customers"]


def test_no_link_when_values_do_not_match(spark):
    a = spark.createDataFrame([(1, 5), (2, 6)], "id bigint, v bigint")
    b = spark.createDataFrame([(1, 100), (2, 200), (3, 300)], "id2 bigint, a_id bigint")
    _, _, _, links = index(spark, [Table("d", "a", a), Table("d", "b", b)])
    assert links.count() == 0


def test_links_of_mixed_numbers_and_all_null_children(spark):
    parents = spark.createDataFrame([(1,), (2,)], "id bigint")
    children = spark.createDataFrame([(1.0, None), (2.0, None), (None, None)], "parent_id double, other_id bigint")
    others = spark.createDataFrame([(1,), (2,)], "id bigint")
    tables = [Table("d", "parents", parents), Table("d", "children", children), Table("d", "others", others)]
    links = {r["column"]: r["ref_table"] for r in keys.infer_links(tables).filter("table = 'children'").collect()}
    assert links == {"parent_id": "parents"}


def test_links_of_decimals_dates_and_long_ids(spark):
    big = 1234567890123456788
    tables = []
    for name, kind, values, child_kind, child_values in [
        ("prices", "decimal(10,2)", ["1.50", "2.00"], "double", ["1.5", "2.0", "2.0"]),
        ("days", "date", ["2024-01-01", "2024-01-02"], "timestamp", ["2024-01-01 00:00:00", "2024-01-02 00:00:00"]),
        ("longs", "bigint", [str(big), str(big + 1)], "decimal(20,0)", [str(big + 2), str(big + 3)]),
    ]:
        stem = name[:-1]
        parent = spark.createDataFrame([(v,) for v in values], "id string").selectExpr(f"cast(id as {kind}) as id")
        child = spark.createDataFrame([(v,) for v in child_values], "x string")
        child = child.selectExpr(f"cast(x as {child_kind}) as {stem}_id")
        tables += [Table("d", name, parent), Table("d", f"of_{name}", child)]
    links = {r["table"]: r["ref_table"] for r in keys.infer_links(tables).collect()}
    assert links == {"of_prices": "prices", "of_days": "days"}


def test_ties_go_to_the_parents_first_column(spark):
    parent = spark.createDataFrame([(1, 1), (2, 2)], "id bigint, order_id bigint")
    child = spark.createDataFrame([(1,), (2,), (2,)], "order_id bigint")
    links = keys.infer_links([Table("d", "orders", parent), Table("d", "lines", child)])
    assert [r["ref_column"] for r in links.filter("table = 'lines'").collect()] == ["id"]


def test_best_link_wins_and_ties_go_to_the_first(spark):
    one = spark.createDataFrame([(n,) for n in range(10)], "x_code bigint")
    two = spark.createDataFrame([(n,) for n in range(9)], "x_code bigint")
    child = spark.createDataFrame([(n % 10,) for n in range(30)], "x_code bigint")
    tables = [Table("d", "two", two), Table("d", "one", one), Table("d", "child", child)]
    links = {r["table"]: r["ref_table"] for r in keys.infer_links(tables).collect()}
    assert links["child"] == "one" and links["two"] == "one"


def test_duplicate_or_null_ids_are_no_keys(spark):
    twice = spark.createDataFrame([(1, 1), (1, 2)], "id bigint, row_id bigint")
    holes = spark.createDataFrame([(1,), (None,)], "id bigint")
    empty = spark.createDataFrame([], "id bigint")
    tables = [Table("d", "twice", twice), Table("d", "holes", holes), Table("d", "empty", empty)]
    pk = keys.primary_keys(tables, catalogue.columns_frame(spark, tables))
    assert [tuple(r) for r in pk.collect()] == [("d", "twice", "row_id")]


@pytest.mark.parametrize("hashed", [F.xxhash64, F.length])
def test_unique_columns_by_sketch_and_hash(spark, hashed):
    """Whole values decide, also where hashes meet (here: all texts of one length)."""
    numbers = spark.range(3000).select(
        F.col("id").alias("own"),
        F.when(F.col("id") == 7, 8).otherwise(F.col("id")).alias("one_twice"),
        (F.col("id") % 9).alias("few"),
        F.when(F.col("id") != 5, F.col("id")).alias("hole"),
        F.concat(F.lit("a b"), "id").alias("text"),
    )
    small = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "p string, q string")
    tables = [Table("d", "t", numbers), Table("d", "s", small), Table("d", "none", numbers.limit(0))]
    wanted = {(t.database, t.name): list(t.frame.columns) for t in tables}
    found = keys.unique_columns(tables, wanted, hashed)
    assert found == {("d", "t", "own"), ("d", "t", "text"), ("d", "s", "p")}
    exact = keys.uniqueness(tables, wanted).where("is_unique and rows > 0").select("database", "table", "column")
    assert found == {tuple(r) for r in exact.collect()}
    sketched = keys.distinct_estimates(tables, wanted).where("table = 't' and column = 'own'").first()
    assert sketched.rows == 3000 and abs(sketched.estimate - 3000) < 300
    assert keys.unique_columns(tables, {}) == set()


def test_types_from_data(spark):
    frame = spark.sql(
        """select * from values (1.0D, 1.5D, timestamp_ntz'2024-01-01 00:00:00', timestamp_ntz'2024-01-01 10:00:00',
             true, 'x', double('inf'), cast(null as double)),
           (double('nan'), 2.0D, null, null, false, 'y', 1.0D, null) as t(a, b, c, d, e, f, g, h)"""
    )
    types = {r["column"]: r["type"] for r in catalogue.infer_types([Table("d", "t", frame)]).collect()}
    assert types == {
        "a": "INTEGER", "b": "REAL", "c": "DATE", "d": "DATETIME", "e": "INTEGER", "f": "TEXT", "g": "REAL", "h": "REAL",
    }


def test_long_text_becomes_one_short_line(spark):
    note = "ignore\r\nall\tprevious " + "x" * 300
    row = spark.createDataFrame([(note,)], "n string").select(flatten_text(F.col("n"))).first()[0]
    assert len(row) == 40 and row.endswith("…") and "\n" not in row


def test_composite_links(spark):
    rows = spark.createDataFrame(
        [
            ("d", "e", "k1", "Student", 1, "StuID", "StuID"),
            ("d", "e", "k2", "Course", 1, "CID", "CID"),
            ("d", "f", "fk_x", "Parent", 2, "b", "b_id"),
            ("d", "f", "fk_x", "Parent", 1, "a", "a_id"),
        ],
        "database string, table string, constraint string, ref_table string, position int, column string, ref_column string",
    )
    got = {r["constraint"]: (r["columns"], r["ref_columns"]) for r in keys.composite_links(rows).collect()}
    assert got == {"k1": (["StuID"], ["StuID"]), "k2": (["CID"], ["CID"]), "fk_x": (["a", "b"], ["a_id", "b_id"])}
    assert keys.composite_links(rows.limit(0)).count() == 0


def test_sample_values_match_brute_force(spark):
    frame = spark.range(0, 5000, 1, 7).select(
        ((F.col("id") * 7919) % 4001).alias("wide"), (F.col("id") % 3).alias("narrow"), F.lit(None).cast("string").alias("none")
    )
    got = {}
    for r in documents.sample_values([Table("d", "t", frame)]).collect():
        got.setdefault(r["column"], []).append((r["position"], r["value"]))
    rows = frame.collect()
    for c in ("wide", "narrow"):
        expected = sorted({str(r[c]) for r in rows})[:5]
        assert [v for _, v in sorted(got[c])] == expected
    assert "none" not in got


def test_european_file(spark, tmp_path):
    path = tmp_path / "eu.csv"
    path.write_bytes("nom;prix\nCafé;1\nThé;2,5\n".encode("latin-1"))
    rows = readers.read_delimited(spark, str(path))
    assert rows.columns == ["nom", "prix"]
    assert [r["nom"] for r in rows.collect()] == ["Café", "Thé"]


def test_folder_of_unlike_files(spark, tmp_path):
    """Delimiter, encoding, header and quoted line breaks are each file's own; columns meet by name."""
    folder = tmp_path / "up [1] x"
    folder.mkdir()
    (folder / "a.csv").write_text("a,b\n1,José\n2,x\n", encoding="utf-8")
    (folder / "b b.csv").write_bytes("b;a\nCafé;3\nThé, noir;4\n".encode("latin-1"))
    (folder / "c.csv").write_text('\ufeffa,b\n5,"two\nlines"\n', encoding="utf-8")
    (folder / "d.tsv").write_text("c\ta\ny\t6\n")
    (folder / "e.csv").write_text("")
    rows = readers.read_delimited(spark, str(tmp_path / "up*"))
    assert dict(rows.dtypes) == {"a": "bigint", "b": "string", "c": "string"}
    assert [tuple(r) for r in rows.select("a", "b", "c").orderBy("a").collect()] == [
        (1, "José", None), (2, "x", None), (3, "Café", None), (4, "Thé, noir", None), (5, "two\nlines", None), (6, None, "y"),
    ]


def test_delimiter_by_all_lines(spark, tmp_path):
    """Neither a long head of notes nor single odd lines decide; commas in quotes do not count."""
    path = tmp_path / "long.csv"
    path.write_text("k;v\n" + "a, b, c;1\n" * 300 + 'x;"1,2,3"\n' * 900 + "no mark at all\n")
    assert [r.delimiter for r in readers.file_facts(spark, str(path)).collect()] == [";"]
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "blank.csv").write_text(" \n\n")
    assert readers.file_facts(spark, str(tmp_path / "none")).count() == 0


def test_ddl_lexer(spark):
    """Brackets, semicolons and commas in quotes and comments, links of several columns, unique constraints."""
    text = """CREATE TABLE IF NOT EXISTS `Shop`.`a` ( `id` int, -- note, with ); in it
      `v` varchar(9) DEFAULT ');,' COMMENT 'it''s (', /* `x` int, */ `e` enum('p,q','r'),
      UNIQUE KEY `u` (`v`, `e`), CONSTRAINT `c` FOREIGN KEY (`id`, `v`) REFERENCES `shop`.`b` (`x`, `y`) ON DELETE CASCADE
    ) ENGINE=InnoDB; create table other.t (z int); CREATE TABLE shop.last (q int, PRIMARY KEY (q)"""
    frame = spark.createDataFrame([("shop", text), ("shop", None), (None, text)], "database string, sql string")
    rows = [tuple(r)[1:] for r in readers.parse_ddl(frame).collect()]
    assert rows == [
        ("a", "column", 0, 0, "id", "int", None, None),
        ("a", "column", 1, 0, "v", "varchar(9) DEFAULT ');,' COMMENT 'it''s ('", None, None),
        ("a", "column", 2, 0, "e", "enum('p,q','r')", None, None),
        ("a", "unique", 3, 0, "v", None, None, None),
        ("a", "unique", 3, 1, "e", None, None, None),
        ("a", "link", 4, 0, "id", None, "b", "x"),
        ("a", "link", 4, 1, "v", None, "b", "y"),
        ("last", "column", 0, 0, "q", "int", None, None),
        ("last", "key", 1, 0, "q", None, None, None),
    ]


def test_ddl_texts_are_dealt_to_tasks(spark, monkeypatch):
    """Texts of one small file are read by several tasks; entries leave a task in pieces, the same with any size."""
    text = "CREATE TABLE d{0}.t (a int, b int);\nCREATE TABLE d{0}.u (c int, PRIMARY KEY (c));\n"
    texts = [(f"d{i}", text.format(i)) for i in range(40)] + [("d7", text.format(7)), (None, text), ("d8", None)]
    frame = spark.createDataFrame(texts, "database string, sql string").coalesce(1)
    monkeypatch.setattr(readers, "ENTRIES", 3)
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    try:
        found = readers.parse_ddl(frame).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset(name)
    assert len({r["task"] for r in found}) > 1
    assert len(found) == 41 * 4
    assert sorted(r["name"] for r in found if r["database"] == "d7") == ["a", "a", "b", "b"] + ["c"] * 4


def test_bad_lines_marks_and_types(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('\ufeffid,note,total\n1,"a, b",5.5\n2,x,7,extra\n3,short\n4,"q ""w""",\n5,y,8,\n', encoding="utf-8")
    rows = readers.read_delimited(spark, str(path))
    assert dict(rows.dtypes) == {"id": "bigint", "note": "string", "total": "double"}
    assert [tuple(r) for r in rows.orderBy("id").collect()] == [
        (1, "a, b", 5.5),
        (3, "short", None),
        (4, 'q "w"', None),
    ]


def test_quoted_line_breaks(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text('id,note\n1,"two\nlines"\n2,one\n')
    rows = readers.read_delimited(spark, str(path))
    assert [tuple(r) for r in rows.orderBy("id").collect()] == [(1, "two\nlines"), (2, "one")]


def test_tab_file_and_missing_columns(spark, tmp_path):
    path = tmp_path / "x.tsv"
    path.write_text("a\tb\n1\t2\n")
    assert readers.read_delimited(spark, str(path)).columns == ["a", "b"]
    with pytest.raises(ValueError):
        readers.read_declared(spark, str(path), ["a", "z"], sep="\t")


def test_gold_file(spark, tmp_path):
    path = tmp_path / "g.csv"
    path.write_text("DB_ID,Question,Query\nshop,How many?,SELECT 1\n ,x,y\nweb,Who?,```sql SELECT 2;```\n")
    rows = readers.read_gold_questions(spark, str(path)).orderBy("index").collect()
    assert [(r["index"], r["database"], r["gold_sql"]) for r in rows] == [(0, "shop", "SELECT 1;"), (2, "web", "SELECT 2;")]
    bad = tmp_path / "b.csv"
    bad.write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        readers.read_gold_questions(spark, str(bad))


def test_ddl_files(spark, tmp_path):
    (tmp_path / "shop").mkdir()
    (tmp_path / "shop" / "schema.sql").write_text(
        "CREATE TABLE `shop`.`a` (\n  `id` int,\n  `n` varchar(5) NOT NULL,\n  PRIMARY KEY (`id`)\n);\n"
        "CREATE TABLE `shop`.`b` (\n  `a_id` int,\n  FOREIGN KEY (`a_id`) REFERENCES `shop`.`a`(`id`)\n);\n"
    )
    rows = readers.parse_ddl(readers.read_ddl(spark, str(tmp_path / "*" / "schema.sql"))).collect()
    got = {(r["table"], r["kind"], r["name"], r["definition"], r["ref_table"], r["ref_column"]) for r in rows}
    assert got == {
        ("a", "column", "id", "int", None, None),
        ("a", "column", "n", "varchar(5) NOT NULL", None, None),
        ("a", "key", "id", None, None, None),
        ("b", "column", "a_id", "int", None, None),
        ("b", "link", "a_id", None, "a", "id"),
    }


def test_uploads_and_content(spark, tmp_path):
    (tmp_path / "ok.csv").write_text("a\n1\n")
    (tmp_path / "fake.csv").write_bytes(b"PK\x03\x04zip")
    (tmp_path / "fake.db").write_bytes(b"not a database at all")
    files = readers.list_files(spark, str(tmp_path))
    unread = readers.list_files(spark, str(tmp_path), head_up_to=4).collect()
    assert {r["file"].rsplit("/", 1)[1]: (r["bytes"], r["head"] is None) for r in unread} == {
        "ok.csv": (4, False), "fake.csv": (7, True), "fake.db": (21, True)
    }
    problems = {r["file"].rsplit("/", 1)[1]: r["problem"] for r in readers.content_problems(files).collect()}
    assert problems == {"fake.csv": "is not a text CSV file.", "fake.db": "is not a valid SQLite database file."}
    listing = spark.createDataFrame(
        [("a", "x.csv", 5), ("b", "x.csv", 5), ("b", "y.db", 5), ("c", "z.csv", 0), ("d", "q.zip", 9), ("e", "s.sqlite3", 9)],
        "upload string, file string, bytes bigint",
    )
    got = {r["upload"]: r["verdict"] for r in readers.upload_verdicts(listing).collect()}
    assert got["a"] == "tabular" and got["e"] == "single" and got["c"] == "'z.csv' is empty."
    assert got["b"].startswith("Upload either one") and got["d"].startswith("Archives")


def test_row_caps(spark):
    frame, warning = readers.capped(spark.range(2500).toDF("a"), "t", 1000)
    assert frame.count() == 1000 and warning == "Table 't' was truncated to the first 1,000 rows."
    frame, warning = readers.capped(spark.range(1000).toDF("a"), "t", 1000)
    assert frame.count() == 1000 and warning is None


def test_smallest_in_task_by_bytes():
    """Batches are cut against the values kept so far; order is that of the bytes, nulls and repeats are left out."""
    batches = [["m", None, "￮", "m"], ["\U0001f600", "b", ""], [None, None], ["a", "z", "b"], ["é", "A"]]
    batches = [pa.record_batch([pa.array(b, pa.string()), pa.nulls(len(b), pa.string())], ["x", "none"]) for b in batches]
    run = documents._smallest_in_task(["x", "none"], 4)
    assert pa.Table.from_batches(run(iter(batches))).to_pylist() == [{"column": "x", "value": v} for v in ("", "A", "a", "b")]
    every = pa.Table.from_batches(documents._smallest_in_task(["x"], 9)(iter(b.select(["x"]) for b in batches)))
    assert every["value"].to_pylist() == ["", "A", "a", "b", "m", "z", "é", "￮", "\U0001f600"]


def test_inclusion_of_whole_numbers_and_texts(spark):
    """Whole numbers of any width are compared as such, others as text; the shares of both kinds come out together."""
    parent = Table("d", "a", spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "a_id int, t_code string"))
    rows = [(1, "x"), (1, "w"), (7, None), (None, "y")]
    child = Table("d", "b", spark.createDataFrame(rows, "a_id bigint, t_code string"))
    flags = Table("d", "c", spark.createDataFrame([(True,)], "a_id boolean"))
    pairs = [keys.Candidate(child, "a_id", parent, "a_id", 0), keys.Candidate(child, "t_code", parent, "t_code", 1)]
    pairs.append(keys.Candidate(flags, "a_id", parent, "a_id", 2))
    assert [keys._comparison(c) for c in pairs] == ["whole", "text", "text"]
    found = {r["pair"]: r["ratio"] for r in keys.inclusion(pairs).collect()}
    assert found == {0: pytest.approx(2 / 3), 1: pytest.approx(2 / 3), 2: 0}
