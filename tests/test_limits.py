"""Long texts, large numbers, broken bytes and functions that only Spark has."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from schemaloom.functions import rules, text, values
from schemaloom.operators import guarded, registry, retrieval
from schemaloom.sources import readers


def test_large_ids_stay_exact(spark, tmp_path):
    path = tmp_path / "ids.csv"
    path.write_text(
        "a,b,c,d\n1234567890123456789,99999999999999999999,1.5,1\n"
        f"1234567890123456788,-1,2,{'9' * 60}\n"
    )
    frame = readers.read_delimited(spark, str(path), sep=",")
    assert [f.dataType.simpleString() for f in frame.schema] == ["bigint", "decimal(38,0)", "double", "string"]
    assert {r.a for r in frame.collect()} == {1234567890123456789, 1234567890123456788}
    assert {int(r.b) for r in frame.collect()} == {99999999999999999999, -1}


def test_long_quoted_cell(spark, tmp_path):
    path = tmp_path / "long.csv"
    cell = "x" * 1_000_000
    path.write_text(f'a,b\n1,"{cell}"\n2,"{cell}",3,4\n')
    assert [r.a for r in readers.read_delimited(spark, str(path), sep=",").collect()] == [1]


@pytest.mark.parametrize("quote", ["'", '"', "`"])
def test_long_literals(spark, quote):
    inner = ("a" * 1_000 + quote * 2) * 1_000
    sql = f"SELECT {quote}{inner}{quote} FROM t"
    frame = spark.createDataFrame([(sql,)], "sql string")
    view = frame.select(rules.keyword_view(F.col("sql")).alias("v"), rules.has_open_quote(F.col("sql")).alias("o")).first()
    assert view.v == f"SELECT {'`ID`' if quote == '`' else repr('VALUE')} FROM t" and not view.o


def test_long_phrases(spark):
    text = "word " * 200_000
    found = spark.createDataFrame([(text,)], "t string").select(retrieval.question_phrases(F.col("t")).alias("p")).first()
    assert found.p == [text.strip()]


def test_bytes_that_are_not_utf8(spark):
    frame = spark.createDataFrame([(bytearray(b"a\xffb"),)], "b binary")
    shown, compared = frame.select(
        values.result_cell(F.col("b"), T.BinaryType()), values.comparable_cell(F.col("b"), T.BinaryType())
    ).first()
    assert shown == compared == "a\ufffdb"


REFUSED = [
    "SELECT reflect(concat('java', char(46), 'lang', char(46), 'System'), 'getenv', 'PATH')",
    "SELECT java_method('java.lang.System', 'getenv', 'PATH')",
    "SELECT try_reflect('java.lang.System', 'getenv', 'PATH')",
    "SELECT `reflect`('java.lang.System', 'getenv', 'PATH')",
    "SELECT current_schema()",
    "SELECT current_user",
    "SELECT * FROM parquet.`/etc`",
    "SELECT input_file_name() FROM t",
    "SELECT user",
    "SELECT id, user AS who FROM t",
    "SELECT id FROM t WHERE id IN (SELECT length(user) FROM t)",
    "WITH w AS (SELECT upper(USER) AS x FROM t) SELECT x FROM w",
]


@pytest.mark.parametrize("sql", REFUSED)
def test_spark_functions_are_refused(spark, sql):
    spark.range(3).createOrReplaceTempView("t")
    with pytest.raises(guarded.Refused):
        guarded.guarded_select(spark, sql, "shop")


def test_plain_statements_pass(spark):
    spark.range(3).createOrReplaceTempView("t")
    sql = "SELECT count(*) AS n, coalesce(max(id), 0) AS m FROM t WHERE id IN (0, 1, 2) AND (id < 5)"
    assert tuple(guarded.guarded_select(spark, sql, "shop").first()) == (3, 2)
    for plain in ("SELECT now() AS at FROM t", "SELECT std(id), isnull(max(id)) FROM t", "SELECT current_date() FROM t"):
        assert guarded.guarded_select(spark, plain, "shop").count() > 0
    spark.sql("select 'ann' as user").createOrReplaceTempView("accounts")
    assert guarded.guarded_select(spark, "SELECT user FROM accounts", "shop").first()[0] == "ann"


def test_nothing_is_cut_by_default(spark):
    frame = spark.range(2_500)
    assert readers.capped(frame, "t")[0].count() == guarded.shown_rows(frame).count() == 2_500
    kept, warning = readers.capped(frame, "t", 1_000)
    assert kept.count() == 1_000 and "truncated" in warning


def test_strip_of_long_white_space(spark):
    inner = "a" + " \u00a0" * 300_000 + "b"
    frame = spark.createDataFrame([("\u2003\t " + inner + "\u00a0\r\n",), ("\u3000",), (None,)], "t string")
    assert [r.s for r in frame.select(text.strip(F.col("t")).alias("s")).collect()] == [inner, "", None]


def test_comments_in_allow_list(spark):
    lines = ["shop  # the main one", "# nothing here", "", None, "`Bank`", "mysql # system", "two words", "shop"]
    found = registry.listed_names(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert sorted(r.database for r in found.collect()) == ["bank", "shop"]
