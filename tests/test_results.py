"""Evaluation, history, registry and store on small fixtures."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from schemaloom.operators import evaluation, guarded, history, registry
from schemaloom.sources import snapshots, store


def rows(spark, data):
    return spark.createDataFrame(data, "query int, position int, row array<string>")


def test_results_match(spark):
    gold = rows(spark, [(1, 1, ["a", None]), (1, 2, ["b", "1"]), (2, 1, ["a"]), (2, 2, ["b"]), (3, 1, ["x"]), (3, 2, ["x"])])
    pred = rows(spark, [(1, 1, ["b", "1"]), (1, 2, ["a", None]), (2, 1, ["b"]), (2, 2, ["a"]), (3, 1, ["x"])])
    statements = spark.createDataFrame(
        [(1, "SELECT 1", "SELECT 1", True, True), (2, "SELECT 1 ORDER  BY 1", "SELECT 1", True, True),
         (3, "SELECT 1", "SELECT 1", True, True), (4, "SELECT 1", "SELECT 1", True, True),
         (5, "SELECT 1", "SELECT 1", False, True)],
        "query int, predicted_sql string, gold_sql string, predicted_ok boolean, gold_ok boolean",
    )
    got = {r["query"]: r["matches"] for r in evaluation.results_match(pred, gold, statements).collect()}
    # 1 same bag; 2 order differs; 3 one copy is missing; 4 both empty; 5 no result.
    assert got == {1: True, 2: False, 3: False, 4: True, 5: False}
    swapped = {r["query"]: r["matches"] for r in evaluation.results_match(gold, pred, statements).collect()}
    assert swapped == got


def test_empty_summary(spark):
    schema = (
        "sql_exact_match boolean, execution_correct boolean, validation_valid boolean, status string, "
        "latency_seconds double, llm_calls int"
    )
    row = evaluation.summary(spark.createDataFrame([], schema)).first()
    assert (row["total"], row["exact_percent"], row["mean_latency"], row["llm_calls"]) == (0, 0.0, 0.0, 0)


def test_status_order(spark):
    cases = [
        ("x", False, "boom", False, "e", False, "gold_execution_failed"),
        ("", False, "boom", False, "e", False, "rag_retrieval_failed"),
        ("", True, "HTTP 429", False, "", False, "quota_failure"),
        ("", True, "service unavailable", False, "", False, "service_unavailable"),
        ("", True, "boom", True, "", True, "error"),
        ("", True, "", False, "e", True, "validation_failed"),
        ("", True, "", True, "e", True, "execution_failed"),
        ("", True, "", True, "", True, "correct"),
        ("", True, "", True, "", False, "incorrect"),
    ]
    frame = spark.createDataFrame(
        cases,
        "gold_error string, has_context boolean, row_error string, validation_valid boolean, execution_error string, "
        "execution_correct boolean, want string",
    ).withColumn("status", evaluation.status(F.col("row_error")))
    assert [r["want"] for r in frame.collect()] == [r["status"] for r in frame.collect()]


def test_table_lists(spark):
    cases = {'["a", " b ", ""]': ["a", "b"], "a| b |": ["a", "b"], "a, b": ["a", "b"], " x ": ["x"], "": [], "[1, 2]": ["1", "2"]}
    frame = spark.createDataFrame([(c,) for c in cases], "v string")
    assert {r[0]: r[1] for r in frame.select("v", evaluation.table_list(F.col("v"))).collect()} == cases


def test_result_json_and_page(spark):
    frame = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 1, None)], "q int, n int, v string")
    got = {r["q"]: r["json"] for r in guarded.result_json(frame, "q", ["n"]).collect()}
    assert got == {1: '[{"v":"a","n":1},{"v":"b","n":2}]', 2: '[{"n":1}]'}
    pages = [r["id"] for r in guarded.page(spark.range(45).repartition(3), 2, [F.col("id")]).collect()]
    assert sorted(pages) == [40, 41, 42, 43, 44]


def entries(spark):
    return spark.createDataFrame(
        [(n, "ann" if n % 3 else "bob", f"Q{n}", "web" if n % 2 else None, "SELECT 1", n, None if n == 4 else float(n),
          datetime(2024, 1, 1, 0, n)) for n in range(1, 10)],
        "id bigint, owner string, question string, database string, sql string, row_count bigint, latency_ms double, "
        "ts timestamp_ntz",
    )


def test_history(spark):
    frame = entries(spark)
    kept = history.retain(frame, 2).collect()
    assert sorted(r["id"] for r in kept if r["owner"] == "ann") == [7, 8]
    assert sorted(r["id"] for r in kept if r["owner"] == "bob") == [6, 9]
    assert "owner" not in history.of_owner(frame, "bob").columns
    assert history.totals(frame).first().asDict() == {"queries": 9, "rows": 45, "mean_latency": 5}
    assert history.monitor_totals(frame).first().asDict() == {"rows": 45, "mean_latency": 5, "databases": 1}
    assert history.totals(frame.limit(0)).first().asDict() == {"queries": 0, "rows": 0, "mean_latency": 0}
    assert [r["id"] for r in history.search(frame, " q3 ").collect()] == [3]
    assert history.search(frame, "", "web").count() == 5
    bars = history.latest_bars(frame, 3).collect()
    assert [r["id"] for r in bars] == [7, 8, 9] and bars[-1]["height"] == 100.0
    asked = spark.createDataFrame([("bob", 1), ("bob", 3)], "owner string, id bigint")
    assert [r["id"] for r in history.one_item(frame, asked).collect()] == [3]
    assert history.without_items(frame, asked).count() == 8
    fresh = spark.createDataFrame([("cy", "new", 1), ("cy", "newer", 2)], "owner string, question string, arrival bigint")
    both = history.append(
        frame.select("id", "owner", "question", "ts"), fresh, F.to_timestamp_ntz(F.lit("2024-02-01 00:00:00"))
    )
    assert sorted(r["id"] for r in both.filter("owner = 'cy'").collect()) == [10, 11]


NOW = "2024-01-10 00:00:00"


def data_sets(spark):
    return spark.createDataFrame(
        [("u_00000000000a", "ann", 100, "ready", datetime(2024, 1, 1), datetime(2024, 1, 8)),
         ("u_00000000000b", "ann", 200, "ready", datetime(2024, 1, 5), datetime(2024, 1, 12)),
         ("u_00000000000c", "bob", 300, "building", datetime(2024, 1, 6), None),
         ("u_00000000000d", "bob", 400, "ready", datetime(2024, 1, 7), None)],
        "id string, owner string, size_bytes bigint, status string, created_at timestamp_ntz, expires_at timestamp_ntz",
    )


def test_registry(spark):
    frame, now = data_sets(spark), F.to_timestamp_ntz(F.lit(NOW))
    assert {r["owner"]: (r["databases"], r["bytes"]) for r in registry.usage(frame).collect()} == {
        "ann": (2, 300),
        "bob": (2, 700),
    }
    uploads = spark.createDataFrame(
        [("ann", registry.MAX_BYTES_PER_OWNER - 300), ("bob", registry.MAX_BYTES_PER_OWNER), ("cy", 1)],
        "owner string, size_bytes bigint",
    )
    verdicts = {r["owner"]: r["verdict"] for r in registry.quota_verdict(uploads, frame).collect()}
    assert verdicts == {"ann": "ok", "bob": "too_large", "cy": "ok"}
    active = registry.active(frame, now)
    assert "owner" not in active.columns and active.count() == 3
    docs = spark.createDataFrame([("u_00000000000a", 1), ("u_00000000000b", 2)], "database string, n int")
    kept, kept_docs = registry.purge(frame, docs, now)
    assert kept.count() == 3 and [r["n"] for r in kept_docs.collect()] == [2]
    requests = spark.createDataFrame(
        [(" U_00000000000B ", "ann"), ("u_00000000000b", "bob"), ("u_00000000000a", "ann"), ("u_00000000000c", "bob"),
         ("u_00000000000d", ""), ("`shop`", "x"), ("mysql", "x"), ("u_00000000000f", "ann"), (None, "ann")],
        "database string, owner string",
    )
    allowed = spark.createDataFrame([("shop",)], "database string")
    got = [r["verdict"] for r in registry.check_access(requests, frame, allowed, now).collect()]
    assert sorted(got) == sorted(["user", "builtin"] + ["Database not found."] * 7)


def test_names_days_sizes(spark):
    names = spark.createDataFrame(
        [(1, "mysql"), (1, "bad name"), (2, " `Shop` "), (2, "u_0123456789ab"), (3, "late")], "priority int, database string"
    )
    assert [r["database"] for r in registry.allow_list(names).collect()] == ["shop"]
    frame = spark.createDataFrame([(1023,), (1024,), (5 * 1024 * 1024,)], "n bigint")
    assert [r[0] for r in frame.select(registry.size_text(F.col("n"))).collect()] == ["1023 B", "1.0 KB", "5.0 MB"]
    times = spark.createDataFrame(
        [(datetime(2024, 1, 10),), (datetime(2024, 1, 10, 1),), (datetime(2024, 1, 12, 1),), (None,)], "t timestamp_ntz"
    )
    shown = times.select(registry.days_left(F.col("t"), F.to_timestamp_ntz(F.lit(NOW)))).collect()
    assert [r[0] for r in shown] == ["expiring", "1 day left", "3 days left", None]
    client = spark.createDataFrame([("abcdefgh12345678",), ("short",), (None,)], "c string")
    hashes = [r[0] for r in client.select(registry.owner_hash(F.col("c"), "s")).collect()]
    assert len(hashes[0]) == 64 and hashes[1:] == ["", ""]


def test_store_replaces_one_database_only(spark, tmp_path):
    path = str(tmp_path / "index")
    first = spark.createDataFrame([("a", "a::1", "x"), ("b", "b::1", "y")], "database string, id string, text string")
    store.write_documents(first, path)
    store.write_documents(spark.createDataFrame([("a", "a::2", "z")], first.schema), path)
    got = {(r["database"], r["id"]) for r in store.read_documents(spark, path).collect()}
    assert got == {("a", "a::2"), ("b", "b::1")}
    assert [r["id"] for r in store.read_documents(spark, path, "b").collect()] == ["b::1"]
    merged = store.upsert(first, spark.createDataFrame([("b", "b::1", "new")], first.schema))
    assert {r["id"]: r["text"] for r in merged.collect()} == {"a::1": "x", "b::1": "new"}


def test_load_if_empty_and_results_file(spark, tmp_path):
    path = str(tmp_path / "t")
    assert store.load_if_empty(spark.range(3), path) and not store.load_if_empty(spark.range(3), path)
    assert spark.read.parquet(path).count() == 3
    results = spark.range(1).select(*[F.lit(f"{c} \"x\",\n").alias(c) for c in evaluation.RESULT_COLUMNS])
    store.write_results(results, str(tmp_path / "r"))
    back = spark.read.csv(str(tmp_path / "r"), header=True, quote='"', escape='"', multiLine=True)
    assert back.columns == evaluation.RESULT_COLUMNS and back.first()["status"] == 'status "x",\n'


def test_context_fallbacks(spark):
    asked = spark.createDataFrame(
        [(1, "d", ["t2", "t1"]), (2, "d", ["gone"]), (3, "e", [])], "q_id bigint, database string, tables array<string>"
    )
    docs = spark.createDataFrame([("d::t1", "one"), ("d::t2", "two"), ("d::t3", "")], "id string, text string")
    hits = spark.createDataFrame([(1, "d::t1", 1), (2, "d::t3", 1), (2, "d::t1", 2)], "q_id bigint, id string, rank int")
    got = {r["q_id"]: (r["source"], r["contexts"]) for r in evaluation.lookup_context(asked, docs, hits).collect()}
    assert got == {
        1: ("recorded", ["two", "one"]),
        2: ("vector", ["one"]),
        3: ("none", ["DATABASE: e\nNo schema context retrieved."]),
    }


def test_numbering_over_ranges(spark):
    # One query holds most rows; its positions run through all ranges.
    frame = spark.range(0, 3000).select(
        F.when(F.col("id") % 10 < 9, 1).otherwise(F.col("id") % 7 + 2).alias("query"), ((F.col("id") * 7919) % 3001).alias("key")
    )
    got = evaluation.numbered(frame.repartition(6), "query", ["key"]).collect()
    by_query = {}
    for r in got:
        by_query.setdefault(r["query"], []).append((r["key"], r["position"]))
    for found in by_query.values():
        assert [p for _, p in sorted(found)] == list(range(1, len(found) + 1))
    assert len(got) == 3000


def test_snapshots_change_in_one_step(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        snapshots.current(spark, path)
    schema = "database string, folder string, n int"
    first = spark.createDataFrame([("a/b", "x", 1), ("01", "y", 2), (None, "z", 3), ("", "w", 4)], schema)

    def held():
        return sorted(map(tuple, snapshots.current(spark, path).collect()), key=repr)

    snapshots.commit(first, path, "database")
    before = held()
    assert before == sorted(map(tuple, first.collect()), key=repr)
    bad = first.withColumn("n", F.when(F.col("n") == 2, F.raise_error(F.lit("broken")).cast("int")).otherwise(F.lit(9)))
    with pytest.raises(Exception, match="broken"):
        snapshots.commit(bad, path, "database")
    assert held() == before
    open_reader = snapshots.current(spark, path)
    snapshots.commit(spark.createDataFrame([("01", "new", 5), ("01", "new", 5)], schema), path, "database")
    assert held() == sorted([r for r in before if r[0] != "01"] + [("01", "new", 5)] * 2, key=repr)
    assert open_reader.count() == 4 and snapshots.drop_old(spark, path) == 0
    snapshots.commit(first.where("false"), path, "database")
    assert len(held()) == 5
    snapshots.commit(spark.createDataFrame([("", "v", 6)], schema), path, "database")
    assert ("", "v", 6) in held() and (None, "z", 3) in held() and len(held()) == 5
    with pytest.raises(ValueError):
        snapshots.commit(spark.range(2), path, "id")
    snapshots.commit(spark.range(2), path)
    assert held() == [(0,), (1,)] and snapshots.drop_old(spark, path) >= 2
    snapshots.commit(spark.range(0), path)
    assert held() == []
