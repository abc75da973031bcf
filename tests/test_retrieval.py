"""Scores and top-k against brute force on small fixtures."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from schemaloom.functions.text import words_narrow
from schemaloom.operators import impact, nearest, retrieval, routing, tally

DOCS = {
    "a": "TABLE: student\nCOLUMNS:\n- id (INTEGER)\nFOREIGN KEYS:\n- city -> cities.id\nSAMPLE VALUES:\n- hobby: Mountain Climbing, Golf, golf",
    "b": "TABLE: course\nCOLUMNS:\n- title (TEXT)\n- id (INTEGER)\nSAMPLE VALUES:\n- title: Golf, AI",
    "c": "TABLE: shop_item\nCOLUMNS:\n- price_total (REAL)",
}
QUESTIONS = {
    1: "Which students like Mountain Climbing or golf?",
    2: "Show the id and title of each course related to golf",
    3: "price total of a shop",
    4: "",
    5: "zzz",
}


def frames(spark):
    asked = spark.createDataFrame(list(QUESTIONS.items()), "q_id bigint, text string")
    docs = spark.createDataFrame(list(DOCS.items()), "d_id string, text string")
    return asked, docs


def wide(text):
    return set(re.sub(r"[?,.!'\"():;_-]", " ", text.lower()).split())


def phrases(doc):
    after = doc.split("SAMPLE VALUES:")[1].split("\n") if "SAMPLE VALUES:" in doc else []
    return [v.strip().lower() for x in after if x.startswith("-") for v in x.split(":", 1)[1].split(",")]


def test_hybrid_scores_against_brute_force(spark):
    asked, docs = frames(spark)
    got = {(r["q_id"], r["d_id"]): r["score"] for r in retrieval.hybrid_scores(asked, docs).collect()}
    expected = {}
    for q, text in QUESTIONS.items():
        for d, doc in DOCS.items():
            terms = set()
            for line in doc.split("\n"):
                if line.startswith("TABLE:"):
                    terms |= wide(line[6:])
                elif line.startswith("-"):
                    terms |= wide(line[1:].split()[0])
            values = phrases(doc)
            base = len(wide(text) & terms) + 3 * len(wide(text) & wide(" ".join(values)))
            base += 20 * sum(len(v) >= 3 and v in text.lower() for v in values)
            if base:
                expected[q, d] = base + ("foreign keys:" in doc.lower() and len(wide(text)) >= 2)
    assert got == expected


def test_phrase_join_equals_containment(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(200)]
    asked = [(n, " ".join(rng.sample(words, 8))) for n in range(60)]
    docs = [(str(n), "TABLE: t\nSAMPLE VALUES:\n- c: " + ", ".join(rng.sample(words, 6))) for n in range(40)]
    got = {
        (r["q_id"], r["d_id"], r["phrase"])
        for r in retrieval.phrase_hits(
            spark.createDataFrame(asked, "q_id bigint, text string"), spark.createDataFrame(docs, "d_id string, text string")
        ).collect()
    }
    expected = {(q, d, p) for q, t in asked for d, doc in docs for p in phrases(doc) if len(p) >= 3 and p in t}
    assert got == expected


def test_database_scores_find_runs_across_words(spark):
    asked = spark.createDataFrame([(1, "the student course"), (2, "udent cour")], "q_id bigint, text string")
    docs = spark.createDataFrame([("x", "A student course list"), ("y", "nothing")], "d_id string, text string")
    got = {(r["q_id"], r["d_id"]): r["score"] for r in retrieval.database_scores(asked, docs).collect()}
    # 1: two shared tokens and two shared keywords; its run starts with a word the text lacks.
    # 2: no shared token, but the run is inside the text.
    assert got == {(1, "x"): 6, (2, "x"): 15}


def test_overlap_top_k_matches_brute_force(spark):
    rng = random.Random(1)
    vocabulary = [f"w{n}" for n in range(30)]
    # One word is in every document, another in a third of them.
    docs = [
        (n, " ".join(["the", "hot" if n % 3 == 0 else "cold", *rng.sample(vocabulary, 5)])) for n in range(300)
    ]
    asked = [(n, " ".join(["the", "hot", *rng.sample(vocabulary, 6)])) for n in range(25)]
    expected = []
    for q, text in asked:
        scores = sorted((-len(set(text.split()) & set(t.split())), d) for d, t in docs)
        expected += [(q, d, -s, n + 1) for n, (s, d) in enumerate(scores[:7])]
    q = spark.createDataFrame(asked, "q_id bigint, text string")
    d = spark.createDataFrame(docs, "d_id bigint, text string").repartition(5)

    def run(**sizes):
        found = retrieval.overlap_top_k(q, d, 7, words_narrow, **sizes).select("q_id", "d_id", "score", "rank")
        return sorted((tuple(r) for r in found.collect()), key=lambda r: (r[0], r[3]))

    assert run() == expected
    # The same result from many parts and blocks.
    assert run(documents_at_once=40, questions_at_once=4) == expected


def test_index_stops_early_without_loss():
    rng = random.Random(4)
    keys = [f"k{n}" for n in range(12)]
    docs = {d: {key: rng.choice([1, 1, 2, 9, 30]) for key in rng.sample(keys, rng.randrange(0, 9))} for d in range(400)}
    lists = [
        pa.array([{"d_id": d, "weight": w[key]} for d, w in docs.items() if key in w], pa.struct([("d_id", pa.int64()), ("weight", pa.int64())]))
        for key in keys
    ]
    index = impact.Index(keys, lists)
    for n in range(200):
        asked = [{"key": key, "factor": rng.choice([1, 3]), "bonus": rng.random() < 0.2} for key in rng.sample([*keys, "none"], 6)]
        k = rng.choice([1, 5, 50])
        scores = {}
        for d, w in docs.items():
            if any(a["key"] in w and not a["bonus"] for a in asked):
                scores[d] = sum(a["factor"] * w.get(a["key"], 0) for a in asked)
        best = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]
        ids, found = index.best(asked, k)
        assert list(zip(ids.tolist(), found.tolist())) == best


def test_hybrid_top_k_is_the_best_of_all_scores(spark):
    asked, docs = frames(spark)
    every = [tuple(r) for r in retrieval.hybrid_scores(asked, docs).select("q_id", "d_id", "score").collect()]
    for k in (1, 2, 50):
        got = {(r.q_id, r["rank"]): (r.d_id, r.score) for r in retrieval.hybrid_top_k(asked, docs, k, documents_at_once=1).collect()}
        expected = {}
        for q in QUESTIONS:
            best = sorted(((d, s) for i, d, s in every if i == q), key=lambda x: (-x[1], x[0]))[:k]
            expected |= {(q, n + 1): x for n, x in enumerate(best)}
        assert got == expected


def test_phrases_of_a_long_question(spark):
    text = "blue river stone " * 60_000 + "the very end"
    asked = spark.createDataFrame([(1, text), (2, "")], "q_id bigint, q_text string")
    known = spark.createDataFrame([("river stone",), ("very end",), ("stone blue river",), ("absent",), ("er",)], "phrase string")
    got = {tuple(r) for r in retrieval.contained_phrases(asked, known).collect()}
    assert got == {(1, "river stone"), (1, "very end"), (1, "stone blue river")}


def test_vector_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = rng.integers(-3, 4, size=(200, 8)).astype("float32")
    groups = [0 if n % 3 else n % 7 for n in range(200)]
    queries = rng.integers(-3, 4, size=(12, 8)).astype("float32")
    v = spark.createDataFrame(
        [(n, vectors[n].tolist(), groups[n]) for n in range(200)], "d_id bigint, vector array<float>, grp int"
    ).repartition(6)
    q = spark.createDataFrame(
        [(n, queries[n].tolist(), n % 3) for n in range(12)], "q_id bigint, vector array<float>, grp int"
    )

    def expected(same):
        rows = []
        for n in range(12):
            near = sorted(
                (float(((vectors[m].astype("float64") - queries[n]) ** 2).sum()), m)
                for m in range(200)
                if not same or groups[m] == n % 3
            )[:9]
            rows += [(n, m, dist, k + 1) for k, (dist, m) in enumerate(near)]
        return rows

    def run(same, **sizes):
        found = retrieval.vector_top_k(q, v, 9, same_group=same, **sizes).select("q_id", "d_id", "distance", "rank")
        return sorted((tuple(r) for r in found.collect()), key=lambda r: (r[0], r[3]))

    assert run(False) == expected(False)
    assert run(True) == expected(True)
    # The same with blocks of few rows.
    assert run(True, query_block=2, block_bytes=640) == expected(True)
    assert run(False, query_block=5, block_bytes=640) == expected(False)


def test_blocks_far_away_are_never_read(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, 4)) * 1000
    vectors = [(n, (centres[n % 6] + rng.normal(size=4)).tolist(), 0) for n in range(300)]
    v = spark.createDataFrame(vectors, "d_id bigint, vector array<double>, grp int")
    q = spark.createDataFrame([(0, vectors[0][1], 0), (1, None, 0)], "q_id bigint, vector array<double>, grp int")
    pivots = np.array([vectors[n][1] for n in range(6)])

    def cut(frame, name):
        shaped = frame.select(F.col(name).alias("id"), F.lit("0").alias("grp"), F.col("vector").alias("data"))
        return nearest.blocks(shaped.where("data is not null"), pivots, 10)

    held = cut(v, "d_id")
    pairs = nearest.block_pairs(cut(q, "q_id"), held, pivots, 10).collect()
    cells = {r["block"]: r["cell"] for r in held.collect()}
    assert {cells[r["vb"]] for r in pairs} == {0} and len(cells) > 25
    found = retrieval.vector_top_k(q, v, 3).collect()
    own = np.array([x for _, x, _ in vectors])
    order = np.argsort(((own - own[0]) ** 2).sum(axis=1), kind="stable")[:3]
    assert [r["d_id"] for r in sorted(found, key=lambda r: r["rank"])] == order.tolist()
    assert retrieval.vector_top_k(q, v.limit(0), 3).collect() == []


def test_scores_are_the_same_without_broadcast(spark, monkeypatch):
    asked, docs = frames(spark)

    def run():
        found = [
            retrieval.hybrid_scores(asked, docs),
            retrieval.router_scores(asked, docs),
            retrieval.database_scores(asked, docs),
        ]
        return [sorted(tuple(r) for r in f.select("q_id", "d_id", "score").collect()) for f in found]

    small = run()
    monkeypatch.setattr("schemaloom.runtime.BROADCAST_ROWS", 0)
    monkeypatch.setattr("schemaloom.runtime.fits", lambda df, max_rows=0: False)
    assert run() == small


def test_routing_decisions(spark):
    asked = spark.createDataFrame([(n, "q") for n in range(1, 5)], "q_id bigint, text string")
    scores = spark.createDataFrame(
        [(1, "Shop", 5), (1, "web", 3), (2, "web", 3), (2, "shop", 3), (3, "shop", 4), (3, "`SHOP`", 9)],
        "q_id bigint, database string, score bigint",
    )
    names = spark.createDataFrame([("web",), ("shop",), ("zoo",)], "database string")
    got = {r["q_id"]: r for r in routing.route(asked, scores, names).collect()}
    assert got[1]["database"] == "Shop" and got[1]["question_back"] == ""
    assert got[2]["database"] == "" and got[2]["candidates"][:2] == ["shop", "web"]
    # Two spellings of one database count once, with the better score.
    assert got[3]["database"] == "`SHOP`" and got[3]["second_score"] == 0
    assert got[4]["database"] == "" and got[4]["candidates"] == ["shop", "web", "zoo"]


def test_selection_bridges_and_context(spark):
    scored = spark.createDataFrame(
        [(1, "d", "Student", 9), (1, "d", "Course", 4), (1, "d", "Enrolled_in", 0), (1, "d", "Minor_in", 0), (1, "d", "Dept", 1)]
        + [(2, "d", t, 0) for t in ("Course", "Dept", "Enrolled_in", "Minor_in", "Student")],
        "q_id bigint, database string, table string, score bigint",
    )
    links = spark.createDataFrame(
        [("d", "Enrolled_in", "sid", "Student", "id"), ("d", "Enrolled_in", "cid", "Course", "id"),
         ("d", "Minor_in", "sid", "Student", "id"), ("d", "Minor_in", "did", "Dept", "id")],
        "database string, table string, column string, ref_table string, ref_column string",
    )
    selected = routing.select_tables(retrieval.as_rankings(scored))
    picked = {r["q_id"]: [t["table"] for t in r["selected"]] for r in selected.collect()}
    assert picked == {1: ["Student", "Course", "Dept"], 2: ["Course", "Dept", "Enrolled_in"]}
    chosen = routing.add_bridges(selected, links)
    got = {r["q_id"]: (r["bridges"], r["forced"]) for r in chosen.collect()}
    # Dept scored too low, so Minor_in is no bridge.
    assert got == {1: (["Enrolled_in"], ["Enrolled_in"]), 2: ([], [])}
    docs = scored.filter("q_id = 1").select("database", "table", F.concat(F.lit("TABLE: "), "table").alias("text"))
    context = {r["q_id"]: r["context"] for r in routing.assemble_context(chosen, docs).collect()}
    assert context[1] == "TABLE: Student\n\nTABLE: Course\n\nTABLE: Dept\n\nTABLE: Enrolled_in"


def test_rank_bonus_uses_first_hits(spark):
    scored = spark.createDataFrame([(1, "A", 1), (1, "B", 5), (1, "C", 0)], "q_id bigint, table string, score bigint")
    hits = spark.createDataFrame(
        [(1, "c", 1), (1, "c", 2), (1, "b", 3), (1, "a", 4)], "q_id bigint, table string, rank int"
    )
    got = {r["table"]: r["score"] for r in retrieval.rank_bonus(scored, hits).collect()}
    # Three tables: only the first three hits count.
    assert got == {"A": 1, "B": 12, "C": 12}


def test_many_questions_of_few_documents(monkeypatch):
    """Questions scored many at once get what each of them gets alone, with ties, bonuses, repeats and unknown keys."""
    draw = random.Random(5)
    ids = [f"d{i}" for i in range(9)]
    lists = [[{"d_id": d, "weight": draw.randint(1, 4)} for d in draw.sample(ids, draw.randint(1, 9))] for _ in range(12)]
    index = impact.Index([f"k{i}" for i in range(12)], [pa.array(x) for x in lists])
    names = [f"k{i}" for i in range(15)]
    asked = [
        [{"key": draw.choice(names), "factor": draw.randint(1, 3), "bonus": draw.random() < 0.3} for _ in range(draw.randint(0, 6))]
        for _ in range(60)
    ]
    kind = pa.list_(pa.struct([("key", pa.string()), ("factor", pa.int32()), ("bonus", pa.bool_())]))
    monkeypatch.setattr(impact, "CELLS", 50)
    for k in (1, 4, 20):
        rows, found, scores = index.best_of_few(pa.array([[], *asked], kind).slice(1), k)
        got = [[] for _ in asked]
        for row, d, score in zip(rows.tolist(), found.tolist(), scores.tolist()):
            got[row].append((d, score))
        assert got == [list(zip(*(x.tolist() for x in index.best(a, k)))) for a in asked]


def test_windows_start_with_known_starts_only(spark, monkeypatch):
    """Phrases with marks of patterns, of other alphabets and beyond 16 bits, found by named starts and by any window."""
    phrases = ["a.b", "abc", "abcd", "[x]", "^x-y", "\\q\\e", "a|b|c", "éü日", "\U0001f600ab", "z\U0001f600y", "ab", "  \n"]
    texts = [None, "", "ab", "xabcd a|b|c", "a.bc a-b [x]^x-y", "\\q\\e", "\U0001f600\U0001f600abc z\U0001f600y", "éü日本", "q  \n", "a|b[x"]
    asked = spark.createDataFrame(list(enumerate(texts)), "q_id int, q_text string")
    known = spark.createDataFrame([(p,) for p in phrases], "phrase string")
    wanted = {(i, p) for i, t in enumerate(texts) for p in phrases if t and len(p) >= 3 and p in t}
    for bound in (retrieval.STARTS, 3):
        monkeypatch.setattr(retrieval, "STARTS", bound)
        found = [tuple(r) for r in retrieval.contained_phrases(asked, known).collect()]
        assert sorted(found) == sorted(wanted)
    assert re.fullmatch(retrieval._one_of(["abc", "abd", "xyz"]).replace(r"\x{", r"\x").replace("}", ""), "abd")
    none = known.where("phrase = 'ab'")
    assert retrieval.contained_phrases(asked, none).count() == 0


def test_null_questions_have_no_best_documents(spark):
    docs = spark.createDataFrame(list(DOCS.items()), "d_id string, text string")
    asked = spark.createDataFrame([(1, None), (2, "golf")], "q_id int, text string")
    found = [tuple(r)[:2] for r in retrieval.hybrid_top_k(asked, docs, 1).collect()]
    assert found == [(2, "a")]


def test_few_documents_score_batches_of_questions_as_the_keyed_joins_do(spark, monkeypatch):
    """Repeated and null ids, null texts, unknown databases and repeated tables: the same rows without rows by word."""
    asked = [
        (1, "Shop", "Student Ann, the big order list of a big order list"), (1, "Shop", "orders by red apple"), (1, "b", "activities"),
        (None, "Shop", "join red apple"), (None, "Shop", "orders"), (2, "Shop", None), (3, "none", "orders"), (4, None, "orders"),
        (5, "b", ""), (6, "b", "İred Apple pie in a course"), (7, "Shop", "the the _x 7"),
    ]
    docs = [
        ("Shop", "orders", "plain", "TABLE: orders\n- fruit: red apple\n- kind: ab\n- x: ann"),
        ("Shop", "student", "plain", "TABLE: student\n- name: ann\n- other: Ann"),
        ("Shop", "student", "user", "a big order list of a student"),
        ("Shop", "", "plain", "- fruit: orders"), ("Shop", None, "plain", "orders"), (None, "t", "plain", "orders"),
        ("b", "activity_x", None, "- a: red apple pie\n- b: red apple pie\nİ"), ("c", "other", "user", None),
    ]
    q = spark.createDataFrame(asked, "q_id bigint, database string, text string")
    d = spark.createDataFrame(docs, "database string, table string, kind string, text string")
    named = d.selectExpr("kind || table as d_id", "text")
    twice = named.withColumn("d_id", F.when(F.col("d_id") != "plain", F.lit("x")))

    def got():
        tables = retrieval.table_rankings(q, d).selectExpr("q_id", "database", "inline(tables)")
        frames = (retrieval.table_scores(q, d), tables, *[retrieval.database_scores(q, x) for x in (named, twice)])
        return [sorted((tuple(r) for r in f.collect()), key=str) for f in frames]

    few = got()
    explained = retrieval.table_rankings(q, d)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in explained  # no row per word of a question
    monkeypatch.setattr(tally, "PLACES", 0)
    keyed = got()
    assert few == keyed and few[0] == few[1] and all(few)
