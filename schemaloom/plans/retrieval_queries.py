"""Tokens, scores, vector search and table selection over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from schemaloom.functions.text import words_ascii, words_narrow, words_wide
from schemaloom.operators import evaluation, retrieval, routing
from schemaloom.operators.documents import sample_phrases
from schemaloom.plans import schema_sql as sx
from schemaloom.plans.inputs import (
    QUESTIONS_SQL,
    document_vectors,
    load,
    question_vectors,
    questions,
    schema_index,
)
from schemaloom.plans.registered import ORACLES, query
from schemaloom.runtime import materialise

WIDE, NARROW = "?,.!''\"():;_-", "?,.!''\"():;"


def tokens_sql(text: str, separators: str) -> str:
    blanks = " " * (len(separators) - 1)
    return (
        f"list_distinct(list_filter(regexp_split_to_array(translate(lower({text}), '{separators}', '{blanks}'), '\\s+'), "
        "lambda x: x <> ''))"
    )


def ascii_sql(text: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({text}), '[a-z0-9_]+'))"


def _token_rows(spark, sf_dir, tokens):
    words = tokens(F.col("text"))
    return load(spark, sf_dir, "documents").select(
        "doc_id", F.size(words).alias("n"), F.array_join(F.array_sort(words), " ").alias("words")
    )


def _token_sql(words: str) -> str:
    return f"""select doc_id, cast(len({words}) as int) as n, array_to_string(list_sort({words}), ' ') as words
      from documents"""


@query("r1a_words_wide", _token_sql(tokens_sql("text", WIDE)))
def words_wide_rows(spark, sf_dir):
    return _token_rows(spark, sf_dir, words_wide)


@query("r1b_words_narrow", _token_sql(tokens_sql("text", NARROW)))
def words_narrow_rows(spark, sf_dir):
    return _token_rows(spark, sf_dir, words_narrow)


@query("r1c_words_ascii", _token_sql(ascii_sql("text")))
def words_ascii_rows(spark, sf_dir):
    return _token_rows(spark, sf_dir, words_ascii)


@query(
    "r2_overlap_scores",
    sx.with_index(QUESTIONS_SQL)
    + f""" select q_id, d_id, score from (
      select q_id, d_id, len(list_intersect({tokens_sql("q.text", NARROW)}, d.words)) as score
      from questions q, (select d_id, {tokens_sql("text", NARROW)} as words from dbdocs_) d) where score > 0""",
)
def overlap_scores(spark, sf_dir):
    docs = schema_index(spark, sf_dir).database_documents()
    return retrieval.overlap_scores(questions(spark, sf_dir), docs, words_narrow)


TOP_DOCUMENTS = 10


@query(
    "r2b_overlap_top_documents",
    f"""with q as (select item_id as q_id, unnest({tokens_sql("text", NARROW)}) as w from benchmark),
      d as (select doc_id as d_id, unnest({tokens_sql("text", NARROW)}) as w from documents),
      s as (select q_id, d_id, count(*) as score from q join d using (w) group by 1, 2),
      r as (select *, row_number() over (partition by q_id order by score desc, d_id) as rank from s)
      select q_id, d_id, score, cast(rank as int) as rank from r where rank <= {TOP_DOCUMENTS}""",
)
def overlap_top_documents(spark, sf_dir):
    asked = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q_id"), "text")
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("d_id"), "text")
    return retrieval.overlap_top_k(asked, docs, TOP_DOCUMENTS, words_narrow)


FIFTY = 50


@query("r2c_overlap_top_50", ORACLES["r2b_overlap_top_documents"].replace(f"rank <= {TOP_DOCUMENTS}", f"rank <= {FIFTY}"))
def overlap_top_50(spark, sf_dir):
    asked = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q_id"), "text")
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("d_id"), "text")
    return retrieval.overlap_top_k(asked, docs, FIFTY, words_narrow)


def _terms_sql(left: bool) -> str:
    dashed = (
        "replace(split_part(line, ':', 1), '-', '')"
        if left
        else r"regexp_split_to_array(trim(line[2:]), '\s+')[1]"
    )
    arrow = "" if left else "when line like '%->%' then replace(line, '->', ' ')"
    return f"""
terms_ as (
  select distinct d_id, unnest({tokens_sql("part", WIDE)}) as term from (
    select d_id, case when line like 'TABLE:%' then replace(line, 'TABLE:', '')
                      when line like '-%' then {dashed} {arrow} end as part
    from (select d_id, trim(unnest(string_split(text, chr(10)))) as line from source_))
  where part is not null)"""


PHRASES_SQL = """
phrases_ as (
  select d_id, phrase from (
    select d_id, lower(trim(unnest(string_split(regexp_replace(line, '^[^:]*:', ''), ',')))) as phrase
    from (select d_id, trim(unnest(string_split(text[strpos(text, 'SAMPLE VALUES:'):], chr(10)))) as line
          from source_ where strpos(text, 'SAMPLE VALUES:') > 0)
    where line like '-%' and line like '%:%')
  where phrase <> '')"""
TABLE_SOURCE = "source_ as (select id as d_id, text from docs_)"
DATABASE_SOURCE = "source_ as (select d_id, text from dbdocs_)"


@query(
    "r3_schema_terms",
    sx.with_index(TABLE_SOURCE, _terms_sql(left=False))
    + " select d_id, count(*) as n, string_agg(term, ' ' order by term) as terms from terms_ group by d_id",
)
def schema_terms(spark, sf_dir):
    terms = retrieval.schema_terms(F.col("text"))
    return schema_index(spark, sf_dir).documents.select(
        F.col("id").alias("d_id"),
        F.size(terms).cast("bigint").alias("n"),
        F.array_join(F.array_sort(terms), " ").alias("terms"),
    )


@query(
    "r3b_router_terms",
    sx.with_index(DATABASE_SOURCE, _terms_sql(left=True))
    + " select d_id, count(*) as n, string_agg(term, ' ' order by term) as terms from terms_ group by d_id",
)
def router_terms(spark, sf_dir):
    terms = retrieval.schema_terms_left(F.col("text"))
    return (
        schema_index(spark, sf_dir)
        .database_documents()
        .select(
            "d_id", F.size(terms).cast("bigint").alias("n"), F.array_join(F.array_sort(terms), " ").alias("terms")
        )
    )


@query(
    "r4_sample_phrases",
    sx.with_index(TABLE_SOURCE, PHRASES_SQL)
    + " select d_id, phrase, count(*) as n from phrases_ group by d_id, phrase",
)
def phrases(spark, sf_dir):
    return (
        schema_index(spark, sf_dir)
        .documents.select(F.col("id").alias("d_id"), F.explode(sample_phrases(F.col("text"))).alias("phrase"))
        .groupBy("d_id", "phrase")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "r4b_sample_terms",
    sx.with_index(TABLE_SOURCE, PHRASES_SQL)
    + f""", t as (select distinct d_id, unnest({tokens_sql("phrase", WIDE)}) as term from phrases_)
      select d_id, string_agg(term, ' ' order by term) as terms from t group by d_id""",
)
def sample_terms(spark, sf_dir):
    terms = F.array_join(F.array_sort(retrieval.sample_terms(F.col("text"))), " ")
    return (
        schema_index(spark, sf_dir)
        .documents.select(F.col("id").alias("d_id"), terms.alias("terms"))
        .filter("terms <> ''")
    )


@query(
    "r5_phrase_hits",
    sx.with_index(QUESTIONS_SQL, TABLE_SOURCE, PHRASES_SQL)
    + """ select q_id, d_id, phrase, cast(count(*) as int) as n from phrases_ join questions q
      on contains(lower(q.text), phrase) where length(phrase) >= 3 group by all""",
)
def phrase_hits(spark, sf_dir):
    docs = schema_index(spark, sf_dir).documents.select(F.col("id").alias("d_id"), "text")
    return retrieval.phrase_hits(questions(spark, sf_dir), docs)


HYBRID_SQL = f"""
qt_ as (select q_id, lower(text) as text, {tokens_sql("text", WIDE)} as words from questions),
dt_ as (select d_id, list(distinct term) as terms from terms_ group by d_id),
vt_ as (select d_id, list_distinct(flatten(list({tokens_sql("phrase", WIDE)}))) as words from phrases_ group by d_id),
ph_ as (select q_id, d_id, 20 * count(*) as n from phrases_ join qt_ on contains(qt_.text, phrase)
        where length(phrase) >= 3 group by all),
hybrid_ as (
  select q_id, d_id, len(list_intersect(qt_.words, dt_.terms)) as terms,
    coalesce(len(list_intersect(qt_.words, vt_.words)), 0) as "values", cast(coalesce(n, 0) as bigint) as phrases,
    cast(contains(lower(source_.text), 'foreign keys:') and len(qt_.words) >= 2 as bigint) as linked
  from qt_ cross join source_ left join dt_ using (d_id) left join vt_ using (d_id) left join ph_ using (q_id, d_id))"""


@query(
    "r6_hybrid_scores",
    sx.with_index(QUESTIONS_SQL, TABLE_SOURCE, _terms_sql(left=False), PHRASES_SQL, HYBRID_SQL)
    + """ select *, terms + 3 * "values" + phrases + linked as score from hybrid_
      where terms + "values" + phrases > 0""",
)
def hybrid_scores(spark, sf_dir):
    docs = schema_index(spark, sf_dir).documents.select(F.col("id").alias("d_id"), "text")
    return retrieval.hybrid_scores(questions(spark, sf_dir), docs)


@query(
    "r6b_hybrid_top_tables",
    sx.with_index(QUESTIONS_SQL, TABLE_SOURCE, _terms_sql(left=False), PHRASES_SQL, HYBRID_SQL)
    + """ select q_id, d_id, score, cast(rank as int) as rank from (
        select q_id, d_id, cast(score as bigint) as score, row_number() over (partition by q_id order by score desc, d_id) as rank
        from (select *, terms + 3 * "values" + phrases + linked as score from hybrid_ where terms + "values" + phrases > 0))
      where rank <= 5""",
)
def hybrid_top_tables(spark, sf_dir):
    docs = schema_index(spark, sf_dir).documents.select(F.col("id").alias("d_id"), "text")
    return retrieval.hybrid_top_k(questions(spark, sf_dir), docs, 5)


RELATION_SQL = "['" + "', '".join(retrieval.RELATION_WORDS) + "']"
ROUTER_SQL = f"""
qt_ as (select q_id, lower(text) as text, {tokens_sql("text", WIDE)} as words from questions),
dt_ as (select d_id, list(distinct term) as terms from terms_ group by d_id),
vt_ as (select d_id, phrase, {tokens_sql("phrase", WIDE)} as words from phrases_),
vs_ as (
  select q_id, d_id, sum(len(list_intersect(qt_.words, vt_.words))
    + case when length(phrase) < 4 or not contains(qt_.text, phrase) then 0
           when len(list_filter(regexp_split_to_array(phrase, '\\s+'), lambda x: x <> '')) >= 2 then 15 else 2 end) as n
  from qt_ cross join vt_ group by q_id, d_id),
tabs_ as (select distinct d_id, lower(trim(line[7:])) as tab from
          (select d_id, trim(unnest(string_split(text, chr(10)))) as line from source_) where line like 'TABLE:%'),
rel_ as (
  select q_id, d_id, least(count(*), 3) as n from qt_ join tabs_ on list_has_any(qt_.words, {tokens_sql("tab", WIDE)})
  where list_has_any(qt_.words, {RELATION_SQL}) group by q_id, d_id),
router_ as (
  select q_id, d_id, len(list_intersect(qt_.words, dt_.terms)) as terms, cast(coalesce(vs_.n, 0) as bigint) as "values",
    coalesce(rel_.n, 0) as relations
  from qt_ cross join dt_ left join vs_ using (q_id, d_id) left join rel_ using (q_id, d_id))"""


@query(
    "r7_router_scores",
    sx.with_index(QUESTIONS_SQL, DATABASE_SOURCE, _terms_sql(left=True), PHRASES_SQL, ROUTER_SQL)
    + """ select *, terms + "values" + relations as score from router_ where terms + "values" + relations > 0""",
)
def router_scores(spark, sf_dir):
    docs = schema_index(spark, sf_dir).database_documents()
    return retrieval.router_scores(questions(spark, sf_dir), docs)


TABLE_SCORES_SQL = f"""
dv_ as (
  select id, lower(trim(regexp_replace(line, '^[^:]*:', ''))) as value from
    (select id, unnest(string_split(text, chr(10))) as line from docs_)
  where line like '%:%' and trim(split_part(line, ':', 1)) like '-%'),
qd_ as (
  select q_id, database, tab, id, lower(q.text) as q_text, {ascii_sql("q.text")} as q_words,
    {ascii_sql("tab")} as name_words, {ascii_sql("d.text")} as words
  from questions q join docs_ d using (database)),
vp_ as (
  select q_id, id, sum(case when len(list_filter(regexp_split_to_array(value, '\\s+'), lambda x: x <> '')) >= 2
                       then 20 else 3 end) as n
  from qd_ join dv_ using (id) where length(value) >= 3 and contains(q_text, value) group by q_id, id),
scored_ as (
  select q_id, database, tab, cast(15 * len(list_intersect(q_words, name_words))
    + len(list_intersect(q_words, words)) + coalesce(n, 0) BOOSTS as bigint) as score
  from qd_ left join vp_ using (q_id, id))"""
BOOSTS_SQL = """
    + case when contains(q_text, 'student') and contains(lower(tab), 'student') then 15 else 0 end
    + case when (contains(q_text, 'activity') or contains(q_text, 'activities')) and contains(lower(tab), 'activity')
           then 15 else 0 end
    + case when (contains(q_text, 'participat') or contains(q_text, 'join')) and contains(lower(tab), 'participat')
           then 15 else 0 end"""
USER_SCORES_SQL = TABLE_SCORES_SQL.replace("BOOSTS", "")


def _scored(spark, sf_dir):
    return retrieval.table_scores(questions(spark, sf_dir), schema_index(spark, sf_dir).documents)


@query(
    "r8_table_scores",
    sx.with_index(QUESTIONS_SQL, USER_SCORES_SQL) + ' select q_id, database, tab as "table", score from scored_',
)
def table_scores(spark, sf_dir):
    return _scored(spark, sf_dir)


# The same tables under names that the fixed boosts know.
RENAMED = {"customers": "student", "orders": "student_activity", "lineitems": "participates_in", "labels": "activity"}


@query(
    "r8b_boosted_table_scores",
    sx.with_index(
        QUESTIONS_SQL.replace("as text\n", "|| ' join of activities' as text\n"),
        "renamed_(tab, new_tab) as (values " + ", ".join(f"('{a}', '{b}')" for a, b in RENAMED.items()) + ")",
        TABLE_SCORES_SQL.replace("BOOSTS", BOOSTS_SQL).replace(
            "docs_ d using (database)",
            "(select id, database, coalesce(new_tab, tab) as tab, text from docs_ left join renamed_ using (tab)) d "
            "using (database)",
        ),
    )
    + ' select q_id, database, tab as "table", score from scored_',
)
def boosted_table_scores(spark, sf_dir):
    renamed = F.col("table")
    for old, new in RENAMED.items():
        renamed = F.when(F.col("table") == old, new).otherwise(renamed)
    docs = schema_index(spark, sf_dir).documents.withColumn("table", renamed).withColumn("kind", F.lit("built_in"))
    asked = questions(spark, sf_dir).withColumn("text", F.concat("text", F.lit(" join of activities")))
    return retrieval.table_scores(asked, docs)


BOOST_WORDS_SQL = " ".join(
    f"+ case when contains(q_text, '{w}') and contains(d_text, '{w}') then 2 else 0 end"
    for w in retrieval.DATABASE_BOOST_WORDS
)
DATABASE_SCORES_SQL = rf"""
qr_ as (select q_id, lower(text) as q_text, {ascii_sql("text")} as words,
        list_filter(list_transform(regexp_extract_all(lower(text), '[a-z]+(?:\s+[a-z]+)+'), lambda x: trim(x)),
                    lambda x: length(x) >= 5) as runs from questions),
dd_ as (select d_id, lower(text) as d_text, {ascii_sql("text")} as words from dbdocs_),
dscores_ as (
  select q_id, d_id, cast(len(list_intersect(qr_.words, dd_.words))
    + 15 * len(list_filter(runs, lambda x: contains(d_text, x))) {BOOST_WORDS_SQL} as bigint) as score
  from qr_ cross join dd_)"""


def _database_scores(spark, sf_dir):
    docs = schema_index(spark, sf_dir).database_documents()
    return retrieval.database_scores(questions(spark, sf_dir), docs)


@query(
    "r9_database_scores",
    sx.with_index(QUESTIONS_SQL, DATABASE_SCORES_SQL) + " select q_id, d_id, score from dscores_ where score > 0",
)
def database_scores(spark, sf_dir):
    return _database_scores(spark, sf_dir)


VECTOR_SQL = """
q_ as (select item_id as q_id, b.text, embedding, label from benchmark b join embeddings on item_id = vec_id),
dist_ as (
  select q_id, vec_id as d_id, q_.label = e.label as same,
    list_sum(list_transform(list_zip(q_.embedding, e.embedding),
      lambda x: (x[1]::double - x[2]::double) * (x[1]::double - x[2]::double))) as distance
  from q_ cross join embeddings e)"""


def nearest_sql(k: int, where: str = "true") -> str:
    return f"""
near_ as (
  select * from (select q_id, d_id, distance, row_number() over (partition by q_id order by distance, d_id) as rank
                 from dist_ where {where}) where rank <= {k})"""


def _rounded(found):
    return found.withColumn("distance", F.round("distance", 6))


NEAREST = 10


@query(
    "r10_vector_top_k",
    f"with {VECTOR_SQL},{nearest_sql(NEAREST)} select q_id, d_id, round(distance, 6) as distance, cast(rank as int) as rank from near_",
)
def vector_top_k(spark, sf_dir):
    return _rounded(retrieval.vector_top_k(question_vectors(spark, sf_dir), document_vectors(spark, sf_dir), NEAREST))


@query(
    "r10b_vector_top_k_in_group",
    f"""with {VECTOR_SQL},{nearest_sql(5, "same")} select q_id, d_id, round(distance, 6) as distance,
      cast(rank as int) as rank from near_""",
)
def vector_top_k_in_group(spark, sf_dir):
    return _rounded(
        retrieval.vector_top_k(
            question_vectors(spark, sf_dir), document_vectors(spark, sf_dir), 5, same_group=True
        )
    )


@query(
    "r10c_vector_top_k_per_label",
    """with c as (select label as q_id, pos, avg(x::double) as x from
        (select label, unnest(embedding) as x, generate_subscripts(embedding, 1) as pos from embeddings) group by 1, 2),
      v as (select vec_id as d_id, label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as pos from embeddings),
      s as (select q_id, d_id, sum((c.x - v.x) * (c.x - v.x)) as distance from c join v using (pos) group by 1, 2),
      r as (select *, row_number() over (partition by q_id order by distance, d_id) as rank from s)
      select q_id::bigint as q_id, d_id, round(distance, 6) as distance, cast(rank as int) as rank from r where rank <= 20""",
)
def vector_top_k_per_label(spark, sf_dir):
    """Centre of each label against all vectors; the centre is an average per position."""
    vectors = load(spark, sf_dir, "embeddings")
    centres = (
        vectors.select("label", F.posexplode("embedding").alias("pos", "x"))
        .groupBy("label", "pos")
        .agg(F.avg(F.col("x").cast("double")).alias("x"))
        .groupBy(F.col("label").cast("bigint").alias("q_id"))
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("vector"))
    )
    return _rounded(retrieval.vector_top_k(centres, document_vectors(spark, sf_dir), 20))


CANDIDATES = 50
CANDIDATE_SQL = f"""
cand_ as (
  select near_.q_id, near_.d_id, rank, source,
    cast(coalesce(len(list_intersect({tokens_sql("q_.text", NARROW)}, {tokens_sql("d.text", NARROW)})), 0) as bigint) as score
  from near_ join q_ using (q_id) left join documents d on d.doc_id = near_.d_id)"""


def _candidates(spark, sf_dir):
    """Vector candidates with their lexical score, cut on the candidate pairs only; 0 for a vector without document."""
    asked = question_vectors(spark, sf_dir)
    near = retrieval.vector_top_k(asked, document_vectors(spark, sf_dir), CANDIDATES)
    docs = load(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("d_id"), "source", words_narrow(F.col("text")).alias("d_words")
    )
    words = asked.select("q_id", words_narrow(F.col("text")).alias("q_words"))
    return (
        near.join(docs, "d_id", "left")
        .join(words, "q_id")
        .withColumn("shared", F.coalesce(F.array_intersect("q_words", "d_words"), F.array().cast("array<string>")))
        .select("q_id", "d_id", "rank", "source", F.size("shared").cast("bigint").alias("score"))
    )


@query(
    "r11_two_stage",
    f"""with {VECTOR_SQL},{nearest_sql(CANDIDATES)},{CANDIDATE_SQL} select q_id, d_id, cast(rank as int) as rank, score,
      cast(row_number() over (partition by q_id order by score desc, rank) as int) as position from cand_""",
)
def two_stage(spark, sf_dir):
    return retrieval.rerank(_candidates(spark, sf_dir)).select("q_id", "d_id", "rank", "score", "position")


@query(
    "r12_rank_bonus",
    f"""with {VECTOR_SQL},{nearest_sql(CANDIDATES)},{CANDIDATE_SQL},
      s as (select q_id, source, max(score) as score from cand_ where source is not null group by 1, 2),
      sized as (select q_id, least(count(*), 6) as size from s group by 1),
      hit as (select q_id, source, min(rank) as hit from cand_ join sized using (q_id) where rank <= size group by 1, 2)
      select q_id, source as "table", cast(coalesce([12, 9, 7, 5, 3, 2][hit], 0) as bigint) as bonus,
        score + coalesce([12, 9, 7, 5, 3, 2][hit], 0) as score from s left join hit using (q_id, source)""",
)
def rank_bonus(spark, sf_dir):
    found = materialise(_candidates(spark, sf_dir).filter("source is not null"))
    scored = found.groupBy("q_id", F.col("source").alias("table")).agg(F.max("score").alias("score"))
    hits = found.select("q_id", F.col("source").alias("table"), "rank")
    return retrieval.rank_bonus(scored, hits).select("q_id", "table", "bonus", "score")


ROUTE_SQL = f"""
ranked_ as (select q_id, d_id, score, row_number() over (partition by q_id order by score desc, lower(d_id)) as rn
            from dscores_),
routes_ as (
  select q_id, max(score) filter (rn = 1) as best_score, coalesce(max(score) filter (rn = 2), 0) as second_score,
    max(d_id) filter (rn = 1) as best, string_agg(d_id, ', ' order by rn) filter (rn <= 5) as candidates
  from ranked_ group by q_id)"""


def _routes(spark, sf_dir):
    scores = _database_scores(spark, sf_dir).withColumnRenamed("d_id", "database")
    return routing.route(questions(spark, sf_dir), scores, schema_index(spark, sf_dir).documents.select("database"))


@query(
    "r13_route",
    sx.with_index(QUESTIONS_SQL, DATABASE_SCORES_SQL, ROUTE_SQL)
    + """ select q_id, case when best_score > 0 and best_score > second_score then best else '' end as database,
      candidates, best_score, second_score, case when best_score > 0 and best_score > second_score then '' else
      'Which database should I query? Available likely matches are: ' || candidates || '.' end as question_back
      from routes_""",
)
def route(spark, sf_dir):
    return _routes(spark, sf_dir).withColumn("candidates", F.array_join("candidates", ", "))


SELECTED_SQL = """
pick_ as (
  select *, row_number() over (partition by q_id order by score desc, tab) as rank,
    max(score) over (partition by q_id) > 0 as any_positive from scored_),
selected_ as (
  select q_id, database, tab, score, cast(rank as int) as rank from pick_
  where case when any_positive then score > 0 and rank <= 5 else rank <= 3 end)"""


def _chosen(spark, sf_dir, pairs=()):
    """One row per question: scored, selected and connecting tables."""
    index = schema_index(spark, sf_dir)
    ranked = retrieval.table_rankings(questions(spark, sf_dir), index.documents)
    return routing.add_bridges(routing.select_tables(ranked), index.links, list(pairs))


@query(
    "r14_select_tables",
    sx.with_index(QUESTIONS_SQL, USER_SCORES_SQL, SELECTED_SQL)
    + ' select q_id, database, tab as "table", score, rank from selected_',
)
def select_tables(spark, sf_dir):
    ranked = retrieval.table_rankings(questions(spark, sf_dir), schema_index(spark, sf_dir).documents)
    return routing.select_tables(ranked).select("q_id", "database", F.inline_outer("selected"))


@query(
    "r15_link_graph",
    sx.with_index()
    + """ select database, lower(tab) as "table", string_agg(distinct lower(ref_tab), ',' order by lower(ref_tab)) as refs
      from links_ group by 1, 2""",
)
def link_graph(spark, sf_dir):
    graph = routing.link_graph(schema_index(spark, sf_dir).links)
    return graph.withColumn("refs", F.array_join("refs", ","))


BRIDGES_SQL = """
bridges_ as (
  select s.q_id, s.database, l.tab from selected_ s join (select distinct database, tab, ref_tab from links_) l
    on s.database = l.database and s.tab = l.ref_tab
  where s.score >= 2 and not exists (select 1 from selected_ x where x.q_id = s.q_id and x.tab = l.tab)
  group by 1, 2, 3 having count(distinct l.ref_tab) >= 2)"""


@query(
    "r16_bridge_tables",
    sx.with_index(QUESTIONS_SQL, USER_SCORES_SQL, SELECTED_SQL, BRIDGES_SQL)
    + ' select q_id, database, tab as "table" from bridges_',
)
def bridge_tables(spark, sf_dir):
    found = _chosen(spark, sf_dir).select("q_id", "database", F.explode_outer("bridges").alias("table"))
    return found.filter("table is not null")


FORCED = [("customers", "nations"), ("parts", "suppliers")]


@query(
    "r17_forced_bridges",
    sx.with_index(QUESTIONS_SQL, USER_SCORES_SQL, SELECTED_SQL)
    + " union ".join(
        f""" select distinct a.q_id, a.database, l1.tab as "table" from selected_ a join selected_ b using (q_id)
          join links_ l1 on l1.database = a.database and l1.ref_tab = a.tab
          join links_ l2 on l2.database = a.database and l2.ref_tab = b.tab and l2.tab = l1.tab
          where a.tab = '{x}' and b.tab = '{y}'
            and not exists (select 1 from selected_ s where s.q_id = a.q_id and s.tab = l1.tab)"""
        for x, y in FORCED
    ),
)
def forced_bridges(spark, sf_dir):
    found = _chosen(spark, sf_dir, FORCED).select("q_id", "database", F.explode_outer("forced").alias("table"))
    return found.filter("table is not null")


@query(
    "r18_assemble_context",
    sx.with_index(QUESTIONS_SQL, USER_SCORES_SQL, SELECTED_SQL, BRIDGES_SQL)
    + """, parts as (select q_id, database, tab, rank from selected_ union all select q_id, database, tab, 1000 from bridges_),
      ctx as (select q_id, string_agg(text, chr(10) || chr(10) order by rank, tab) as context,
        string_agg(tab, ',' order by rank, tab) as tables from parts join docs_ using (database, tab) group by q_id)
      select q_id, md5(context) as digest, tables, cast(length(context) as int) as chars from ctx""",
)
def assemble_context(spark, sf_dir):
    context = routing.assemble_context(_chosen(spark, sf_dir), schema_index(spark, sf_dir).documents)
    return context.select(
        "q_id", F.md5("context").alias("digest"), F.array_join("tables", ",").alias("tables"), "chars"
    )


@query(
    "r19_table_names",
    """with lines as (select page_id, unnest(string_split(replace(html, '<', chr(10) || 'TABLE: '), chr(10))) as line,
        generate_subscripts(string_split(replace(html, '<', chr(10) || 'TABLE: '), chr(10)), 1) as n from pages),
      names as (select page_id, trim(replace(line, 'TABLE:', '')) as name, min(n) as n from lines
        where trim(line) like 'TABLE:%' group by 1, 2)
      select page_id, count(*) as n, md5(string_agg(name, '|' order by n)) as names from names where name <> '' group by page_id""",
)
def table_names(spark, sf_dir):
    marked = F.replace("html", F.lit("<"), F.lit("\nTABLE: "))
    names = retrieval.table_names(marked)
    return load(spark, sf_dir, "pages").select(
        "page_id", F.size(names).cast("bigint").alias("n"), F.md5(F.array_join(names, "|")).alias("names")
    )


@query(
    "r19b_table_name",
    r"""select doc_id, coalesce(case when lang = 'en' then nullif(source, '') end,
        nullif(regexp_extract(t, '(?i)TABLE\s*:\s*([A-Za-z0-9_]+)', 1), ''),
        regexp_extract(t, '(?i)table\s*=\s*([A-Za-z0-9_]+)', 1)) as name
      from (select *, case lang when 'de' then 'Table : ' else 'table= ' end || text as t from documents)""",
)
def table_name(spark, sf_dir):
    text = F.concat(F.when(F.col("lang") == "de", "Table : ").otherwise("table= "), "text")
    known = F.when(F.col("lang") == "en", F.col("source"))
    return load(spark, sf_dir, "documents").select("doc_id", retrieval.table_name(known, text).alias("name"))


@query(
    "r20_router_benchmark",
    sx.with_index(QUESTIONS_SQL, DATABASE_SCORES_SQL, ROUTE_SQL)
    + """, first as (select database, min(q_id) as q_id from questions group by 1 order by 2 limit 5)
      select count(*) as total, count(*) filter (hit) as correct, round(count(*) filter (hit) * 100.0 / count(*), 2) as accuracy
      from (select lower(f.database) = lower(case when best_score > 0 and best_score > second_score then best else '' end)
              as hit from first f left join routes_ using (q_id))""",
)
def router_benchmark(spark, sf_dir):
    return routing.router_benchmark(questions(spark, sf_dir), _routes(spark, sf_dir))


NO_CONTEXT_SQL = "'DATABASE: ' || q.database || chr(10) || 'No schema context retrieved.'"


@query(
    "e11_lookup_context",
    f"""with {VECTOR_SQL},{nearest_sql(5, "same")},
      q as (select q_id, cast(label as varchar) as database, case when q_id % 3 = 0 then 'd' || q_id || '|d' || (q_id + 1)
          when q_id % 3 = 1 then '' else 'missing' end as names from q_),
      docs as (select cast(label as varchar) || '::d' || doc_id as id, doc_id, text from documents join embeddings on doc_id = vec_id),
      named as (select q_id, database || '::' || trim(unnest(string_split(names, '|'))) as id,
          generate_subscripts(string_split(names, '|'), 1) as pos from q),
      got as (select q_id, string_agg(md5(text), ',' order by pos) as texts from named join docs using (id) where text <> '' group by 1),
      vec as (select q_id, string_agg(md5(text), ',' order by rank) as texts from near_ join docs on doc_id = d_id where text <> '' group by 1)
      select q_id, case when got.texts is not null then 'recorded' when vec.texts is not null then 'vector' else 'none' end as source,
        coalesce(got.texts, vec.texts, md5({NO_CONTEXT_SQL})) as contexts
      from q left join got using (q_id) left join vec using (q_id)""",
)
def lookup_context(spark, sf_dir):
    asked, vectors = question_vectors(spark, sf_dir), document_vectors(spark, sf_dir)
    near = retrieval.vector_top_k(asked, vectors, 5, same_group=True)
    database = F.col("grp").cast("string")
    docs = load(spark, sf_dir, "documents").join(vectors, F.col("doc_id") == F.col("d_id"))
    docs = docs.select(F.concat(database, F.lit("::d"), "doc_id").alias("id"), "d_id", "text")
    third = F.pmod("q_id", F.lit(3))
    recorded = (
        F.when(third == 0, F.concat(F.lit("d"), "q_id", F.lit("|d"), F.col("q_id") + 1))
        .when(third == 1, "")
        .otherwise("missing")
    )
    q = asked.select("q_id", database.alias("database"), evaluation.table_list(recorded).alias("tables"))
    hits = near.join(docs.select("id", "d_id"), "d_id").select("q_id", "id", "rank")
    found = evaluation.lookup_context(q, docs, hits)
    return found.withColumn("contexts", F.array_join(F.transform("contexts", F.md5), ","))
