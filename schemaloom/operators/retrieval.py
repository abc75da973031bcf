"""Scores of documents for questions, and exact top-k over large collections.

Two shapes of work occur:

* many questions against the documents of a catalogue (bounded): features of the
  documents are joined by key, never question by document;
* questions against a large collection (documents or vectors): both sides are cut into blocks, a
  task takes a pair of them, and at most ``k`` rows per question leave it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from schemaloom.functions.text import strip, word_count, words_ascii, words_wide
from schemaloom.operators import tally
from schemaloom.operators.catalogue import union_all
from schemaloom.operators.documents import sample_phrases
from schemaloom.operators.impact import top_scores
from schemaloom.operators.nearest import vector_top_k  # noqa: F401
from schemaloom.runtime import BROADCAST_ROWS, broadcast_if_small, materialise

# Words of a question about related tables.
RELATION_WORDS = ["participate", "participating", "belong", "taken", "enrolled", "related", "between", "each"]

# Any of the first in the question and the second in the table name add points.
TABLE_BOOSTS = [
    (["student"], "student", 15),
    (["activity", "activities"], "activity", 15),
    (["participat", "join"], "participat", 15),
]

# Words that add points when question and document both contain them.
DATABASE_BOOST_WORDS = ["student", "course", "faculty", "school", "player", "activity"]
DATABASE_BOOST = 2
# Points for a letter run of the question that a document contains.
RUN_POINTS = 15

# Bonus by rank of the vector hit.
RANK_BONUS = [12, 9, 7, 5, 3, 2]


# --- terms of schema documents -------------------------------------------------------


def _document_lines(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), strip)


def schema_terms(text: Column) -> Column:
    """Words of table names, of the first word on each ``-`` line, and around ``->``."""

    def terms(line: Column) -> Column:
        dashed = F.split(strip(F.substr(line, F.lit(2))), r"\s+").getItem(0)
        return (
            F.when(line.startswith("TABLE:"), words_wide(F.replace(line, F.lit("TABLE:"), F.lit(""))))
            .when(line.startswith("-"), words_wide(dashed))
            .when(line.contains("->"), words_wide(F.replace(line, F.lit("->"), F.lit(" "))))
            .otherwise(F.array().cast("array<string>"))
        )

    return F.array_distinct(F.flatten(F.transform(_document_lines(text), terms)))


def schema_terms_left(text: Column) -> Column:
    """Router form: words left of the first ``:`` on each ``-`` line, and of table names."""

    def terms(line: Column) -> Column:
        left = F.replace(F.split_part(line, F.lit(":"), F.lit(1)), F.lit("-"), F.lit(""))
        return (
            F.when(line.startswith("TABLE:"), words_wide(F.replace(line, F.lit("TABLE:"), F.lit(""))))
            .when(line.startswith("-"), words_wide(left))
            .otherwise(F.array().cast("array<string>"))
        )

    return F.array_distinct(F.flatten(F.transform(_document_lines(text), terms)))


def sample_terms(text: Column) -> Column:
    return words_wide(F.array_join(sample_phrases(text), " "))


def table_names(text: Column) -> Column:
    """Tables named on ``TABLE:`` lines, distinct, in order of appearance."""
    lines = F.filter(_document_lines(text), lambda x: x.startswith("TABLE:"))
    names = F.transform(lines, lambda x: strip(F.replace(x, F.lit("TABLE:"), F.lit(""))))
    return F.array_distinct(F.filter(names, lambda n: n != ""))


def table_name(metadata_name: Column, text: Column) -> Column:
    """Name from the metadata, else from the document text, else ``''``."""
    by_line = F.regexp_extract(text, r"(?i)TABLE\s*:\s*([A-Za-z0-9_]+)", 1)
    by_pair = F.regexp_extract(text, r"(?i)table\s*=\s*([A-Za-z0-9_]+)", 1)
    return F.coalesce(F.nullif(metadata_name, F.lit("")), F.nullif(by_line, F.lit("")), by_pair)


# --- feature join --------------------------------------------------------------------

# Keys are a word or a phrase behind a mark; run starts of three characters have none. Marked keys are
# longer than three characters, so that they never meet those.
TOKEN_MARK, PHRASE_MARK, BOOST_MARK = "tok:", "phr:", "key:"


def _lowered(questions: DataFrame, **facts: Column) -> DataFrame:
    """(q_id, q_text, facts...): lower-case questions, partitioned by id once.

    The aggregate per (question, document) and every later ranking per question reuse
    that partitioning. The text is lowered before the exchange, so once per question.
    """
    extra = [fact.alias(name) for name, fact in facts.items()]
    return questions.select("q_id", F.lower("text").alias("q_text"), *extra).repartition("q_id")


def _grams(text: Column) -> Column:
    """Distinct three-character pieces of a text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(?=(.{3}))"), F.lit(1)))


def _marked(words: Column, mark: str) -> Column:
    return F.transform(words, lambda w: F.concat(F.lit(mark), w))


#: Starts of phrases up to which a pattern names them.
STARTS = 2_000


def _one_of(starts: list[str]) -> str:
    """A pattern for any of some texts of three characters, by their first, second and third one."""
    code = {s: [rf"\x{{{ord(c):x}}}" for c in s] for s in starts}
    by_two: dict[str, dict[str, list[str]]] = {}
    for a, b, c in code.values():
        by_two.setdefault(a, {}).setdefault(b, []).append(c)
    return "(?:" + "|".join(
        a + "(?:" + "|".join(b + "[" + "".join(ends) + "]" for b, ends in rest.items()) + ")" for a, rest in by_two.items()
    ) + ")"


def contained_phrases(questions: DataFrame, phrases: DataFrame) -> DataFrame:
    """(q_id, phrase): the distinct phrases of at least three characters that lie in a question's lower-case text.

    ``questions`` has (q_id, q_text), ``phrases`` (phrase). From every place of a question a window as long as the longest
    phrase is cut; windows and phrases meet by their first three characters. So a text stands on one row,
    and a question costs its length times that of a phrase.
    """
    known = materialise(phrases.select("phrase").filter(F.length("phrase") >= 3).distinct())
    longest = known.agg(F.max(F.length("phrase"))).first()[0] or 3
    known = known.withColumn("start", F.substring("phrase", 1, 3))
    starts = [r[0] for r in known.select("start").distinct().limit(STARTS + 1).collect()]
    head = _one_of(starts) if 0 < len(starts) <= STARTS else ".{3}"
    windows = F.array_distinct(F.regexp_extract_all("q_text", F.lit(f"(?s)(?=({head}.{{0,{longest - 3}}}))"), F.lit(1)))
    cut = questions.select("q_id", F.explode(windows).alias("window")).withColumn("start", F.substring("window", 1, 3))
    met = cut.join(broadcast_if_small(known), "start").filter(F.col("window").startswith(F.col("phrase")))
    return met.select("q_id", "phrase").distinct()


def _question_keys(
    questions: DataFrame, tokens: Callable[[Column], Column] | None, phrases: DataFrame | None = None, **facts: Column
) -> DataFrame:
    """(q_id, facts..., key): one row per distinct token and per contained phrase of a question."""
    lowered = _lowered(questions, **facts)
    parts = []
    if tokens is not None:
        parts.append(lowered.select("q_id", *facts, F.explode(_marked(tokens(F.col("q_text")), TOKEN_MARK)).alias("key")))
    if phrases is not None:
        inside = contained_phrases(lowered, phrases).withColumn("key", F.concat(F.lit(PHRASE_MARK), "phrase"))
        if facts:
            inside = inside.join(lowered.select("q_id", *facts), "q_id")
        parts.append(inside.select("q_id", *facts, "key"))
    return union_all(parts)


def _token_features(documents: DataFrame, tokens: Column, **points: int) -> DataFrame:
    return documents.select("d_id", F.explode(tokens).alias("key"), *[F.lit(v).alias(n) for n, v in points.items()])


def _features(parts: list[DataFrame], names: list[str]) -> DataFrame:
    kinds = {f.name: f.dataType for part in parts for f in part.schema if f.name in names}
    shaped = []
    for part in parts:
        is_phrase = "phrase" in part.columns
        shaped.append(
            part.select(
                "d_id",
                F.concat(F.lit(PHRASE_MARK if is_phrase else TOKEN_MARK), "phrase" if is_phrase else "key").alias("key"),
                *[F.col(n) if n in part.columns else F.lit(None).cast(kinds[n]).alias(n) for n in names],
            )
        )
    return union_all(shaped)


def match_features(keys: DataFrame, features: DataFrame) -> DataFrame:
    """Feature rows whose key a question has."""
    return keys.join(broadcast_if_small(features), "key")


def overlap_scores(questions: DataFrame, documents: DataFrame, tokens: Callable[[Column], Column]) -> DataFrame:
    """(q_id, d_id, score): number of shared distinct tokens, for pairs that share one."""
    keys = _question_keys(questions, tokens)
    features = _features([_token_features(documents, tokens(F.col("text")), hits=1)], ["hits"])
    return (
        match_features(keys, features).groupBy("q_id", "d_id").agg(F.sum("hits").cast("bigint").alias("score"))
    )


def phrase_hits(questions: DataFrame, documents: DataFrame, min_chars: int = 3) -> DataFrame:
    """(q_id, d_id, phrase, n): sample values contained in the question."""
    phrases = (
        documents.select("d_id", F.explode(sample_phrases(F.col("text"))).alias("phrase"))
        .filter(F.length("phrase") >= max(min_chars, 3))
        .groupBy("d_id", "phrase")
        .agg(F.count(F.lit(1)).cast("int").alias("n"))
    )
    keys = _question_keys(questions, None, phrases)
    found = match_features(keys, _features([phrases], ["n"]))
    return found.select("q_id", "d_id", F.substr("key", F.lit(len(PHRASE_MARK) + 1)).alias("phrase"), "n")


def hybrid_scores(questions: DataFrame, documents: DataFrame) -> DataFrame:
    """Term overlap + 3 x value overlap + 20 per contained value + 1 for linked tables.

    Rows are the pairs with at least one shared feature; every other pair scores 0, or 1
    when its document has links and the question has two words.
    """
    text = F.col("text")
    phrases = (
        documents.select("d_id", F.explode(sample_phrases(text)).alias("phrase"))
        .filter(F.length("phrase") >= 3)
        .groupBy("d_id", "phrase")
        .agg((F.count(F.lit(1)) * 20).cast("int").alias("phrases"))
    )
    features = _features(
        [
            _token_features(documents, schema_terms(text), terms=1),
            _token_features(documents, sample_terms(text), values=1),
            phrases,
        ],
        ["terms", "values", "phrases"],
    )
    keys = _question_keys(questions, words_wide, phrases, two_words=F.size(words_wide(text)) >= 2)
    total = {n: F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias(n) for n in ("terms", "values", "phrases")}
    linked = broadcast_if_small(documents.select("d_id", F.lower("text").contains("foreign keys:").alias("has_links")))
    bonus = (F.col("has_links") & F.col("two_words")).cast("bigint")
    return (
        match_features(keys, features)
        .groupBy("q_id", "d_id")
        .agg(*total.values(), F.bool_or("two_words").alias("two_words"))
        .join(linked, "d_id")
        .select(
            "q_id",
            "d_id",
            "terms",
            "values",
            "phrases",
            bonus.alias("linked"),
            (F.col("terms") + F.col("values") * 3 + F.col("phrases") + bonus).alias("score"),
        )
    )


def router_scores(questions: DataFrame, documents: DataFrame) -> DataFrame:
    """Database form: term overlap, per-value overlap and containment, related tables."""
    text = F.col("text")
    values = documents.select("d_id", F.explode(sample_phrases(text)).alias("value"))
    value_tokens = (
        values.select("d_id", F.explode(words_wide(F.col("value"))).alias("key"))
        .groupBy("d_id", "key")
        .agg(F.count(F.lit(1)).cast("int").alias("values"))
    )
    points = F.when(word_count(F.col("value")) >= 2, 15).otherwise(2)
    phrases = (
        values.filter(F.length("value") >= 4)
        .groupBy("d_id", F.col("value").alias("phrase"))
        .agg(F.sum(points).cast("int").alias("values"))
    )
    tables = documents.select("d_id", F.explode(table_names(text)).alias("name")).select(
        "d_id",
        F.explode(words_wide(F.col("name"))).alias("key"),
        F.lower("name").alias("table_name"),
    )
    features = _features(
        [_token_features(documents, schema_terms_left(text), terms=1), value_tokens, phrases, tables],
        ["terms", "values", "table_name"],
    )
    related = F.arrays_overlap(words_wide(text), F.array(*[F.lit(w) for w in RELATION_WORDS]))
    keys = _question_keys(questions, words_wide, phrases, related=related)
    total = {n: F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias(n) for n in ("terms", "values")}
    # A database names at most a few hundred tables, so the set per pair stays small.
    table_count = F.least(F.size(F.collect_set("table_name")), F.lit(3)).cast("bigint")
    return (
        match_features(keys, features)
        .groupBy("q_id", "d_id")
        .agg(
            *total.values(),
            F.when(F.bool_or("related"), table_count).otherwise(0).cast("bigint").alias("relations"),
        )
        .select(
            "q_id",
            "d_id",
            "terms",
            "values",
            "relations",
            (F.col("terms") + F.col("values") + F.col("relations")).alias("score"),
        )
    )


def question_phrases(text: Column) -> Column:
    """Maximal runs of two or more words made of letters only, of five characters or more."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"([a-z]++(?:\s++[a-z]++)++)"), F.lit(1))
    return F.filter(F.transform(runs, strip), lambda p: F.length(p) >= 5)


def database_scores(questions: DataFrame, documents: DataFrame) -> DataFrame:
    """Token overlap + 15 per contained letter run + 2 per shared keyword.

    A letter run lies inside a document only where the document holds the run's first
    three characters, so runs meet documents by that piece and are verified afterwards. Few
    short documents are held by every task instead, which scores batches of questions.
    """
    keywords = F.array(*[F.lit(w) for w in DATABASE_BOOST_WORDS])

    def present(text: Column) -> Column:
        return F.filter(keywords, lambda w: text.contains(w))

    few = _few_texts(documents, present)
    if few is not None:
        text = F.col("q_text")
        asked = _lowered(questions.filter("text is not null"))
        asked = asked.select("q_id", "q_text", words_ascii(text).alias("words"), question_phrases(text).alias("runs"))
        points = dict.fromkeys(DATABASE_BOOST_WORDS, DATABASE_BOOST)
        return tally.by_text(asked, few, documents.schema["d_id"].dataType.simpleString(), points, RUN_POINTS)

    def keyed(values: Column, points: int, mark: str = "") -> Column:
        """Values as (key, run, points); without a mark the value is a run, found by its start."""
        return F.transform(
            values,
            lambda v: F.struct(
                (F.concat(F.lit(mark), v) if mark else F.substring(v, 1, 3)).alias("key"),
                (F.lit(None).cast("string") if mark else v).alias("run"),
                F.lit(points).alias("points"),
            ),
        )

    asked_text = F.col("q_text")
    asked = _lowered(questions).select(
        "q_id",
        F.inline_outer(
            F.concat(
                keyed(words_ascii(asked_text), 1, TOKEN_MARK),
                keyed(question_phrases(asked_text), RUN_POINTS),
                keyed(present(asked_text), DATABASE_BOOST, BOOST_MARK),
            )
        ),
    )
    texts = documents.select("d_id", F.lower("text").alias("d_text"))
    text = F.col("d_text")
    held = F.concat(_marked(words_ascii(text), TOKEN_MARK), _marked(present(text), BOOST_MARK), _grams(text))
    offered = texts.select("d_id", F.explode_outer(held).alias("key"))
    return (
        asked.join(broadcast_if_small(offered), "key")
        .join(broadcast_if_small(texts), "d_id")
        .filter(F.col("run").isNull() | F.col("d_text").contains(F.col("run")))
        .groupBy("q_id", "d_id")
        .agg(F.sum("points").cast("bigint").alias("score"))
    )


def _few_texts(documents: DataFrame, present: Callable[[Column], Column]) -> list | None:
    """Rows (d_id, d_text, words, keywords) of documents that are few, short and each named by its own text or whole
    number, else None."""
    if documents.schema["d_id"].dataType.simpleString() not in ("string", "bigint", "int"):
        return None
    texts = documents.select("d_id", F.lower("text").alias("d_text")).filter("d_id is not null and d_text is not null")
    length = F.coalesce(F.sum(F.length("d_text")), F.lit(0))
    count, names, characters = texts.limit(tally.PLACES + 1).agg(F.count(F.lit(1)), F.count_distinct("d_id"), length).first()
    if not 0 < count <= tally.PLACES or names < count or characters > tally.CHARACTERS:
        return None
    text = F.col("d_text")
    return texts.select("d_id", "d_text", words_ascii(text).alias("words"), present(text).alias("keywords")).collect()


ALL_MARK = "all:"


def table_scores(questions: DataFrame, documents: DataFrame) -> DataFrame:
    """(q_id, database, table, score) for every table of the question's database.

    Words of a question look up the tables that hold them; one more key finds every table
    of the database, so that tables without a hit are kept with what they score.
    """
    few, features = _table_features(questions, documents)
    if few is not None:
        return few.select("q_id", "database", F.inline("tables"))
    return _keyed_table_scores(questions, features)


def _table_features(questions: DataFrame, documents: DataFrame) -> tuple[DataFrame | None, DataFrame]:
    """The rankings if every task can hold what the tables offer, and that as rows by key."""
    text = F.col("text")
    right_sides = F.transform(
        F.filter(
            F.split(text, "\n"),
            lambda x: x.contains(":") & strip(F.split_part(x, F.lit(":"), F.lit(1))).startswith("-"),
        ),
        lambda x: F.lower(strip(F.regexp_replace(x, r"(?s)^[^:]*:", ""))),
    )
    values = F.transform(
        F.filter(right_sides, lambda v: F.length(v) >= 3),
        lambda v: F.struct(v.alias("value"), F.when(word_count(v) >= 2, 20).otherwise(3).alias("points")),
    )
    named = documents.filter("table <> ''").withColumn("is_user", F.col("kind") == "user")
    place = ["database", "table", "is_user"]
    no_values_type = "array<struct<value:string,points:int>>"
    no_values = F.lit(None).cast(no_values_type)

    def words(column: Column, points: int) -> DataFrame:
        keys = F.explode(_marked(words_ascii(column), TOKEN_MARK)).alias("key")
        return named.select(*place, keys, F.lit(points).alias("points"), no_values.alias("values"))

    features = union_all(
        [
            words(F.col("table"), 15),
            words(text, 1),
            named.select(*place, F.lit(ALL_MARK).alias("key"), F.lit(0).alias("points"), values.alias("values")),
        ]
    )
    named_for = F.array(*[F.lower("table").contains(name) for _, name, _ in TABLE_BOOSTS])
    rows = features.withColumn("named", named_for).limit(BROADCAST_ROWS + 1)
    length = F.length("key") + F.aggregate(F.coalesce("values", F.array().cast(no_values_type)), F.lit(0), lambda a, v: a + F.length(v["value"]))
    count, characters = rows.agg(F.count(F.lit(1)), F.sum(length)).first()
    if count > BROADCAST_ROWS or (characters or 0) > tally.CHARACTERS:
        return None, features
    lower = F.col("q_text")
    boosted = F.array(*[lower.rlike("|".join(asked)) for asked, _, _ in TABLE_BOOSTS])
    asked = _lowered(questions.filter("text is not null"), database=F.col("database"))
    asked = asked.select("q_id", "database", "q_text", words_ascii(lower).alias("words"), boosted.alias("boosted"))
    points = [points for _, _, points in TABLE_BOOSTS]
    return tally.by_table(asked, rows.collect(), points, ALL_MARK, TOKEN_MARK), features


def _keyed_table_scores(questions: DataFrame, features: DataFrame) -> DataFrame:
    """``table_scores`` by a join of words with ``features``. Questions are partitioned by id first: the sum per table and
    the ranking need no other shuffle."""
    lower = F.col("q_text")
    hits = F.filter("values", lambda v: lower.contains(v["value"]))
    value_points = F.aggregate(hits, F.lit(0), lambda a, v: a + v["points"])
    boosts = sum(
        F.when(lower.rlike("|".join(asked)) & F.lower("table").contains(name), points).otherwise(0)
        for asked, name, points in TABLE_BOOSTS
    )
    # Values and boosts count once per table, on the row of the key that finds every table.
    once = value_points + F.when(F.col("is_user"), 0).otherwise(boosts)
    keys = F.concat(_marked(words_ascii(lower), TOKEN_MARK), F.array(F.lit(ALL_MARK)))
    return (
        _lowered(questions, database=F.col("database"))
        .select("q_id", "database", "q_text", F.explode_outer(keys).alias("key"))
        .join(broadcast_if_small(features), ["database", "key"])
        .withColumn("points", F.when(F.col("values").isNull(), F.col("points")).otherwise(once))
        .groupBy("q_id", "database", "table")
        .agg(F.sum("points").cast("bigint").alias("score"))
    )


def table_rankings(questions: DataFrame, documents: DataFrame) -> DataFrame:
    """(q_id, database, tables): the scores of ``table_scores``, one row per question."""
    few, features = _table_features(questions, documents)
    return few if few is not None else as_rankings(_keyed_table_scores(questions, features))


def as_rankings(scored: DataFrame) -> DataFrame:
    """Scored rows (q_id, database, table, score) as one row per question."""
    tables = F.collect_list(F.struct("table", "score"))
    return scored.groupBy("q_id", "database").agg(tables.alias("tables"))


# --- top-k over large collections ----------------------------------------------------


def _asked(keys: Column, bonus: bool = False) -> Column:
    """Keys as (key, factor, bonus), each with the factor 1."""
    return F.transform(keys, lambda k: F.struct(k.alias("key"), F.lit(1).alias("factor"), F.lit(bonus).alias("bonus")))


def overlap_top_k(questions: DataFrame, documents: DataFrame, k: int, tokens: Callable[[Column], Column], **sizes: int) -> DataFrame:
    """(q_id, d_id, score, rank): the ``k`` documents sharing most distinct tokens, exact."""
    asked = questions.select("q_id", _asked(tokens(F.col("text"))).alias("keys"))
    one = lambda w: F.struct(w.alias("key"), F.lit(1).alias("weight"))
    return top_scores(asked, documents.select("d_id", F.transform(tokens(F.col("text")), one).alias("keys")), k, **sizes)


LINKED = "lnk:"


def hybrid_top_k(questions: DataFrame, documents: DataFrame, k: int, **sizes: int) -> DataFrame:
    """(q_id, d_id, score, rank): the ``k`` documents of the greatest ``hybrid_scores``, exact.

    Words weigh 1 as a schema term and 3 as a word of a sample value, contained values 20 each time they are there, and links
    are a bonus for questions of two words.
    """
    text = F.col("text")
    values = F.filter(sample_phrases(text), lambda p: F.length(p) >= 3)
    words = F.array_union(schema_terms(text), sample_terms(text))
    in_terms, in_values = (F.col(c) for c in ("terms", "values"))
    word = lambda w: F.struct(
        F.concat(F.lit(TOKEN_MARK), w).alias("key"),
        (F.array_contains(in_terms, w).cast("int") + 3 * F.array_contains(in_values, w).cast("int")).alias("weight"),
    )
    phrase = lambda p: F.struct(
        F.concat(F.lit(PHRASE_MARK), p).alias("key"), (20 * F.size(F.filter("phrases", lambda o: o == p))).alias("weight")
    )
    links = F.when(
        F.lower("text").contains("foreign keys:"), F.array(F.struct(F.lit(LINKED).alias("key"), F.lit(1).alias("weight")))
    ).otherwise(F.array().cast("array<struct<key:string,weight:int>>"))
    cut = documents.select(
        "d_id", "text", words.alias("words"), schema_terms(text).alias("terms"), sample_terms(text).alias("values"), values.alias("phrases")
    )
    keys = F.concat(F.transform("words", word), F.transform(F.array_distinct("phrases"), phrase), links)
    cut = materialise(cut.select("d_id", "phrases", keys.alias("keys")))
    lowered = _lowered(questions)
    inside = contained_phrases(lowered, cut.select(F.explode("phrases").alias("phrase")))
    inside = inside.groupBy("q_id").agg(F.collect_list(F.concat(F.lit(PHRASE_MARK), "phrase")).alias("inside"))
    none = F.array().cast("array<string>")
    asked = lowered.withColumn("tokens", words_wide(F.col("q_text"))).join(inside, "q_id", "left")
    plain = F.concat(_marked(F.col("tokens"), TOKEN_MARK), F.coalesce("inside", none))
    bonus = F.when(F.size("tokens") >= 2, F.array(F.lit(LINKED))).otherwise(none)
    asked = asked.select("q_id", F.concat(_asked(plain), _asked(bonus, True)).alias("keys"))
    return top_scores(asked, cut.select("d_id", "keys"), k, **sizes)


def rerank(candidates: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """Second stage: candidates ordered by lexical score, equal scores by vector rank.

    Without ``scores`` the candidates carry their ``score``; the first stage is then read once.
    """
    joined = candidates
    if scores is not None:
        joined = candidates.join(scores.select("q_id", "d_id", "score"), ["q_id", "d_id"], "left")
    order = Window.partitionBy("q_id").orderBy(F.desc("score"), "rank")
    return joined.withColumn("score", F.coalesce("score", F.lit(0))).withColumn(
        "position", F.row_number().over(order)
    )


def rank_bonus(scored: DataFrame, hits: DataFrame) -> DataFrame:
    """Add 12, 9, 7, 5, 3, 2 to the tables found by the first vector hits of a question.

    ``scored`` has (q_id, table, score); ``hits`` has (q_id, table, rank). Only the first
    ``min(6, tables scored)`` hits count, and a table uses its first hit.
    """
    size = scored.groupBy("q_id").agg(F.least(F.count(F.lit(1)), F.lit(len(RANK_BONUS))).alias("size"))
    first = (
        hits.join(size, "q_id")
        .filter(F.col("rank") <= F.col("size"))
        .groupBy("q_id", F.lower("table").alias("name"))
        .agg(F.min("rank").cast("int").alias("hit"))
    )
    bonus = F.coalesce(F.try_element_at(F.array(*[F.lit(b) for b in RANK_BONUS]), F.col("hit")), F.lit(0))
    return (
        scored.withColumn("name", F.lower("table"))
        .join(first, ["q_id", "name"], "left")
        .withColumn("bonus", bonus.cast("bigint"))
        .withColumn("score", F.col("score") + F.col("bonus"))
        .drop("name", "hit")
    )
