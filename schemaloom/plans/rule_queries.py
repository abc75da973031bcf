"""Text rules over typed questions, statement logs, answers and grant lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from schemaloom.functions import rules
from schemaloom.functions.text import clean_sql
from schemaloom.operators import audit
from schemaloom.plans.inputs import (
    STATEMENTS_SQL,
    TABLES,
    TYPED_SQL,
    filled,
    filled_sql,
    literal,
    load,
    statements,
    tables,
    typed_questions,
)
from schemaloom.operators.catalogue import columns_frame
from schemaloom.plans.registered import query

QUESTION_SQL = (
    "case when regexp_replace(text, '^\\s+|\\s+$', '', 'g') = '' then 'invalid_input' "
    "when length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) > 2000 then 'input_too_long' "
    + " ".join(f"when regexp_matches(text, '(?is){p}') then '{c}'" for p, c in rules.QUESTION_PATTERNS)
    + " else 'ok' end"
)


@query("g1_question_rules", f"with {TYPED_SQL} select id, {QUESTION_SQL} as category from typed")
def question_rules(spark, sf_dir):
    return typed_questions(spark, sf_dir).select("id", rules.question_category(F.col("text")).alias("category"))


@query(
    "g1b_question_audit",
    f"with {TYPED_SQL}, c as (select {QUESTION_SQL} as category from typed) select category, count(*) as n from c group by 1",
)
def question_audit(spark, sf_dir):
    return audit.category_counts(question_rules(spark, sf_dir))


PIECES_SQL = """regexp_extract_all(SQL, '''(?:''''|[^''])*''|"(?:""|[^"])*"|`(?:``|[^`])*`|[^''"`]+|[''"`]')"""


def masked_sql(sql: str, names: bool) -> str:
    """One pass over quoted pieces; ``names`` keeps quoted names as plain names."""
    inner = "regexp_replace(p[2:len(p) - 1], '[^A-Za-z0-9_]', '_', 'g')"
    named = f"case when len(p) = 2 then '_' else {inner} end" if names else "'`ID`'"
    return (
        f"array_to_string(list_transform({PIECES_SQL.replace('SQL', sql)}, lambda p: case "
        f"when len(p) > 1 and p[1] = '`' then {named} "
        f"when len(p) > 1 and p[1] in ('''', '\"') then '''VALUE''' else p end), '')"
    )


def open_quote_sql(sql: str) -> str:
    return f"list_has_any({PIECES_SQL.replace('SQL', sql)}, ['''', '\"', '`'])"


@query(
    "g2_masked_statements",
    f"""with {STATEMENTS_SQL} select id, {masked_sql("sql", False)} as keyword_view,
      {masked_sql("sql", True)} as identifier_view, {open_quote_sql("sql")} as open_quote from statements""",
)
def masked_statements(spark, sf_dir):
    sql = F.col("sql")
    return statements(spark, sf_dir).select(
        "id",
        rules.keyword_view(sql).alias("keyword_view"),
        rules.identifier_view(sql).alias("identifier_view"),
        rules.has_open_quote(sql).alias("open_quote"),
    )


WORDS = "|".join(rules.FORBIDDEN_WORDS)


@query(
    "g3_forbidden_words",
    rf"""with {STATEMENTS_SQL} select id, regexp_extract({masked_sql("upper(sql)", False)}, '\b({WORDS})\b', 1) as word
      from statements""",
)
def forbidden_words(spark, sf_dir):
    return statements(spark, sf_dir).select("id", rules.forbidden_word(F.upper(rules.keyword_view(F.col("sql")))).alias("word"))


FUNCTIONS = "|".join(rules.DANGEROUS_FUNCTIONS)


def danger_sql() -> str:
    """Category and reason of the first dangerous construct of ``sql``, as ``category|reason``."""
    constructs = " ".join(
        f"when regexp_matches(upper(kw), '{p}') then 'dangerous_sql|Blocked SQL construct: {t}.'"
        for p, t in rules.DANGEROUS_CONSTRUCTS
    )
    return rf"""case when contains(sql, '\') then 'invalid_sql|Backslashes are not allowed in SQL.'
      when open_quote then 'invalid_sql|SQL contains an unterminated quote.'
      when regexp_matches(upper(kw), '\b({FUNCTIONS})\s*\(') then 'dangerous_sql|The function ' ||
        regexp_extract(upper(kw), '\b({FUNCTIONS})\s*\(', 1) || '() is blocked.'
      {constructs}
      when regexp_matches(upper(idv), '{rules.SYSTEM_SCHEMA_PATTERN}')
        then 'system_database|System database access is blocked.' end"""


VIEWS_SQL = f"""
views as (select id, database, sql, {masked_sql("sql", False)} as kw, {masked_sql("sql", True)} as idv,
          {open_quote_sql("sql")} as open_quote
          from (select id, database, regexp_replace(sql, '^\\s+|\\s+$', '', 'g') as sql from statements))"""


@query(
    "g4_dangerous_constructs",
    f"""with {STATEMENTS_SQL}, {VIEWS_SQL}, v as (select id, {danger_sql()} as v from views)
      select id, split_part(v, '|', 1) as category, v[strpos(v, '|') + 1:] as reason from v where v is not null""",
)
def dangerous_constructs(spark, sf_dir):
    return audit.dangerous_statements(statements(spark, sf_dir)).select("id", "category", "reason")


NAME = "(?:`[^`]+`|[A-Za-z0-9_]+)"
NOT_ALIASES = "['" + "', '".join(rules.NOT_ALIASES) + "']"
USUAL = "['" + "', '".join(rules.USUAL_ALIASES) + "']"
# RE2 has no lookahead: a table is matched together with a following dot, and such
# matches are dropped afterwards.
NAMES_SQL = rf"""
names as (
  select id, database, sql, kw, idv, open_quote,
    list_sort(list_distinct(list_filter(list_transform(
      regexp_extract_all(sql, '(?i)\b(?:FROM|JOIN)\s+{NAME}(?:\s+(?:AS\s+)?({NAME}))?', 1),
      lambda x: lower(replace(x, '`', ''))), lambda x: x <> '' and not list_contains({NOT_ALIASES}, x)))) as aliases,
    list_sort(list_distinct(list_transform(list_filter(
      regexp_extract_all(sql, '(?i)\b(?:FROM|JOIN)\s+((?:`[^`]+`|[A-Za-z0-9_]+\b)(?:\s*\.)?)', 1),
      lambda x: not ends_with(x, '.')), lambda x: lower(replace(x, '`', ''))))) as bare,
    list_sort(list_distinct(list_transform(regexp_extract_all(sql, '(?i)\b(?:FROM|JOIN)\s+({NAME})', 1),
      lambda x: lower(replace(x, '`', ''))))) as known,
    list_distinct(list_transform(regexp_extract_all(sql, '({NAME})\s*\.\s*{NAME}', 1),
      lambda x: lower(replace(x, '`', '')))) as lefts
  from views),
found as (
  select *, list_sort(list_filter(lefts, lambda x: not list_contains(aliases, x) and not list_contains(bare, x)
    and not list_contains({USUAL}, x))) as others from names)"""


@query(
    "g5_statement_names",
    f"""with {STATEMENTS_SQL}, {VIEWS_SQL}, {NAMES_SQL} select id, array_to_string(aliases, ',') as aliases,
      array_to_string(bare, ',') as unqualified, array_to_string(known, ',') as tables,
      array_to_string(others, ',') as databases from found""",
)
def statement_names(spark, sf_dir):
    sql = F.regexp_replace("sql", r"^\s+|\s+$", "")

    def listed(names):
        return F.array_join(F.array_sort(names), ",")

    return statements(spark, sf_dir).select(
        "id",
        listed(rules.table_aliases(sql)).alias("aliases"),
        listed(rules.unqualified_tables(sql)).alias("unqualified"),
        listed(rules.known_tables(sql)).alias("tables"),
        listed(rules.qualifying_databases(sql)).alias("databases"),
    )


INJECTION = "|".join(rules.INJECTION_PATTERNS).replace("'", "''")
VERDICT_SQL = rf"""
judged as (
  select id, case
    when sql = '' then 'invalid_sql|Generated SQL is empty.'
    when len(list_filter(string_split(sql, ';'), lambda x: trim(x, ' ' || chr(9) || chr(10)) <> '')) <> 1
      then 'multi_statement|Multiple SQL statements are not allowed.'
    when regexp_matches(sql, '--|/\*|\*/|#') then 'sql_comment|SQL comments are not allowed.'
    when regexp_matches(upper(kw), '\b({WORDS})\b') then 'destructive_sql|Forbidden SQL operation: '
      || regexp_extract(upper(kw), '\b({WORDS})\b', 1) || '.'
    when regexp_matches(upper(kw), '\bUNION\b') then 'union|UNION queries are blocked by the SQL guardrail.'
    when regexp_matches(sql, '(?i){INJECTION}') then 'sql_injection|SQL injection pattern detected.'
    when not regexp_matches(upper(kw), '^\s*(SELECT|WITH)\b')
      then 'not_read_only|Only SELECT/WITH read-only queries are allowed.'
    else coalesce({danger_sql()}, case
      when list_has_any(others, ['mysql', 'information_schema', 'performance_schema', 'sys'])
        then 'system_database|System database access is blocked.'
      when len(list_filter(others, lambda x: x <> database)) > 0
        then 'cross_database|Cross-database access is blocked.'
      else 'ok|SQL passed security guardrails.' end) end as v
  from found),
verdicts as (select id, split_part(v, '|', 1) as category, v[strpos(v, '|') + 1:] as reason from judged)"""


@query(
    "g6_statement_verdicts",
    f"""with {STATEMENTS_SQL}, {VIEWS_SQL}, {NAMES_SQL}, {VERDICT_SQL}
      select id, category = 'ok' as allowed, category, reason from verdicts""",
)
def statement_verdicts(spark, sf_dir):
    return audit.judge_statements(statements(spark, sf_dir)).select("id", "allowed", "category", "reason")


@query(
    "g6b_statement_audit",
    f"""with {STATEMENTS_SQL}, {VIEWS_SQL}, {NAMES_SQL}, {VERDICT_SQL}
      select category, count(*) as n from verdicts group by category""",
)
def statement_audit(spark, sf_dir):
    return audit.category_counts(statement_verdicts(spark, sf_dir))


REFERENCED_SQL = r"""list_transform(list_concat(regexp_extract_all(sql, '(?i)\bFROM\s+([A-Za-z0-9_`.]+)', 1),
    regexp_extract_all(sql, '(?i)\bJOIN\s+([A-Za-z0-9_`.]+)', 1)),
    lambda x: lower(replace(string_split(regexp_replace(x, '^`+|`+$', '', 'g'), '.')[-1], '`', '')))"""


@query(
    "g7_references",
    rf"""with {STATEMENTS_SQL} select id, array_to_string({REFERENCED_SQL}, ',') as tables,
      array_to_string(list_transform(regexp_extract_all(sql,
        '\b([A-Za-z_][A-Za-z0-9_]*\.[A-Za-z_][A-Za-z0-9_]*)\b', 1), lambda x: lower(x)), ',') as columns_used from statements""",
)
def references(spark, sf_dir):
    sql = F.col("sql")
    return statements(spark, sf_dir).select(
        "id",
        F.array_join(rules.referenced_tables(sql), ",").alias("tables"),
        F.array_join(rules.column_references(sql), ",").alias("columns_used"),
    )


def _shape(spark, sf_dir):
    return columns_frame(spark, tables(spark, sf_dir))


SHOP_TABLES = [t for d, t, _, _ in TABLES if d == "shop"]
SHOP_COLUMNS = [f"{t}.{c}".lower() for d, t, _, cols in TABLES if d == "shop" for c in cols.values()]


def list_sql(values) -> str:
    return "[" + ", ".join(literal(v) for v in values) + "]"


FIRST_WORD_SQL = (
    "case " + " ".join(f"when contains(upper(sql), '{w} ') then '{w}'" for w in rules.WRITE_WORDS) + " end"
)
ALIAS_PATTERN = (
    "(?i)\\b(?:FROM|JOIN)\\s+(?:[A-Za-z0-9_]+\\.)?`?([A-Za-z0-9_]+)`?(?:\\s+AS)?\\s+`?([A-Za-z_][A-Za-z0-9_]*)`?"
)


@query(
    "g8_catalogue_check",
    rf"""with {STATEMENTS_SQL},
      cut as (select *, {FIRST_WORD_SQL} as word,
        list_filter({REFERENCED_SQL}, lambda x: not list_contains({list_sql(SHOP_TABLES)}, x)) as missing_tables,
        list_filter(regexp_extract_all(sql, '(?i)(?:FROM|JOIN)\s+([A-Za-z0-9_]+)\.[A-Za-z0-9_]+', 1),
                    lambda x: lower(x) <> database) as foreign_dbs,
        list_filter(list_zip(list_transform(regexp_extract_all(sql, '{ALIAS_PATTERN}', 1), lambda x: lower(x)),
                             list_transform(regexp_extract_all(sql, '{ALIAS_PATTERN}', 2), lambda x: lower(x))),
          lambda p: list_contains({list_sql(SHOP_TABLES)}, p[1]) and not list_contains(['on', 'where', 'join', 'left',
            'right', 'inner', 'outer', 'group', 'order', 'limit'], p[2])) as aliases,
        list_transform(regexp_extract_all(sql, '\b([A-Za-z_][A-Za-z0-9_]*\.[A-Za-z_][A-Za-z0-9_]*)\b', 1),
                       lambda x: lower(x)) as refs from statements),
      used as (select *, list_filter(list_transform(refs, lambda r:
          case when list_contains({list_sql(SHOP_TABLES)}, split_part(r, '.', 1)) then r
               else list_filter(aliases, lambda p: p[2] = split_part(r, '.', 1))[-1][1] || '.' || split_part(r, '.', 2)
          end), lambda x: x is not null) as resolved from cut),
      checked as (select *, list_sort(list_distinct(list_filter(resolved,
          lambda x: not list_contains({list_sql(SHOP_COLUMNS)}, x)))) as missing_columns from used),
      said as (select id, case when word is not null then 'Forbidden SQL operation: ' || word
        when len(missing_tables) > 0 then 'Tables not present in database: ' || array_to_string(missing_tables, ', ')
        when len(foreign_dbs) > 0 then 'SQL references database ''' || foreign_dbs[1] || ''' instead of ''' || database || '''.'
        when len(missing_columns) > 0 then 'Columns not present in retrieved schema: ' || array_to_string(missing_columns, ', ')
        else 'SQL is valid.' end as message from checked)
      select id, message, message = 'SQL is valid.' as valid from said""",
)
def catalogue_check(spark, sf_dir):
    log = statements(spark, sf_dir)
    return audit.check_against_catalogue(log, _shape(spark, sf_dir)).select("id", "message", "valid")


BASIC_WORD_SQL = (
    "case " + " ".join(rf"when regexp_matches(upper(sql), '\b{w}\b') then '{w}'" for w in rules.WRITE_WORDS) + " end"
)


@query(
    "g9_read_only_check",
    f"""with {STATEMENTS_SQL},
      cut as (select *, {BASIC_WORD_SQL} as word, list_sort(list_distinct(list_filter({REFERENCED_SQL},
        lambda x: not list_contains({list_sql(SHOP_TABLES)}, x)))) as missing from statements),
      said as (select id, case when word is not null then 'Forbidden SQL operation: ' || word
        when len(missing) > 0 then 'Tables not present in database: ' || array_to_string(missing, ', ')
        else 'SQL passed basic validation.' end as message from cut)
      select id, message, message = 'SQL passed basic validation.' as valid from said""",
)
def read_only_check(spark, sf_dir):
    log = statements(spark, sf_dir)
    return audit.check_read_only(log, _shape(spark, sf_dir)).select("id", "message", "valid")


ANSWERS = ["{text}", "{text}\nmysql_password: x", "{text} password = {id}", "{text} GROQ api-key", "{text} sk-{pad}"]


def _answers(spark, sf_dir):
    talk = load(spark, sf_dir, "conversations")
    pad = F.repeat(F.lit("a1"), 12)
    text = filled(ANSWERS, F.pmod("turn", F.lit(len(ANSWERS))), text=F.col("text"), id=F.col("conv_id"), pad=pad)
    said = talk.select(F.concat_ws("-", F.lit("c"), "conv_id", "turn").alias("id"), text.alias("text"))
    docs = load(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text")
    return said.unionByName(docs)


ANSWERS_SQL = f"""
answers as (
  select 'c-' || conv_id || '-' || turn as id,
    {filled_sql(ANSWERS, f"turn % {len(ANSWERS)}", text="text", id="conv_id", pad="repeat('a1', 12)")} as text
  from conversations
  union all select 'd' || doc_id, text from documents)"""
SECRETS = " or ".join(f"regexp_matches(text, '{p}')" for p in rules.SECRET_PATTERNS)


@query(
    "g10_answer_rules",
    f"""with {ANSWERS_SQL} select id, case when length(text) > 10000 then 'output_too_long' when {SECRETS}
      then 'secret_leak' else 'ok' end as category from answers""",
)
def answer_rules(spark, sf_dir):
    return _answers(spark, sf_dir).select("id", rules.answer_category(F.col("text")).alias("category"))


LINKED = ["{text}", "mysql://{src}:p{id}@host/db {text}", "{text} pwd: '{src} {id}'", 'api_key="{id}"; {text}']


def _linked_texts(spark, sf_dir):
    text = filled(
        LINKED, F.pmod("doc_id", F.lit(len(LINKED))), text=F.col("text"), id=F.col("doc_id"), src=F.col("source")
    )
    return load(spark, sf_dir, "documents").select("doc_id", text.alias("text"))


URLS = rules.URL_CREDENTIALS.replace("'", "''")
PAIRS = rules.SECRET_PAIRS.replace("'", "''")
LINKED_SQL = f"""linked as (select doc_id,
  {filled_sql(LINKED, f"doc_id % {len(LINKED)}", text="text", id="doc_id", src="source")} as text from documents)"""


@query(
    "g11_mask_secrets",
    rf"""with {LINKED_SQL}, u as (select doc_id, text, regexp_replace(text, '{URLS}', '\1***@', 'g') as t from linked)
      select doc_id, md5(regexp_replace(t, '{PAIRS}', '\1***', 'g')) as masked,
        cast(len(regexp_extract_all(text, '{URLS}')) + len(regexp_extract_all(t, '{PAIRS}')) as int) as n from u""",
)
def mask_secrets(spark, sf_dir):
    text = F.col("text")
    return _linked_texts(spark, sf_dir).select(
        "doc_id", F.md5(rules.mask_secrets(text)).alias("masked"), rules.secret_count(text).alias("n")
    )


@query(
    "g12_likely_clear",
    rf"""with {TYPED_SQL}, q as (select id, regexp_replace(lower(regexp_replace(text, '^\s+|\s+$', '', 'g')), '\s+', ' ', 'g') as q from typed)
      select id, q <> '' and not (len(string_split(q, ' ')) <= 4 and (
        regexp_matches(q, '^(show|give|list|display)\s+(me\s+)?the\s+\w+s?$') or
        regexp_matches(q, '^(what|how)\s+about\s+the\s+\w+s?$') or
        regexp_matches(q, '^(show|give|list|display)\s+\w+s?$'))) as clear from q""",
)
def likely_clear(spark, sf_dir):
    return typed_questions(spark, sf_dir).select("id", rules.likely_clear(F.col("text")).alias("clear"))


@query(
    "g13_clean_sql",
    rf"""with {STATEMENTS_SQL}, c as (select id, regexp_replace(regexp_replace(sql, '(?i)```sql|```', '', 'g'), '^\s+|\s+$', '', 'g') as s
        from statements) select id, case when ends_with(s, ';') then s else s || ';' end as sql from c""",
)
def clean_statements(spark, sf_dir):
    return statements(spark, sf_dir).select("id", clean_sql(F.col("sql")).alias("sql"))


@query(
    "g14_rule_pass_rate",
    f"""with {STATEMENTS_SQL}, {VIEWS_SQL}, {NAMES_SQL}, {VERDICT_SQL}
      select count(*) filter (category <> 'ok') as blocked, count(*) as total,
        round(count(*) filter (category <> 'ok') * 100.0 / count(*), 2) as percent from verdicts""",
)
def rule_pass_rate(spark, sf_dir):
    return audit.rule_pass_rate(statement_verdicts(spark, sf_dir), ~F.col("allowed"))


GRANTS = [
    "GRANT USAGE ON *.* TO `reader`@`%`",
    "GRANT SELECT ON `db{part}`.* TO `reader`@`%`",
    "GRANT SELECT, INSERT (a, b), Update ON `db{part}`.* TO `reader`@`%` WITH GRANT OPTION",
    "GRANT SELECT ON *.* TO 'reader'@'%'",
    "GRANT SELECT ON `mysql`.* TO `reader`@`%`",
    "GRANT `role{part}`@`%` TO `reader`@`%`",
    "GRANT select ON `data\\_{part}`.* TO `reader`@`%`",
    "SET ROLE ALL",
]


def _grant_lines(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem")
    choice = F.pmod(F.col("l_orderkey") + F.col("l_linenumber"), F.lit(len(GRANTS)))
    return rows.select(F.col("l_suppkey").alias("account"), filled(GRANTS, choice, part=F.col("l_partkey")).alias("line"))


GRANTS_SQL = rf"""
lines as (select l_suppkey as account,
  {filled_sql(GRANTS, f"(l_orderkey + l_linenumber) % {len(GRANTS)}", part="l_partkey")} as line from lineitem),
cut as (
  select account, regexp_matches(line, '(?is)^\s*GRANT\s+(.+?)\s+ON\s+(.+?)\s+TO\s') as is_grant,
    regexp_matches(line, '(?is)^\s*GRANT\s+[^\s].*\s+TO\s') as to_role,
    regexp_replace(regexp_extract(line, '(?is)^\s*GRANT\s+(.+?)\s+ON\s+(.+?)\s+TO\s', 1), '\([^)]*\)', '', 'g') as privs,
    trim(regexp_extract(line, '(?is)^\s*GRANT\s+(.+?)\s+ON\s+(.+?)\s+TO\s', 2)) as obj,
    regexp_matches(line, '(?i)\bWITH\s+GRANT\s+OPTION\b') as opt from lines),
facts as (
  select account, is_grant, to_role and not is_grant as is_role, opt, obj in ('*.*', '*') as is_global,
    lower(replace(replace(trim(trim(string_split(obj, '.')[1]), '`''"'), '\_', '_'), '\%', '%')) as db,
    list_distinct(list_filter(list_transform(string_split(privs, ','), lambda x: upper(trim(x))), lambda x: x <> '')) as ps
  from cut),
scoped as (
  select *, case when is_global then 'all databases (*.*)' else 'database `' || db || '`' end as scope,
    list_sort(list_filter(ps, lambda x: x not in ('SELECT', 'USAGE'))) as excess,
    list_contains(ps, 'SELECT') as reads, db in ('mysql', 'information_schema', 'performance_schema', 'sys') as system
  from facts),
beyond as (select distinct account, db from scoped where is_grant and reads and not is_global and not system
           and db not in (select 'db' || p_partkey from part where p_size < 25)),
ranked as (select *, row_number() over (partition by account order by db) as rn, count(*) over (partition by account) as n from beyond),
findings as (
  select account, 'The account has role grants that cannot be verified here; check them manually.' as finding
    from scoped where is_role
  union select account, 'Excess privileges on ' || scope || ': ' || array_to_string(excess, ', ') || '.'
    from scoped where is_grant and len(excess) > 0
  union select account, 'GRANT OPTION is held on ' || scope || '.' from scoped where is_grant and opt
  union select account, 'SELECT is granted on ALL databases (*.*), including the system schemas.'
    from scoped where is_grant and reads and is_global
  union select account, 'SELECT is granted on the system schema `' || db || '`.'
    from scoped where is_grant and reads and not is_global and system
  union select account, 'SELECT is granted on databases outside the allow-list: ' ||
      string_agg(db, ', ' order by db) filter (rn <= 5)
      || case when any_value(n) > 5 then ' (+' || (any_value(n) - 5) || ' more)' else '' end || '.'
    from ranked group by account)"""


@query("g15_grant_audit", f"with {GRANTS_SQL} select account, finding from findings")
def grant_audit(spark, sf_dir):
    allowed = load(spark, sf_dir, "part").filter("p_size < 25").select(F.concat(F.lit("db"), "p_partkey").alias("database"))
    return audit.audit_grants(_grant_lines(spark, sf_dir), allowed)


REPLIES = ["CLEAR: YES", "clear : no\nQUESTION: Which {kind}?\nPlease say.", "Question:  {text} ", "CLEAR:NO {text}"]


@query(
    "g16_reply_parts",
    rf"""with r as (select conv_id, turn, {filled_sql(REPLIES, f"(conv_id + turn) % {len(REPLIES)}", kind="role", text="text")} as t
        from conversations)
      select conv_id, turn, upper(regexp_extract(t, '(?i)CLEAR\s*:\s*(YES|NO)', 1)) = 'YES' as clear,
        regexp_replace(regexp_extract(t, '(?is)QUESTION\s*:\s*(.*)', 1), '^\s+|\s+$', '', 'g') as question from r""",
)
def reply_parts(spark, sf_dir):
    talk = load(spark, sf_dir, "conversations")
    choice = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(REPLIES)))
    reply = filled(REPLIES, choice, kind=F.col("role"), text=F.col("text"))
    return talk.select(
        "conv_id", "turn", rules.reply_is_clear(reply).alias("clear"), rules.reply_question(reply).alias("question")
    )
