"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from schemaloom.llm import line_dedup, quality_rules, url_filters
from schemaloom.llm.common import WORD

Q = quality_rules

OP1 = rf"""
with words as (
  select doc_id, source as host, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{WORD}') as w
  from documents
), places as (
  select doc_id, unnest(range(1, len(w) - 1)) as i,
    unnest(list_transform(range(1, len(w) - 1), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2]))) as s
  from words where len(w) >= 3
), windows as (
  select doc_id, i, count(*) over (partition by doc_id, s) as n from places
), covered as (
  select doc_id, count(distinct p) as n_repeat_words
  from (select doc_id, unnest([i, i + 1, i + 2]) as p from windows where n >= 2) group by doc_id
), lines as (
  select doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) as l from words
), counts as (
  select w.doc_id, host, len(w)::bigint as n_words,
    length(array_to_string(w, ''))::bigint as word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
    len(l)::bigint as n_lines, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines,
    coalesce(n_repeat_words, 0)::bigint as n_repeat_words
  from words w join lines using (doc_id) left join covered using (doc_id)
), base as (
  select *, n_words < {Q.MIN_WORDS} or 100 * n_repeat_words > {Q.MAX_REPEAT_PERCENT} * n_words as base_failed
  from counts
), judged as (
  select *, base_failed or 100 * n_symbols > {Q.MAX_SYMBOL_PERCENT} * word_chars
    or 100 * n_dup_lines > {Q.MAX_DUP_LINE_PERCENT} * n_lines
    or word_chars < {Q.MEAN_WORD_CHARS[0]} * n_words or word_chars > {Q.MEAN_WORD_CHARS[1]} * n_words as failed
  from base
), hosts as (
  select host, count(*) as host_docs, count(*) filter (where failed) as host_failed from judged group by host
), prior as (
  select m, case when v > 1e-12 then greatest(m * (1 - m) / v - 1, 1) else {Q.DEFAULT_STRENGTH} end as s
  from (select avg(host_failed / host_docs) as m, var_pop(host_failed / host_docs) as v from hosts)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and (host_failed + m * s) / (host_docs + s) <= {Q.MAX_HOST_RATE} as kept,
  j.host, host_docs, host_failed
from judged j join hosts h on j.host is not distinct from h.host, prior
"""


#: Rounds of spreading in the SQL form: the given pages link within their hosts only, where one is as good as all.
ROUNDS = 3


def _op3() -> str:
    u = url_filters
    ordered = sorted(u.RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fits = [f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')" for _, h, p in ordered]
    rule = " ".join(f"when {c} then '{h}{p}'" for c, (_, h, p) in zip(fits, ordered))
    verdict = " ".join(f"when {c} then '{v}'" for c, (v, _, _) in zip(fits, ordered))
    split = r"""case when contains({x}, '://') then translate(regexp_extract(substr({x}, instr({x}, '://') + 3), '^[^/?#]*'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else '' end"""
    path = r"""case when contains(url, '://') then
      regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) else '' end"""
    link = u.LINK.replace("]++", "]+").replace("'", "''")
    head = f"""
with parts as (
  select page_id, html, coalesce({split.format(x="url")}, '') as host, coalesce({path}, '') as path from pages
), ruled as (
  select *, case {rule} end as rule, case {verdict} end as rule_verdict from parts
), links as (
  select host as src, {split.format(x="link")} as dst
  from (select host, unnest(list_distinct(regexp_extract_all(coalesce(html, ''), '{link}', 1))) as link from parts)
), pairs as (
  select src, dst, count(*) as n from links where src <> dst and src <> '' and dst <> '' group by src, dst
), edges as (
  select src, dst, n / sum(n) over (partition by src) as share from pairs
), back as (
  select dst as src, src as dst, share / sum(share) over (partition by dst) as share from edges
), hosts as (
  select host, avg((rule_verdict is not distinct from 'allow')::int) as good,
    avg((rule_verdict is not distinct from 'block')::int) as bad from ruled group by host
), t0 as (select host, {1 - u.DAMPING} * good as score from hosts),
d0 as (select host, {1 - u.DAMPING} * bad as score from hosts)"""
    for i in range(1, ROUNDS + 1):
        for name, edges in (("t", "edges"), ("d", "back")):
            head += f""", {name}{i} as (
  select host, sum(score) as score from (select * from {name}0 union all
    select dst, {u.DAMPING} * share * score from {edges} join {name}{i - 1} on src = host) group by host)"""
    return head + f"""
select page_id, r.host, path, rule, coalesce(rule_verdict,
  case when r.host <> '' and d.score - t.score >= {u.THRESHOLD} then 'block' else 'allow' end) as verdict
from ruled r join t{ROUNDS} t on t.host = r.host join d{ROUNDS} d on d.host = r.host
"""


OP5 = rf"""
with lines as (
  select doc_id, source, text, unnest(string_split(text, chr(10))) as line,
    generate_subscripts(string_split(text, chr(10)), 1) as i
  from documents where text is not null
), keyed as (
  select *, regexp_matches(line, '{WORD}') as worded, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as k
  from lines
), pages as (select source, count(distinct text) as pages from documents where text is not null group by source),
common as (
  select source, k from (
    select source, k, count(distinct text) as n from keyed where worded and source is not null group by source, k)
  join pages using (source) where n >= {line_dedup.MIN_PAGES} and n > {line_dedup.MAX_RATIO} * pages
), rest as (
  select doc_id, count(*) as n_lines, count(*) filter (where not dropped) as n_left,
    string_agg(line, chr(10) order by i) filter (where not dropped) as t
  from (select k.*, worded and c.k is not null as dropped from keyed k
        left join common c on c.source = k.source and c.k = k.k) group by doc_id
)
select d.doc_id, coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_lines - n_left, 0)::bigint as n_dropped,
  case when d.text is not null then sha256(coalesce(t, '')) end as text_sha256
from documents d left join rest using (doc_id)
"""

OP8 = r"""
with texts as (
  select 0 as side, doc_id as id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') as w from documents
  union all
  select 1, item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') from benchmark
), sizes as (select distinct least(5, len(w)) as k from texts where side = 1 and len(w) > 0),
shingles as (
  select distinct side, id, k, array_to_string(w[i:i + k - 1], ' ') as s
  from (select side, id, w, k, unnest(range(1, len(w) - k + 2)) as i from texts, sizes
        where side = 0 or k = least(5, len(w)))
), items as (select id, k, s, count(*) over (partition by id) as n from shingles where side = 1)
select d.id as doc_id, i.id as item_id, n::int as n_shingles, count(*)::int as n_found
from shingles d join items i on d.k = i.k and d.s = i.s where d.side = 0
group by d.id, i.id, n having 5 * count(*) >= 4 * n
"""

ORACLES = {"op1_quality_rules": OP1, "op3_url_filters": _op3(), "op5_line_dedup": OP5, "op8_decontamination": OP8}
