"""Query history and the registry of data sets over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from schemaloom.operators import history as hist
from schemaloom.operators import registry as reg
from schemaloom.plans.inputs import (
    HISTORY_SQL,
    NOW_SQL,
    REGISTRY_SQL,
    history,
    literal,
    load,
    now,
    registry,
)
from schemaloom.plans.registered import query

KEEP = 20
STAMP = "strftime(ts, '%Y-%m-%d %H:%M:%S.%f')"


def _stamp(name: str = "ts"):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(name)


@query(
    "h1_append",
    f"""with {HISTORY_SQL}, last as (select max(id) as last from history),
      fresh as (select conv_id + 1 as owner, text as question, conv_id * 1000 + turn + 1 as arrival from conversations),
      both_ as (select id, owner, question, ts from history union all
        select last + arrival, owner, question, {NOW_SQL} from fresh, last)
      select id, owner, md5(question) as question, {STAMP} as ts from both_""",
)
def append(spark, sf_dir):
    fresh = load(spark, sf_dir, "conversations").select(
        (F.col("conv_id") + 1).alias("owner"),
        F.col("text").alias("question"),
        (F.col("conv_id") * 1000 + F.col("turn") + 1).alias("arrival"),
    )
    old = history(spark, sf_dir).select("id", "owner", "question", "ts")
    return hist.append(old, fresh, now()).select("id", "owner", F.md5("question").alias("question"), _stamp())


@query(
    "h2_retention",
    f"""with {HISTORY_SQL} select id, owner from (select id, owner, row_number() over (partition by owner order by ts desc, id desc) as rn
      from history) where rn <= {KEEP}""",
)
def retention(spark, sf_dir):
    return hist.retain(history(spark, sf_dir), KEEP).select("id", "owner")


@query(
    "h3_owner_counts",
    f"""with {HISTORY_SQL} select owner, count(*) as "count", arg_max(id, (ts, id)) as newest_id from history group by owner""",
)
def owner_counts(spark, sf_dir):
    return hist.counted_by_owner(history(spark, sf_dir))


@query(
    "h3b_owner_rows",
    f"""with {HISTORY_SQL} select id, question, database, sql, row_count, latency_ms, {STAMP} as ts from history where owner = 7""",
)
def owner_rows(spark, sf_dir):
    rows = hist.of_owner(history(spark, sf_dir), 7)
    return rows.select(*[c for c in rows.columns if c != "ts"], _stamp())


# Requests (owner, id) from the order lines: half of them name an id of another owner.
REQUESTS_SQL = "requests as (select distinct l_suppkey as owner, l_orderkey as id from lineitem)"


def _requests(spark, sf_dir):
    return (
        load(spark, sf_dir, "lineitem")
        .select(F.col("l_suppkey").alias("owner"), F.col("l_orderkey").alias("id"))
        .distinct()
    )


@query(
    "h4_one_item",
    f"with {HISTORY_SQL}, {REQUESTS_SQL} select h.id, h.question, h.sql from history h join requests r on h.id = r.id and h.owner = r.owner",
)
def one_item(spark, sf_dir):
    return hist.one_item(history(spark, sf_dir), _requests(spark, sf_dir)).select("id", "question", "sql")


@query(
    "h5_delete_items",
    f"""with {HISTORY_SQL}, {REQUESTS_SQL} select h.id, h.owner from history h
      where not exists (select 1 from requests r where h.id = r.id and h.owner = r.owner)""",
)
def delete_items(spark, sf_dir):
    return hist.without_items(history(spark, sf_dir), _requests(spark, sf_dir)).select("id", "owner")


@query(
    "h5b_clear_owners",
    f"with {HISTORY_SQL} select id, owner from history where owner not in (select s_suppkey from supplier where s_acctbal < 0)",
)
def clear_owners(spark, sf_dir):
    owners = load(spark, sf_dir, "supplier").filter("s_acctbal < 0").select(F.col("s_suppkey").alias("owner"))
    return hist.without_owners(history(spark, sf_dir), owners).select("id", "owner")


@query(
    "h6_search",
    f"""with {HISTORY_SQL} select id, database from history where (contains(lower(question), '"k": 1') or contains(lower(sql), '"k": 1')
      or contains(lower(coalesce(database, '')), '"k": 1')) and database = 'purchase'""",
)
def search(spark, sf_dir):
    return hist.search(history(spark, sf_dir), ' "K": 1', "purchase").select("id", "database")


@query("h7_databases", f"with {HISTORY_SQL} select distinct database from history where database <> ''")
def databases(spark, sf_dir):
    return hist.database_names(history(spark, sf_dir))


@query(
    "h8_totals",
    f"""with {HISTORY_SQL} select count(*) as queries, cast(sum(row_count) as bigint) as "rows",
      cast(floor(avg(coalesce(latency_ms, 0)) + 0.5) as bigint) as mean_latency from history""",
)
def totals(spark, sf_dir):
    return hist.totals(history(spark, sf_dir))


@query(
    "h9_monitor_totals",
    f"""with {HISTORY_SQL} select cast(sum(row_count) as bigint) as "rows", cast(floor(avg(latency_ms) + 0.5) as bigint) as mean_latency,
      count(distinct database) as databases from history""",
)
def monitor_totals(spark, sf_dir):
    return hist.monitor_totals(history(spark, sf_dir))


@query(
    "h10_latest_bars",
    f"""with {HISTORY_SQL}, l as (select id, ts, coalesce(latency_ms, 0) as v from history order by ts desc, id desc limit 12)
      select id, {STAMP} as ts, round(greatest(6.0, v / (select greatest(max(v), 1.0) from l) * 100), 6) as height from l""",
)
def latest_bars(spark, sf_dir):
    bars = hist.latest_bars(history(spark, sf_dir))
    return bars.select("id", _stamp(), F.round("height", 6).alias("height"))


@query(
    "h11_named_like",
    f"""with {HISTORY_SQL}, names as (select distinct question as database from history) select database from names
      where contains(lower(database), '"k": 4')""",
)
def named_like(spark, sf_dir):
    names = history(spark, sf_dir).select(F.col("question").alias("database")).distinct()
    return hist.named_like(names, '"K": 4 '.strip())


SALT = "a public test salt"


@query(
    "u1_owner_hash",
    f"""with c as (select c_custkey, case when c_mktsegment = 'BUILDING' then 'short' || c_custkey
        when c_mktsegment = 'MACHINERY' then c_name || ' with blanks' else 'client_' || replace(c_name, '#', '-') end as client from customer)
      select c_custkey, case when regexp_matches(client, '^[A-Za-z0-9_-]{{16,128}}$') then sha256({literal(SALT)} || client) else '' end as owner from c""",
)
def owner_hash(spark, sf_dir):
    segment, name = F.col("c_mktsegment"), F.col("c_name")
    client = (
        F.when(segment == "BUILDING", F.concat(F.lit("short"), F.col("c_custkey").cast("string")))
        .when(segment == "MACHINERY", F.concat(name, F.lit(" with blanks")))
        .otherwise(F.concat(F.lit("client_"), F.replace(name, F.lit("#"), F.lit("-"))))
    )
    return load(spark, sf_dir, "customer").select("c_custkey", reg.owner_hash(client, SALT).alias("owner"))


@query(
    "u2_usage",
    f"""with {REGISTRY_SQL} select owner, count(*) as databases, cast(sum(size_bytes) as bigint) as "bytes" from registry group by owner""",
)
def usage(spark, sf_dir):
    return reg.usage(registry(spark, sf_dir))


UPLOADS_SQL = """uploads as (select cast(c_custkey as varchar) as owner, cast(floor(abs(c_acctbal) * 10000) as bigint) as size_bytes from customer)"""


@query(
    "u3_quota",
    f"""with {REGISTRY_SQL}, {UPLOADS_SQL}, used as (select owner, count(*) as n, sum(size_bytes) as b from registry group by 1)
      select owner, size_bytes, case when coalesce(n, 0) >= 5 then 'too_many'
        when coalesce(b, 0) + size_bytes > 209715200 then 'too_large' else 'ok' end as verdict
      from uploads left join used using (owner)""",
)
def quota(spark, sf_dir):
    uploads = load(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("owner"),
        F.floor(F.abs("c_acctbal") * 10000).alias("size_bytes"),
    )
    return reg.quota_verdict(uploads, registry(spark, sf_dir))


@query(
    "u4_active",
    f"""with {REGISTRY_SQL} select id, size_bytes, status, strftime(created_at, '%Y-%m-%d') as created
      from registry where expires_at is null or expires_at > {NOW_SQL}""",
)
def active(spark, sf_dir):
    rows = reg.active(registry(spark, sf_dir), now())
    return rows.select("id", "size_bytes", "status", F.date_format("created_at", "yyyy-MM-dd").alias("created"))


@query(
    "u5_expiry",
    f"""with {REGISTRY_SQL} select id, strftime(expires_at, '%Y-%m-%d %H:%M:%S') as expires,
      coalesce(expires_at <= {NOW_SQL}, false) as expired from registry""",
)
def expiry(spark, sf_dir):
    return registry(spark, sf_dir).select(
        "id",
        F.date_format("expires_at", "yyyy-MM-dd HH:mm:ss").alias("expires"),
        reg.is_expired(F.col("expires_at"), now()).alias("expired"),
    )


@query(
    "u6_purge",
    f"""with {REGISTRY_SQL}, gone as (select id from registry where expires_at <= {NOW_SQL})
      select 'registry' as kind, count(*) as n from registry where id not in (select id from gone)
      union all select 'documents', count(*) from lineitem
        where 'u_' || lpad(lower(to_hex(l_orderkey)), 12, '0') not in (select id from gone)""",
)
def purge(spark, sf_dir):
    """Lines of an order stand for the documents of a data set."""
    database = F.concat(F.lit("u_"), F.lpad(F.lower(F.hex("l_orderkey")), 12, "0"))
    documents = load(spark, sf_dir, "lineitem").select(database.alias("database"), "l_linenumber")
    kept, kept_documents = reg.purge(registry(spark, sf_dir), documents, now())
    n = F.count(F.lit(1)).alias("n")
    return kept.agg(n).select(F.lit("registry").alias("kind"), "n").unionByName(
        kept_documents.agg(n).select(F.lit("documents").alias("kind"), "n")
    )


@query(
    "u7_access",
    f"""with {REGISTRY_SQL}, requests as (select l_orderkey, l_linenumber,
        case when l_returnflag = 'A' then ' U_' || lpad(upper(to_hex(l_orderkey)), 12, '0')
             when l_returnflag = 'R' then '`' || 'src' || l_linenumber || '`' else 'mysql' end as database,
        cast(case when l_quantity > 25 then o_custkey else l_suppkey end as varchar) as owner
        from lineitem join orders on l_orderkey = o_orderkey),
      named as (select *, lower(regexp_replace(trim(database), '^`+|`+$', '', 'g')) as name from requests),
      allowed as (select distinct source from documents)
      select l_orderkey, l_linenumber, n.database, n.owner, case
        when regexp_matches(name, '^u_[0-9a-f]{{12}}$') then case when r.status = 'ready'
          and (expires_at is null or expires_at > {NOW_SQL}) and r.owner = n.owner then 'user' else 'Database not found.' end
        when name in (select source from allowed) then 'builtin' else 'Database not found.' end as verdict
      from named n left join registry r on r.id = n.name""",
)
def access(spark, sf_dir):
    lines, orders = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "orders")
    flag = F.col("l_returnflag")
    requests = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_orderkey",
        "l_linenumber",
        F.when(flag == "A", F.concat(F.lit(" U_"), F.lpad(F.upper(F.hex("l_orderkey")), 12, "0")))
        .when(flag == "R", F.concat(F.lit("`src"), F.col("l_linenumber").cast("string"), F.lit("`")))
        .otherwise("mysql")
        .alias("database"),
        F.when(F.col("l_quantity") > 25, F.col("o_custkey")).otherwise(F.col("l_suppkey")).cast("string").alias("owner"),
    )
    allowed = load(spark, sf_dir, "documents").select(F.col("source").alias("database")).distinct()
    return reg.check_access(requests, registry(spark, sf_dir), allowed, now())


# Sizes round half up, as the display does; printf alone would round a tie to even.
@query(
    "u8_days_and_sizes",
    f"""with {REGISTRY_SQL}, d as (select id, size_bytes, expires_at,
        epoch_us(expires_at) - epoch_us({NOW_SQL}) as us from registry)
      select id, case when expires_at is null then null when us <= 0 then 'expiring'
          when ceil(us / 86400000000) = 1 then '1 day left' else cast(ceil(us / 86400000000) as bigint) || ' days left' end as days,
        case when size_bytes < 1024 then size_bytes || ' B'
             when size_bytes < 1048576 then printf('%.1f', floor(size_bytes * 10 / 1024.0 + 0.5) / 10) || ' KB'
             else printf('%.1f', floor(size_bytes * 10 / 1048576.0 + 0.5) / 10) || ' MB' end as size from d""",
)
def days_and_sizes(spark, sf_dir):
    return registry(spark, sf_dir).select(
        "id",
        reg.days_left(F.col("expires_at"), now()).alias("days"),
        reg.size_text(F.col("size_bytes")).alias("size"),
    )
