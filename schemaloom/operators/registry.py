"""Registry of data sets: owners, quota, expiry, purge and access."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemaloom.functions.rules import SYSTEM_DATABASES, USER_DATABASE
from schemaloom.functions.text import strip
from schemaloom.runtime import broadcast_if_small

MAX_DATABASES_PER_OWNER = 5
MAX_BYTES_PER_OWNER = 200 * 1024 * 1024
CLIENT_ID = r"^[A-Za-z0-9_-]{16,128}$"
DATABASE_NAME = r"^[a-z0-9_]{1,64}$"
PRIVATE_COLUMNS = ["owner", "storage_path", "error"]


def owner_hash(client_id: Column, salt: str) -> Column:
    """Stored form of a client id; ``''`` when the id is missing or malformed."""
    return F.when(client_id.rlike(CLIENT_ID), F.sha2(F.concat(F.lit(salt), client_id), 256)).otherwise("")


def usage(registry: DataFrame) -> DataFrame:
    """Databases and bytes per owner, expired ones included."""
    return registry.groupBy("owner").agg(
        F.count(F.lit(1)).alias("databases"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes")
    )


def quota_verdict(uploads: DataFrame, registry: DataFrame) -> DataFrame:
    """Adds ``verdict`` to uploads (owner, size_bytes): ok, too_many or too_large."""
    used = usage(registry).withColumnRenamed("bytes", "used")
    count = F.coalesce("databases", F.lit(0))
    return (
        uploads.join(used, "owner", "left")
        .withColumn(
            "verdict",
            F.when(count >= MAX_DATABASES_PER_OWNER, "too_many")
            .when(F.coalesce("used", F.lit(0)) + F.col("size_bytes") > MAX_BYTES_PER_OWNER, "too_large")
            .otherwise("ok"),
        )
        .drop("databases", "used")
    )


def expiry(created: Column, ttl_days: Column) -> Column:
    """End of life; null for a data set that never expires."""
    return F.when(ttl_days > 0, created + F.make_dt_interval(ttl_days.cast("int")))


def is_expired(expires: Column, now: Column) -> Column:
    return F.coalesce(expires <= now, F.lit(False))


def active(registry: DataFrame, now: Column) -> DataFrame:
    """Unexpired data sets without private fields; owner by owner, newest first.

    A range sort, so an owner with very many data sets is spread over tasks.
    """
    kept = registry.filter(~is_expired(F.col("expires_at"), now))
    return kept.orderBy("owner", F.desc("created_at"), F.desc("id")).drop(*PRIVATE_COLUMNS)


def list_for_owner(registry: DataFrame, owner: str, now: Column) -> DataFrame:
    """Active data sets of one owner; nothing for an absent owner."""
    return active(registry.filter((F.col("owner") == owner) & (F.col("owner") != "")), now)


def purge(registry: DataFrame, documents: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Registry and documents without the expired data sets."""
    gone = is_expired(F.col("expires_at"), now)
    expired = registry.filter(gone).select(F.col("id").alias("database"))
    return registry.filter(~gone), documents.join(expired, "database", "left_anti")


def clean_names(names: DataFrame) -> DataFrame:
    """Distinct database names that may be listed: plain, not a system schema, not a user id."""
    name = F.lower(F.regexp_replace(strip(F.col("database")), "^`+|`+$", ""))
    return (
        names.withColumn("database", name)
        .filter(
            F.col("database").rlike(DATABASE_NAME)
            & ~F.col("database").isin(SYSTEM_DATABASES)
            & ~F.col("database").rlike(USER_DATABASE)
        )
        .distinct()
    )


def listed_names(lines: DataFrame) -> DataFrame:
    """(database): clean names of ``lines(value)``, one a line; what follows a ``#`` is a comment."""
    return clean_names(lines.select(F.regexp_replace("value", "(?s)#.*", "").alias("database")))


def allow_list(sources: DataFrame) -> DataFrame:
    """Names of the first source (by ``priority``) that yields any; none gives no names."""
    clean = clean_names(sources.select("priority", "database"))
    first = clean.agg(F.min("priority").alias("priority"))
    return clean.join(F.broadcast(first), "priority", "left_semi").select("database")


def check_access(requests: DataFrame, registry: DataFrame, allowed: DataFrame, now: Column) -> DataFrame:
    """Adds ``verdict``: user, builtin, or one identical refusal for every other case."""
    wanted = requests.withColumn(
        "name", F.lower(F.regexp_replace(strip(F.coalesce("database", F.lit(""))), "^`+|`+$", ""))
    )
    mine = registry.select(
        F.col("id").alias("name"),
        F.col("owner").alias("reg_owner"),
        ((F.col("status") == "ready") & ~is_expired(F.col("expires_at"), now)).alias("usable"),
    )
    listed = broadcast_if_small(allowed.select(F.col("database").alias("name"), F.lit(True).alias("listed")))
    is_user = F.col("name").rlike(USER_DATABASE)
    owned = F.col("usable") & (F.col("owner") != "") & (F.col("owner") == F.col("reg_owner"))

    def judged(rows: DataFrame, passed: Column, verdict: str) -> DataFrame:
        said = F.when(F.coalesce(passed, F.lit(False)), verdict).otherwise("Database not found.")
        return rows.select(*requests.columns, said.alias("verdict"))

    # A plain name asked for very often never reaches the shuffle on registry ids.
    users = wanted.filter(is_user).join(mine, "name", "left")
    others = wanted.filter(~is_user).join(listed, "name", "left")
    return judged(users, owned, "user").unionByName(judged(others, F.col("listed"), "builtin"))


def visible_databases(allowed: DataFrame, seen: DataFrame) -> DataFrame:
    """Allowed databases that the server shows; all allowed ones when it shows none."""
    seen_names = seen.select(F.lower("database").alias("database")).distinct()
    both = allowed.join(broadcast_if_small(seen_names), "database", "left_semi")
    return allowed if both.isEmpty() else both


def days_left(expires: Column, now: Column) -> Column:
    """Text shown for the remaining life; null when it never ends."""
    # Whole microseconds keep the rounding exact.
    left = F.unix_micros(expires.cast("timestamp")) - F.unix_micros(now.cast("timestamp"))
    days = F.ceil(left / F.lit(86_400_000_000))
    return (
        F.when(expires.isNull(), F.lit(None).cast("string"))
        .when(left <= 0, "expiring")
        .when(days == 1, "1 day left")
        .otherwise(F.concat(days.cast("string"), F.lit(" days left")))
    )


def size_text(size: Column) -> Column:
    kib, mib = size / 1024, size / (1024 * 1024)
    return (
        F.when(size < 1024, F.concat(size.cast("bigint").cast("string"), F.lit(" B")))
        .when(size < 1024 * 1024, F.concat(F.format_string("%.1f", kib), F.lit(" KB")))
        .otherwise(F.concat(F.format_string("%.1f", mib), F.lit(" MB")))
    )
