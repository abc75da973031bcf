"""URL rules, and trust and distrust that spread over the links between hosts, in column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemaloom.runtime import materialise

#: (verdict, host, path): the rule fits the host and its subdomains where the path starts so.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
DAMPING = 0.85
#: Rounds go on until all that is still to come adds up to less than this.
TOLERANCE = 1e-6
#: Rounds whose scores are summed at once.
SUMMED = 16
#: Distrust less trust at which a host is blocked; half of a fully blocked host's own distrust.
THRESHOLD = 0.5 * (1 - DAMPING)

LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LINK = r"""(?i)<a\s[^<>]*?href\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^\s"'>]++)"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null or a url without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*+([^?#]*)", 1)
    return F.coalesce(F.translate(host, *LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls. The rules are a short list of constants."""
    longest = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, name, start in reversed(longest):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        rule = F.when(fits, F.lit(name + start)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def ruled_pages(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule and rule_verdict of every row of ``pages(page_id, url)``."""
    host, path = host_and_path(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return parts.withColumns({"rule": rule, "rule_verdict": verdict})


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, share): the links between different hosts; a host's shares add up to 1.

    Links are absolute ``href`` values of ``html``; relative ones stay on the host and give no edge.
    Counts are summed per pair of hosts before anything else is shuffled.
    """
    host, _ = host_and_path(F.col("url"))
    links = F.array_distinct(F.regexp_extract_all(F.coalesce(F.col("html"), F.lit("")), F.lit(LINK), F.lit(1)))
    found = pages.select(host.alias("src"), F.explode(links).alias("link"))
    target = F.when(F.col("link").startswith("//"), F.concat(F.lit("x:"), F.col("link"))).otherwise(F.col("link"))
    found = found.select("src", host_and_path(target)[0].alias("dst")).where("src <> dst and src <> '' and dst <> ''")
    pairs = found.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    out = pairs.groupBy("src").agg(F.sum("n").alias("total"))
    return pairs.join(out, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("share"))


def spread(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, score): personalised PageRank of ``seeds(host, seed)`` along ``edges(src, dst, share)``.

    Each round sends on what the last one brought, summed per target with map-side combining; the sum of
    all rounds is the score. A round brings at most ``damping`` times the last, so what is still to come is
    bounded, and the rounds end when it is less than ``tolerance`` for all hosts together. Every round is written, so that
    the plan does not grow and lost executors cost one round.
    """
    base = seeds.where("seed > 0").select("host", ((1 - damping) * F.col("seed")).alias("score"))
    wave = total = materialise(base)
    brought: list[DataFrame] = []
    while (wave.agg(F.sum("score")).first()[0] or 0.0) * damping >= tolerance * (1 - damping):
        sent = edges.join(wave.toDF("src", "score"), "src").select(
            F.col("dst").alias("host"), (damping * F.col("share") * F.col("score")).alias("score")
        )
        wave = materialise(sent.groupBy("host").agg(F.sum("score").alias("score")))
        brought.append(wave)
        if len(brought) == SUMMED:
            total, brought = materialise(_summed([total, *brought])), []
    return _summed([total, *brought]) if brought else total


def _summed(parts: list[DataFrame]) -> DataFrame:
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy("host").agg(F.sum("score").alias("score"))


def host_scores(ruled: DataFrame, edges: DataFrame, damping: float = DAMPING) -> DataFrame:
    """(host, trust, distrust): trust runs along the links, distrust against them.

    A host's seed is the share of its pages that a rule allows (trust) or blocks (distrust).
    """
    share = lambda verdict: F.avg(F.when(F.col("rule_verdict") == verdict, 1.0).otherwise(0.0))
    hosts = materialise(ruled.groupBy("host").agg(share("allow").alias("good"), share("block").alias("bad")))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "share")
    total = back.groupBy("src").agg(F.sum("share").alias("total"))
    back = materialise(back.join(total, "src").select("src", "dst", (F.col("share") / F.col("total")).alias("share")))
    trust = spread(hosts.select("host", F.col("good").alias("seed")), edges, damping)
    distrust = spread(hosts.select("host", F.col("bad").alias("seed")), back, damping)
    scored = hosts.select("host").join(trust.toDF("host", "trust"), "host", "left")
    scored = scored.join(distrust.toDF("host", "distrust"), "host", "left")
    return scored.na.fill(0.0, ["trust", "distrust"])


def judge_urls(
    pages: DataFrame,
    rules: list[tuple[str, str, str]] = RULES,
    damping: float = DAMPING,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """page_id, host, path, rule, verdict of each row of ``pages(page_id, url, html)``.

    A page that no rule fits is blocked if its host's distrust exceeds its trust by the threshold, else
    allowed; a url without host is allowed, as nothing is known against it. Null html has no links.
    Repeated rows stay repeated and count as so many pages. No rows in, no rows out.
    """
    ruled = materialise(ruled_pages(pages, rules))
    edges = materialise(host_edges(pages))
    scores = host_scores(ruled, edges, damping)
    blocked = scores.where((F.col("distrust") - F.col("trust") >= threshold) & (F.col("host") != ""))
    joined = ruled.join(blocked.select("host", F.lit("block").alias("spread")), "host", "left")
    verdict = F.coalesce("rule_verdict", "spread", F.lit("allow"))
    return joined.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
