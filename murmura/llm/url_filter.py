"""URL filters: each pattern rule is indexed by its rarest literal token; only fetched rules run their expression."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rule tables up to so many rows are broadcast; larger ones are shuffled by token.
BROADCAST_RULES = 100_000


@dataclass(frozen=True)
class Rule:
    """A verdict for urls that match ``pattern``; every match holds each of ``literals`` (lower-case letters and digits) as a whole token; of a literal a|b it holds a or b."""

    name: str
    verdict: str
    pattern: str
    literals: tuple[str, ...]


#: Without a stated rule: pattern rules for hosts and paths of spam, adult content, gambling, trackers and downloads.
DEFAULT_RULES = (
    Rule("spam-farm", "block", r"^[a-z][a-z0-9+.-]*://([^/?#]*\.)?spam-farm\.", ("spam", "farm")),
    Rule("casino-host", "block", r"^[a-z][a-z0-9+.-]*://[^/?#]*\bcasino\b", ("casino",)),
    Rule("online-poker", "block", r"\bonline[-_]poker\b", ("online", "poker")),
    Rule("free-download", "block", r"/free[-_]download\b", ("free", "download")),
    Rule("ads-track", "block", r"^[a-z][a-z0-9+.-]*://([^/?#]*\.)?ads?-track", ("ad|ads",)),
    Rule("free-bets", "block", r"^[a-z][a-z0-9+.-]*://([^/?#]*\.)?free-bets\.", ("free", "bets")),
    Rule("cheap-pills", "block", r"^[a-z][a-z0-9+.-]*://([^/?#]*\.)?cheap-pills\.", ("cheap", "pills")),
    Rule("adult-x", "block", r"^[a-z][a-z0-9+.-]*://([^/?#]*\.)?adult-x\.", ("adult", "x")),
    Rule("adult-porn", "block", r"\bporn\b", ("porn",)),
    Rule("adult-xxx", "block", r"^[a-z][a-z0-9+.-]*://[^/?#]*\bxxx\b", ("xxx",)),
    Rule("click-tracker", "block", r"^[a-z][a-z0-9+.-]*://(ads|click|track)\.[^/?#]*/click\b", ("click",)),
    Rule("executable", "block", r"\.exe([?#]|$)", ("exe",)),
    Rule("phishing", "block", r"\bverify[-_]account\b", ("verify", "account")),
)


def host_of(url: Column) -> Column:
    """What follows the first ``://``, up to / ? # or the end, lower-cased in A-Z; empty without one."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ? # or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_host_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Name and verdict of the longest of a stated list of (verdict, host, path) rules that fits; a rule's name is host + path."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    name = verdict = None
    for said, domain, start in ordered:
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(start)
        name = F.when(fits, F.lit(domain + start)) if name is None else name.when(fits, F.lit(domain + start))
        verdict = F.when(fits, F.lit(said)) if verdict is None else verdict.when(fits, F.lit(said))
    return (F.lit(None).cast("string"), F.lit(None).cast("string")) if name is None else (name, verdict)


def tokens_of(url: Column) -> Column:
    """Distinct runs of letters and digits, lower-cased."""
    return F.array_distinct(F.filter(F.split(F.lower(url), "[^a-z0-9]+"), lambda t: t != ""))


def rule_table(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame:
    """(name, verdict, pattern, literals) of stated rules."""
    rows = [F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"), F.lit(r.pattern).alias("pattern"), F.array(*map(F.lit, r.literals)).alias("literals")) for r in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def rule_index(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``rules`` (name, verdict, pattern, literals) with ``token``: the literal that the fewest of all ``urls`` hold, ties by name; a row for each alternative of it."""
    parts = rules.select("name", "verdict", "pattern", F.explode("literals").alias("literal")).withColumn("token", F.explode(F.split("literal", "[|]")))
    want = parts.select("token").distinct()
    want = F.broadcast(want) if rules.count() <= BROADCAST_RULES else want
    seen = urls.select(F.explode(tokens_of(F.col("url"))).alias("token")).join(want, "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    each = parts.join(seen, "token", "left").fillna(0, ["n"]).groupBy("name", "verdict", "pattern", "literal").agg(F.sum("n").alias("n"))
    rarest = each.groupBy("name", "verdict", "pattern").agg(F.min(F.struct("n", "literal")).alias("rarest"))
    return rarest.select("name", "verdict", "pattern", F.explode(F.split("rarest.literal", "[|]")).alias("token"))


def matches(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, name, verdict) of every distinct url and pattern rule that match, case ignored. Null urls match nothing."""
    indexed = rule_index(urls, rules)
    indexed = F.broadcast(indexed) if rules.count() <= BROADCAST_RULES else indexed
    fetched = urls.select("url").dropna().distinct().select("url", F.explode(tokens_of(F.col("url"))).alias("token")).join(indexed, "token")
    return fetched.filter("regexp_like(lower(url), pattern)").select("url", "name", "verdict").distinct()


def judge(pages: DataFrame, stated: list[tuple[str, str, str]], rules: DataFrame | tuple[Rule, ...] = DEFAULT_RULES) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of ``pages`` (page_id, url; other columns are ignored).

    rules may be a table (name, verdict, pattern, literals) of any size.

    The longest stated rule that fits decides. Otherwise a url is blocked if a
    block pattern matches and no allow pattern does; else allowed. Null urls and
    those without ``://`` have an empty host and path, no rule, and are allowed.
    """
    spark = pages.sparkSession
    base = pages.select("page_id", "url")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    name, verdict = longest_host_rule(F.col("host"), F.col("path"), stated)
    base = base.withColumns({"host": host, "path": path}).withColumns({"rule": name, "said": verdict})
    table = rules if isinstance(rules, DataFrame) else rule_table(spark, rules)
    found = matches(base.filter("rule is null and url like '%://%'").select("url"), table).groupBy("url").agg(F.min(F.when(F.col("verdict") == "allow", 0).otherwise(1)).alias("blocked"), F.sort_array(F.collect_set("name")).alias("patterns"))
    return base.join(found, "url", "left").select("page_id", "host", "path", "rule", F.coalesce("said", F.when(F.col("rule").isNull() & (F.col("blocked") == 1), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "patterns")
