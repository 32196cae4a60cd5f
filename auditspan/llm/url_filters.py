"""URL filters: pattern rules indexed by their rarest literal token.

A rule is an action and a regular expression over ``host + path``, together with
the literal tokens every matching URL must hold as whole tokens.  The corpus
says how rare each of these tokens is; a rule is filed under its rarest one.
The tokens of a URL fetch the rules filed under them, and only these rules are
run.  DataFrame expressions only.

Rows: every input row comes back once, repeated rows too.  A null URL, or one
without ``://``, has empty host and path and meets no rule.  Extra columns of the
input are left out, so their names cannot clash.
"""
from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditspan.localtable import local_table

TOKEN = "[a-z0-9]+"
#: a rule list up to this size may be sent to every executor
MAX_BROADCAST_RULES = 100_000


@dataclass(frozen=True)
class Rule:
    name: str
    action: str
    pattern: str
    tokens: tuple[str, ...]
    weight: int  # of the rules that match, the greatest weight wins
    site: bool = False  # a host/path rule, which goes before every plain pattern


def site_rule(action: str, host: str, path: str = "/") -> Rule:
    """A rule for a host with all subdomains and paths that start with ``path``."""
    whole = re.findall(TOKEN, host)
    # the last token of the path may go on in a longer one
    inside = re.findall(TOKEN + "(?=[^A-Za-z0-9])", path) if re.search("[A-Z]", path) is None else []
    return Rule(host + path, action, f"^(?:[^/]*\\.)?{re.escape(host)}(?={re.escape(path)})",
                tuple(dict.fromkeys([*whole, *inside])), len(host + path), True)


def pattern_rule(action: str, pattern: str, *tokens: str) -> Rule:
    """A free pattern; ``tokens`` are lower-case literals that every match holds as whole tokens."""
    if not tokens:
        raise ValueError("a pattern rule needs a literal token to be filed under")
    return Rule(pattern, action, pattern, tokens, len(pattern))


#: what the method says of URLs that no site rule covers: advertising, tracking, adult and download paths
METHOD_RULES = (
    pattern_rule("block", r"(?i)/ads(?:/|\.|$)", "ads"), pattern_rule("block", r"(?i)/ad(?:/|\.|$)", "ad"),
    pattern_rule("block", r"(?i)/banner/", "banner"), pattern_rule("block", r"(?i)/banners/", "banners"),
    pattern_rule("block", r"(?i)(?:^|\.)doubleclick\.", "doubleclick"),
    pattern_rule("block", r"(?i)/pixel\.(?:gif|png)$", "pixel"),
    pattern_rule("block", r"(?i)/beacon\.(?:gif|png)$", "beacon"),
    pattern_rule("block", r"(?i)(?:^|[./-])casino(?:[./-]|$)", "casino"),
    pattern_rule("block", r"(?i)(?:^|[./-])porn(?:[./-]|$)", "porn"), pattern_rule("block", r"(?i)\.exe$", "exe"),
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(target: Column) -> Column:
    lower = F.translate(target, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_distinct(F.filter(F.split(lower, "[^a-z0-9]+"), lambda t: t != ""))


def rule_index(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row per rule, under its rarest token: (token, pattern, rank).

    ``pages`` has the column ``target``; the counts cover all of its rows.  A
    rule's rank is its place in ``rules``.
    """
    spark = pages.sparkSession
    literals = local_table(
        spark, [(i, t) for i, r in enumerate(rules) for t in r.tokens], "rank int, token string")
    table = local_table(spark, [(i, r.pattern) for i, r in enumerate(rules)], "rank int, pattern string")
    counts = (pages.select(F.explode(url_tokens(F.col("target"))).alias("token"))
              .join(literals.select("token").distinct(), "token", "left_semi")
              .groupBy("token").agg(F.count(F.lit(1)).alias("df")))
    filed = (literals.join(counts, "token", "left")
             .groupBy("rank").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token")).alias("t")))
    return table.join(filed, "rank").select(F.col("t.token").alias("token"), "pattern", "rank")


def judge_urls(pages: DataFrame, rules: Iterable[Rule], url: str = "url", keep: str = "page_id") -> DataFrame:
    """(page_id, host, path, rule, action, site): the winning site rule, else the winning pattern, else nulls."""
    rules = sorted(rules, key=lambda r: (r.site, r.weight, r.name))
    rows = pages.select(F.col(keep).alias("page_id"), host_of(F.col(url)).alias("host"),
                        path_of(F.col(url)).alias("path")).withColumn("target", F.concat("host", "path"))
    index = rule_index(rows, rules)
    names = local_table(rows.sparkSession, [(i, r.name, r.action, r.site) for i, r in enumerate(rules)],
                        "rank int, rule string, action string, site boolean")
    if len(rules) <= MAX_BROADCAST_RULES:  # beyond, Spark joins by shuffling tokens
        index, names = F.broadcast(index), F.broadcast(names)
    # the row number only ties the tokens of one row together again, within one plan
    tokens = rows.withColumn("row", F.monotonically_increasing_id()).select(
        "row", "page_id", "host", "path", "target", F.explode_outer(url_tokens(F.col("target"))).alias("token"))
    hit = F.when(F.expr("regexp_like(target, pattern)"), F.col("rank"))
    best = (tokens.join(index, "token", "left")
            .groupBy("row", "page_id", "host", "path").agg(F.max(hit).alias("rank")))
    return best.join(names, "rank", "left").select("page_id", "host", "path", "rule", "action", "site")
