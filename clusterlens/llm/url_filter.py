"""URL filters: pattern rules indexed by their rarest literal token; only candidate rules run regular expressions."""

from __future__ import annotations

from dataclasses import dataclass
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach

#: Index rows up to which the rule index is broadcast; a larger index is joined by a shuffle.
BROADCAST_RULES = 20_000

RULE_SCHEMA = "rule_id int, action string, label string, strength int, pattern string, token string"


@dataclass(frozen=True)
class UrlRule:
    """A host and path rule (``host/path``), or a general pattern over ``host`` + ``path`` with literal tokens."""
    action: str
    label: str
    pattern: str
    tokens: tuple[str, ...]
    strength: int


def host_rule(action: str, rule: str) -> UrlRule:
    """``example.org/es/``: the host and all its subdomains, paths that start with ``/es/``. The longest rule wins.

    Tokens that the url must hold whole are literal: the labels of the host, and path parts closed by a slash.
    """
    host, slash, rest = rule.partition("/")
    closed = rest.split("/")[:-1]
    return UrlRule(action, rule, f"^(?:[^/]*\\.)?{_quote(host)}{_quote(slash + rest)}",
                   tuple(t for t in [*re.split(r"[^a-z0-9]+", host), *_path_tokens(closed)] if t), len(rule))


def pattern_rule(action: str, label: str, pattern: str, tokens: tuple[str, ...]) -> UrlRule:
    """A general rule; ``tokens`` are whole alphanumeric runs that every matching url holds. Ranks below host rules."""
    if not tokens:
        raise ValueError(f"rule {label!r} needs a literal token")
    return UrlRule(action, label, pattern, tokens, 0)


def _path_tokens(parts):
    return [t for p in parts for t in re.split(r"[^a-z0-9]+", p) if p.islower() or p.isdigit()]


def _quote(s: str) -> str:
    return re.sub(r"([^A-Za-z0-9])", r"\\\1", s)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty without ``://`` or for null."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _tokens(host: Column, path: Column) -> Column:
    lower = F.translate(path, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_distinct(F.regexp_extract_all(F.concat(host, lower), F.lit("[a-z0-9]++"), F.lit(0)))


def rule_index(urls: DataFrame, rules: list[UrlRule]) -> DataFrame:
    """One index row per rule, under the literal token that the fewest urls hold (``urls`` has ``__tokens``)."""
    spark = urls.sparkSession
    wanted = sorted({t for r in rules for t in r.tokens})
    seen = (urls.select(F.explode("__tokens").alias("token")).filter(F.col("token").isin(wanted))
            .groupBy("token").count())
    df_of = {r["token"]: r["count"] for r in seen.collect()}  # at most one row for each rule token
    rows = [(i, r.action, r.label, r.strength, r.pattern, min(r.tokens, key=lambda t: (df_of.get(t, 0), t)))
            for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def filter_urls(df: DataFrame, rules: list[UrlRule], url_col: str = "url", default: str = "allow") -> DataFrame:
    """``df`` with ``host``, ``path``, ``rule`` and ``verdict``.

    The distinct urls are tokenised once; each token fetches the rules indexed under it, and only these run their
    regular expression on host + path. Of the fitting host rules the longest wins (ties: the smaller text), and its
    action is the verdict; ``rule`` names it. Without one, ``rule`` is null and the verdict is ``block`` if a general
    pattern that blocks fits, else ``allow`` for one that allows, else ``default``. Null urls and urls without ``://``
    have an empty host and path and get ``default``; rows are never dropped or merged, and input columns named like
    a result are replaced. An empty table gives an empty result.
    """
    urls = (df.select(F.col(f"`{url_col}`").alias("__url")).filter(F.contains(F.col("__url"), F.lit("://"))).distinct()
            .select("__url", host_of(F.col("__url")).alias("__host"), path_of(F.col("__url")).alias("__path"))
            .select("*", _tokens(F.col("__host"), F.col("__path")).alias("__tokens")))
    index = rule_index(urls, sorted(rules, key=lambda r: r.label))
    if len(rules) <= BROADCAST_RULES:
        index = F.broadcast(index)
    fits = (urls.select("__url", F.concat("__host", "__path").alias("__hp"), F.explode("__tokens").alias("token"))
            .join(index, "token").filter(F.expr("regexp(__hp, pattern)"))
            .groupBy("__url")
            .agg(F.max_by(F.struct("label", "action"),
                          F.when(F.col("strength") > 0, F.struct(F.col("strength"), -F.col("rule_id")))).alias("__host_rule"),
                 F.max(F.when((F.col("strength") == 0) & (F.col("action") == "block"), True)).alias("__blocked"),
                 F.max(F.when((F.col("strength") == 0) & (F.col("action") == "allow"), True)).alias("__allowed")))
    joined = (df.withColumn("__key", F.col(f"`{url_col}`"))
              .join(fits.withColumnRenamed("__url", "__key"), "__key", "left"))
    out = attach(joined, {
        "host": host_of(F.col("__key")), "path": path_of(F.col("__key")),
        "rule": F.col("__host_rule.label"),
        "verdict": F.when(F.col("__host_rule").isNotNull(), F.col("__host_rule.action"))
                    .when(F.col("__blocked"), F.lit("block")).when(F.col("__allowed"), F.lit("allow"))
                    .otherwise(F.lit(default))})
    return out.drop("__key", "__host_rule", "__blocked", "__allowed")


#: Fixed rules of the contract.
BASE_RULES = [host_rule("allow", "org/"), host_rule("block", "example.org/es/"), host_rule("block", "example.org/en/1"),
              host_rule("allow", "com/fr/"), host_rule("block", "com/de/")]

#: General rules: advertising and tracking hosts, gambling and adult hosts, log-in and cart pages.
GENERAL_RULES = [
    pattern_rule("block", "ad host", r"^(?:[^/]*[.-])?ads(?:[.-][^/]*)?(?:/|$)", ("ads",)),
    pattern_rule("block", "ad server", r"^(?:[^/]*[.-])?adserver(?:[.-][^/]*)?(?:/|$)", ("adserver",)),
    pattern_rule("block", "tracker", r"^(?:[^/]*[.-])?track(?:[.-][^/]*)?(?:/|$)", ("track",)),
    pattern_rule("block", "casino", r"^(?:[^/]*[.-])?casino(?:[.-][^/]*)?(?:/|$)", ("casino",)),
    pattern_rule("block", "porn", r"^(?:[^/]*[.-])?porn(?:[.-][^/]*)?(?:/|$)", ("porn",)),
    pattern_rule("block", "cart", r"/cart/(?:checkout|add)(?:/|$)", ("cart",)),
]
