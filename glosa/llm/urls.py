"""URL filters (operator 3): pattern rules indexed by their rarest literal token.

A rule is an action, a regular expression over the address ``host + path +
rest`` (host in lower case, scheme dropped) and the literal tokens that every
matching address holds as whole tokens (runs of a-z and 0-9).  Each rule is
filed under the one of its tokens that is rarest among the addresses at hand;
an address's tokens fetch candidate rules by an equi-join, and only these run
their regular expression.  Rules without a literal token run on all addresses.
Of the rules that match, the one with the highest rank decides.

Rules are configuration; still, the index is broadcast only up to a checked
number of rules and joined by shuffle beyond it.

Defined results: a null url or one without ``://`` has an empty host and path
and holds no tokens (only rules without tokens are tried); repeated rows are
each judged; an empty table gives an empty result; no rule: ``default``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glosa.llm.common import broadcast_if_small, written

TOKEN = "[a-z0-9]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    name: str
    action: str
    pattern: str
    tokens: tuple[str, ...]
    rank: int
    listed: bool = False  # reported by name


def host_rule(action: str, spec: str) -> UrlRule:
    """``host/path``: fits the host and its subdomains where the path starts with the rule's."""
    host, _, path = spec.partition("/")
    escaped = "".join(f"\\{c}" if c in ".+*?^$()[]{}|\\" else c for c in f"{host}/{path}")
    words = host.split(".") + (path.split("/")[:-1] if path else [])  # the last may go on in the address
    tokens = tuple(w for w in words if w.isascii() and w.isalnum() and w == w.lower())
    return UrlRule(spec, action, rf"^(?:[^/?#]*\.)?{escaped}", tokens, 1_000_000 + len(spec), True)


#: Host and path rules of the given contract.
LISTED = (host_rule("block", "net/"), host_rule("allow", "example.net/en/"),
          host_rule("block", "example.com/de/"), host_rule("allow", "org/fr/"))
#: The method's own rules for addresses that no listed rule fits, later ones ranking higher.
OWN = (
    UrlRule("print-view", "block", r"[?&]print=", ("print",), 10),
    UrlRule("ads-path", "block", r"/ads/", ("ads",), 11),
    # an entry per alternative, so that each is filed under a token
    *(UrlRule(f"login-{w}", "block", rf"/{w}(?:[/?#.]|$)", (w,), 12) for w in ("login", "signin")),
    *(UrlRule(f"session-id-{w}", "block", rf"[?&;]{w}=", (w,), 13) for w in ("sid", "phpsessid", "jsessionid")),
    UrlRule("tracker-host", "block", r"^(?:[^/?#]*\.)?doubleclick\.net(?:[:/?#]|$)", ("doubleclick", "net"), 14),
    UrlRule("feed-tag", "block", r"[?&]utm_source=feed(?:[&#]|$)", ("utm", "source", "feed"), 15),
    UrlRule("feed-docs", "allow", r"/docs/[^?#]*\?(?:[^#]*&)?utm_source=feed(?:[&#]|$)", ("docs", "utm", "source", "feed"), 16),
)
DEFAULT = "allow"


def parts(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, rest) as columns; all empty for null or without ``://``."""
    after = F.when(F.locate("://", url) > 0, F.substr(url, F.locate("://", url) + F.lit(3))).otherwise(F.lit(""))
    host = F.regexp_extract(after, r"(?s)^([^/?#]*)", 1)
    tail = F.substr(after, F.length(host) + F.lit(1))
    path = F.regexp_extract(tail, r"(?s)^([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path, F.substr(tail, F.length(path) + F.lit(1))


def rule_table(spark: SparkSession, rules: tuple[UrlRule, ...]) -> DataFrame:
    return spark.createDataFrame([(r.name, r.action, r.pattern, list(r.tokens), r.rank, r.listed) for r in rules],
                                 "name string, action string, pattern string, tokens array<string>, rank long, listed boolean")


def indexed(rules: DataFrame, frequency: DataFrame) -> DataFrame:
    """Each rule filed under its rarest token (ties: the first in order)."""
    entries = rules.select("name", "action", "pattern", "rank", "listed", F.explode("tokens").alias("token"))
    best = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("token"))).alias("best")
    return entries.join(frequency, "token", "left").groupBy("name", "action", "pattern", "rank", "listed").agg(
        best).select("name", "action", "pattern", "rank", "listed", F.col("best.token").alias("token"))


def judge_urls(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules: tuple[UrlRule, ...] = LISTED + OWN,
               default: str = DEFAULT) -> DataFrame:
    """(page_id, host, path, rule, verdict), one row per input row."""
    spark = pages.sparkSession
    host, path, rest = parts(F.col(url))
    rows = pages.select(F.col(page_id).alias("page_id"), F.struct(host.alias("host"), path.alias("path"), rest.alias("rest")).alias("p"))
    address = F.concat("host", "path", "rest")
    # judged once per distinct address, then joined back to every row that holds it
    rows = rows.select("page_id", "p.*").withColumn("address", address)
    distinct = written(rows.select("address").distinct().withColumn(
        "tokens", F.array_distinct(F.regexp_extract_all(F.translate("address", UPPER, LOWER), F.lit(TOKEN), F.lit(0)))), "addresses")
    used = distinct.select(F.explode("tokens").alias("token"))
    table = rule_table(spark, rules)
    wanted = table.select(F.explode("tokens").alias("token")).distinct()
    frequency = used.join(broadcast_if_small(wanted), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    index = written(indexed(table, frequency), "url-rule-index")
    hits = distinct.select("address", F.explode("tokens").alias("token")).join(broadcast_if_small(index), "token").drop("token")
    always = F.array(*[F.struct(F.lit(r.name).alias("name"), F.lit(r.action).alias("action"), F.lit(r.pattern).alias("pattern"),
                                F.lit(r.rank).cast("long").alias("rank"), F.lit(r.listed).alias("listed")) for r in rules if not r.tokens])
    if any(not r.tokens for r in rules):
        hits = hits.unionByName(distinct.select("address", F.explode(always).alias("r")).select("address", "r.*"))
    fits = hits.where(F.regexp_like("address", F.col("pattern")))
    won = fits.groupBy("address").agg(F.max_by(F.struct("name", "action", "listed"), F.struct("rank", "name")).alias("w"))
    won = won.select(F.col("address").alias("__address"), "w")
    return rows.join(won, rows["address"] == won["__address"], "left").select(
        "page_id", "host", "path", F.when(F.col("w.listed"), F.col("w.name")).alias("rule"),
        F.coalesce("w.action", F.lit(default)).alias("verdict"))
