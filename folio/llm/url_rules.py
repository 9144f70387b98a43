"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression whose match must contain some literal tokens
(runs of a-z and 0-9 with no such character on either side). Every rule is
filed under that one of its tokens which the fewest urls have. A url's tokens
fetch candidate rules from this index and only those run their expressions;
rules without a token are candidates everywhere.

DataFrame operations only: tokens are split, exploded, joined and aggregated
in the JVM. The rules are driver-held parameters, so the index is as large as
the call's arguments and is broadcast up to ``MAX_BROADCAST_RULES``; beyond
that the join shuffles on tokens.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BROADCAST_RULES = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALLOW, BLOCK = "allow", "block"


class Rule(NamedTuple):
    """``pattern`` is searched in ``host + path`` (host lower-cased); ``tokens`` are literals of every match."""

    name: str
    pattern: str
    verdict: str
    tokens: tuple[str, ...]
    listed: bool  # a host and path rule; others are the method's own patterns


def literal(text: str) -> str:
    """``text`` as a regular expression of Java and RE2."""
    return re.sub(r"([^A-Za-z0-9_/\-])", r"\\\1", text)


def host_rule(host: str, path: str, verdict: str) -> Rule:
    """Fits the host and all its subdomains where the url's path begins with ``path``.

    Tokens that the end of ``path`` may cut short aren't used for the index.
    """
    host = host.translate(str.maketrans(UPPER, LOWER))
    tokens = re.findall(r"[a-z0-9]+", host)
    inner = path.translate(str.maketrans(UPPER, LOWER))
    tokens += [m.group() for m in re.finditer(r"[a-z0-9]+", inner) if m.end() < len(inner)]
    ends = "" if path.startswith("/") else "(?:/|$)" if not path else "(?!)"
    return Rule(host + path, rf"^(?:[^/]*\.)?{literal(host)}{literal(path)}{ends}", verdict, tuple(dict.fromkeys(tokens)), True)


def token_rule(token: str, verdict: str = BLOCK) -> Rule:
    """Fits a url with ``token`` as a whole token of its host or path."""
    return Rule(token, rf"(?i)(?:^|[^A-Za-z0-9]){literal(token)}(?:[^A-Za-z0-9]|$)", verdict, (token,), False)


def phrase_rule(name: str, pattern: str, tokens: Sequence[str] = (), verdict: str = BLOCK) -> Rule:
    return Rule(name, pattern, verdict, tuple(tokens), False)


#: Rules of the contract: (host, path) and verdict.
LISTED = [
    host_rule("com", "/", ALLOW),
    host_rule("example.com", "/en/", BLOCK),
    host_rule("www.example.com", "/en/", ALLOW),
    host_rule("net", "/es/", BLOCK),
    host_rule("net", "/fr/", BLOCK),
]

#: The method's own patterns, for urls that no listed rule fits: advertising, tracking, adult, gambling and spam pages.
PATTERNS = [token_rule(x) for x in ("adserver", "adservice", "doubleclick", "popunder", "porn", "xxx", "casino", "viagra", "warez", "torrent", "phishing", "malware")] + [
    phrase_rule("banner-ads", r"(?i)(?:^|[^a-z0-9])banners?/[^?#]*(?:^|[^a-z0-9])ads?(?:[^a-z0-9]|$)"),
    phrase_rule("login", r"(?i)/(?:wp-login\.php|wp-admin/)", ("wp",)),
    phrase_rule("cgi-tracker", r"(?i)/cgi-bin/[^/]*(?:track|click|redir)", ("cgi", "bin")),
]


def ascii_lower(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end (A-Z lower-cased), and from there up to ``?`` or ``#``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """Rules as rows, made of literals: number, name, pattern, verdict, listed, tokens."""
    rows = [F.struct(F.lit(i).alias("number"), F.lit(r.name).alias("name"), F.lit(r.pattern).alias("pattern"), F.lit(r.verdict).alias("verdict"), F.lit(r.listed).alias("listed"), F.array(*map(F.lit, r.tokens or ("",))).alias("tokens")) for i, r in enumerate(rules)]
    return spark.range(1).select(F.inline(F.array(*rows)))


def index_rules(tokens: DataFrame, rules: DataFrame) -> DataFrame:
    """``rules`` with the column ``token``: that of its tokens which the fewest urls have, by name where equal.

    ``tokens`` has the urls' tokens, one a row. They are counted over all
    urls, joined with the rules' tokens first: a row per rule token is left.
    """
    own = rules.select("number", F.explode("tokens").alias("token"))
    seen = tokens.join(F.broadcast(own.select("token").distinct()), "token").groupBy("token").agg(F.count(F.lit(1)).alias("urls"))
    rarest = own.join(seen, "token", "left").groupBy("number").agg(F.min_by("token", F.struct(F.coalesce("urls", F.lit(0)), "token")).alias("token"))
    return rules.join(rarest, "number").drop("tokens")


def judge(pages: DataFrame, rules: Sequence[Rule] = (*LISTED, *PATTERNS)) -> DataFrame:
    """A row per row of ``pages``: page_id, host, path, rule, verdict, pattern.

    ``rule`` is the longest listed rule that fits, else null; ``pattern`` the
    first of the method's own patterns (by name) where no listed rule fits,
    else null; ``verdict`` is the rule's, else the pattern's, else allow. Host
    and path are empty for a null url or one without ``://`` - which no listed
    rule fits. Repeated rows, null and repeated page_ids are judged each by
    itself; other columns are not read; no rows give no rows.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url"))
    urls = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string")).select("page_id", host.alias("host"), path.alias("path"))
    found = F.array_distinct(F.split(ascii_lower(F.concat("host", "path")), "[^a-z0-9]+"))
    table = rule_table(spark, rules)
    index = index_rules(urls.select(F.explode(found).alias("token")), table)
    if len(rules) <= MAX_BROADCAST_RULES:
        index = F.broadcast(index)
    # '' fetches the rules without a token and keeps urls without any candidate
    tokens = F.explode(F.array_union(F.array(F.lit("")), found))
    candidates = urls.withColumn("row", F.monotonically_increasing_id()).withColumn("token", tokens).join(index, "token", "left")
    fits = F.coalesce(F.expr("concat(host, path) rlike pattern"), F.lit(False))
    listed, other = fits & F.col("listed"), fits & ~F.col("listed")
    best = candidates.groupBy("row", "page_id", "host", "path").agg(
        F.max(F.when(listed, F.struct(F.length("name").alias("size"), "name", "verdict"))).alias("best"),
        F.min(F.when(other, F.struct("name", "verdict"))).alias("other"),
    )
    pattern = F.when(F.col("best").isNull(), F.col("other.name"))
    return best.select("page_id", "host", "path", F.col("best.name").alias("rule"), F.coalesce("best.verdict", "other.verdict", F.lit(ALLOW)).alias("verdict"), pattern.alias("pattern"))


def allowed(pages: DataFrame, rules: Sequence[Rule] = (*LISTED, *PATTERNS)) -> DataFrame:
    """The page_ids that ``judge`` allows."""
    return judge(pages, rules).where(F.col("verdict") == ALLOW).select("page_id")


#: DuckDB SQL of ``judge`` with the default rules, by trying every rule on every url.
JUDGE_SQL = """
WITH urls AS (
  SELECT row_number() OVER () AS row_nr, page_id,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)),
listed(host, path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
best AS (
  SELECT u.row_nr, arg_max(l.host || l.path, length(l.host || l.path)) AS rule, arg_max(l.verdict, length(l.host || l.path)) AS verdict
  FROM urls u JOIN listed l ON (u.host = l.host OR ends_with(u.host, '.' || l.host)) AND starts_with(u.path, l.path)
  GROUP BY u.row_nr),
own(name, pattern) AS (VALUES {patterns}),
other AS (
  SELECT u.row_nr, min(o.name) AS name FROM urls u JOIN own o ON regexp_matches(u.host || u.path, o.pattern) GROUP BY u.row_nr)
SELECT u.page_id, u.host, u.path, b.rule, coalesce(b.verdict, CASE WHEN o.name IS NOT NULL THEN 'block' END, 'allow') AS verdict,
  CASE WHEN b.rule IS NULL THEN o.name END AS pattern
FROM urls u LEFT JOIN best b USING (row_nr) LEFT JOIN other o USING (row_nr)
""".replace("{patterns}", ", ".join("('{}', '{}')".format(r.name, r.pattern.replace("'", "''")) for r in PATTERNS))
