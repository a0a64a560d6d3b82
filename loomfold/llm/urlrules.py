"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression on host and path (joined), with the literal tokens (runs of a-z and
0-9) that every match contains as whole tokens. How often each of these tokens occurs among the
URLs is counted, and a rule is filed under its rarest one. Distinct URLs are split into tokens, the
tokens fetch candidate rules by an equi-join, and only those run their expression. Rules come as a
table (`rule_table`, or read by the caller) and are broadcast up to SMALL bytes; beyond that the
join shuffles, each token dealt to SALTS keys, so that a frequent token is not one task's work.

Defined cases: a null URL, or one without `://`, has an empty host and path, fits no rule and gets
the default; repeated rows and URLs are judged alike; of fitting host rules the longest wins, of
equally long ones the alphabetically first; any number of pattern rules blocks; an empty table has
no rows. A rule without tokens is a candidate for every URL.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfold.llm.common import pick

# Host rules (rule, verdict) and blocking pattern rules (wildcards on host and path).
HOST_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
PATTERN_RULES = tuple(
    "*.spam-farm.* *.cheap-pills.* *.free-casino.* *.malware.* *.phishing.* *.adserver.* *.online-poker.* *.sports-betting.* *.payday-loans.* *.torrents.* *.warez.* *.keygen.* *.clickbait.* *.doorway.* "
    "*/wp-login.php* */xmlrpc.php* */cgi-bin/* */adclick/* */affiliate/* */popunder/*".split()
)
DEFAULT = "allow"
SMALL = 16 << 20
SALTS = 16


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[\s\S]*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[\s\S]*?://[^/?#]*([^?#]*)", 1)


def host_rule(rule: str) -> tuple[str, list[str]]:
    """Pattern and whole tokens of a rule `host/path-prefix`."""
    name, slash, rest = rule.partition("/")
    prefix = slash + rest
    tokens = re.findall(r"[a-z0-9]+", name.lower()) + re.findall(r"[a-z0-9]+(?=[^a-zA-Z0-9])", prefix.lower())
    return rf"^([^/]*\.)?{re.escape(name)}{re.escape(prefix)}", tokens


def pattern_rule(pattern: str) -> tuple[str, list[str]]:
    """Pattern and whole tokens of a wildcard rule on host and path: `*` is any run of characters, and `*.` at the start any
    subdomain or none. A token is whole if neither a `*` nor the end of the rule cuts it off."""
    rest = pattern.removeprefix("*.")
    start = r"^([^/]*\.)?" if rest != pattern else "^"
    tokens = [m[0] for m in re.finditer(r"(?<![a-zA-Z0-9*])[a-z0-9]+(?=[^a-zA-Z0-9*])", rest)]
    return start + "[\\s\\S]*".join(re.escape(part) for part in rest.split("*")), tokens


def rule_table(spark: SparkSession, host_rules=HOST_RULES, pattern_rules=PATTERN_RULES) -> DataFrame:
    """rule (null for pattern rules), verdict, pattern, tokens."""
    rows = [(rule, verdict, *host_rule(rule)) for rule, verdict in host_rules]
    rows += [(None, "block", *pattern_rule(pattern)) for pattern in pattern_rules]
    return spark.createDataFrame(rows, "rule string, verdict string, pattern string, tokens array<string>")


def judged(pages: DataFrame, rules: DataFrame | None = None, page_id: str = "page_id", url: str = "url", small: int = SMALL) -> DataFrame:
    """For each page its id, host, path, rule (the longest that fits) and verdict. rules: as of rule_table; broadcast up to `small` bytes."""
    rules = rule_table(pages.sparkSession) if rules is None else rules
    narrow = pick(pages, page_id, url).select(F.col(page_id).alias("id"), F.col(url).alias("url"))
    urls = narrow.select("url").where("url is not null").distinct()
    subject = F.concat(host(F.col("url")), path(F.col("url")))
    parts = urls.select("url", subject.alias("subject")).where("subject != ''")
    letters = F.octet_length("pattern") + F.octet_length(F.coalesce("rule", F.lit(""))) + F.octet_length(F.array_join("tokens", ","))
    size, bare = rules.agg(F.coalesce(F.sum(letters), F.lit(0)), F.coalesce(F.max(F.size("tokens") == 0), F.lit(False))).first()
    broadcast = size <= small
    found = F.array_distinct(F.regexp_extract_all(F.lower("subject"), F.lit("([a-z0-9]+)"), F.lit(1)))
    found = F.array_union(found, F.array(F.lit(""))) if bare else found  # only rules without tokens need it
    tokens = parts.select("url", "subject", F.explode(found).alias("token"))

    own = rules.select("rule", "verdict", "pattern", F.explode(F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit("")))).alias("token"))
    listed = own.select("token").distinct()
    counted = tokens.select("token").join(F.broadcast(listed), "token", "left_semi") if broadcast else tokens.select("token")
    often = counted.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = own.join(often, "token", "left").groupBy("rule", "verdict", "pattern").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("t"))
    index = rarest.select("rule", "verdict", "pattern", F.col("t.token").alias("token"))

    if broadcast:
        near = tokens.join(F.broadcast(index), "token")
    else:  # tokens such as `com` are on very many URLs: each is dealt to SALTS keys
        salts = F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt")
        near = tokens.withColumn("salt", F.pmod(F.xxhash64("url"), F.lit(SALTS))).join(index.select("*", salts), ["token", "salt"])
    fits = near.where(F.expr("subject rlike pattern"))
    best = fits.groupBy("url").agg(
        F.min(F.when(F.col("rule").isNotNull(), F.struct((-F.length("rule")).alias("size"), "rule", "verdict"))).alias("best"),
        F.max(F.when(F.col("rule").isNull(), F.col("verdict"))).alias("pattern_verdict"),  # block above allow
    )
    verdict = F.coalesce("best.verdict", "pattern_verdict", F.lit(DEFAULT))
    return narrow.join(best, "url", "left").select(F.col("id").alias(page_id), host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), F.col("best.rule").alias("rule"), verdict.alias("verdict"))


_FITS = " or ".join
_RULES_SQL = ", ".join(f"('{rule}', '{verdict}', '{rule.partition('/')[0]}', '/{rule.partition('/')[2]}')" for rule, verdict in HOST_RULES)
_PATTERNS_SQL = _FITS(f"regexp_matches(host || path, '{pattern_rule(pattern)[0]}')" for pattern in PATTERN_RULES)
ORACLE_SQL = rf"""
with split as (
  select page_id, url,
    translate(regexp_extract(coalesce(url, ''), '^[\s\S]*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(url, ''), '^[\s\S]*?://[^/?#]*([^?#]*)', 1) as path
  from pages),
rules(rule, verdict, rule_host, rule_path) as (values {_RULES_SQL})
select page_id, host, path, r.rule as rule,
  coalesce(r.verdict, case when {_PATTERNS_SQL} then 'block' else '{DEFAULT}' end) as verdict
from split left join lateral (
  select rule, verdict from rules
  where (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
  order by length(rule) desc, rule limit 1) r on true
"""
