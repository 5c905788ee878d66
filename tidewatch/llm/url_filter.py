"""URL rules found through their rarest literal token.

Every rule names literal tokens that each URL it fits must contain. Counting the tokens of all URLs tells which of a
rule's literals is rarest; the index holds the rule under that one. A URL's tokens then fetch candidate rules by a hash
join, and only those run their regular expression. Distinct URLs are judged once, so a URL that many pages share costs
one row. Everything is a DataFrame expression.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import UPPER, ascii_lower, table

#: Up to so many rules, the index is sent to every executor; larger ones are joined by a shuffle, with the same result.
BROADCAST_RULES = 20_000
#: There, a token that is more than one in ``HOT_SHARE`` of all (so at most ``HOT_SHARE`` tokens) is dealt over ``SALTS`` tasks.
HOT_SHARE = 1_000
SALTS = 64
RULE_SCHEMA = "rule_no int, name string, pattern string, rule_verdict string, site boolean, tokens array<string>"


@dataclass(frozen=True)
class Rule:
    """``pattern`` runs on host and path if ``site``, else on the lower-cased URL; ``tokens`` must all occur in it."""

    name: str
    pattern: str
    verdict: str
    tokens: tuple[str, ...]
    site: bool = False


def site_rule(verdict: str, host: str, path: str) -> Rule:
    """Fits a host and its subdomains where the path starts with ``path``."""
    whole = [w for w in re.findall(r"[A-Za-z0-9]+(?=[^A-Za-z0-9])", path)]
    return Rule(
        host + path,
        r"(?s)^(?:[^/]*\.)?" + re.escape(host) + re.escape(path),
        verdict,
        tuple(dict.fromkeys(re.findall(r"[a-z0-9]+", host) + whole)),
        True,
    )


def word_rule(*words: str) -> Rule:
    """Blocks URLs in which the words stand one after the other between other characters."""
    return Rule(
        "-".join(words),
        r"(?:^|[^a-z0-9])" + "[^a-z0-9]".join(words) + r"(?:[^a-z0-9]|$)",
        "block",
        tuple(words),
    )


#: Fixed values of the contract.
SITE_RULES = (
    site_rule("allow", "org", "/"),
    site_rule("block", "example.org", "/es/"),
    site_rule("block", "example.org", "/en/1"),
    site_rule("allow", "com", "/fr/"),
    site_rule("block", "com", "/de/"),
)
#: What the method blocks where no site rule fits.
WORD_RULES = tuple(
    word_rule(*x.split())
    for x in (
        "cheap pills", "buy pills", "online pharmacy", "viagra", "cialis", "casino", "online poker", "sports betting",
        "payday loan", "free money", "adult", "porn", "xxx", "escort", "torrent", "warez", "keygen", "crack download",
        "phishing", "malware", "doubleclick", "adserver", "click tracker", "affiliate redirect", "wp login",
        "cart checkout", "session id", "phpsessid", "calendar feed", "mailto",
    )
)


def split_url(url):
    """(host, path) of a URL column: host after the first ``://``, A-Z lower-cased; both empty without one or if null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"(?s)^[^?#]*", 0)
    return ascii_lower(host), path


def _rule_table(spark: SparkSession, rules, broadcast_rules: int) -> DataFrame:
    if any(not r.tokens for r in rules):
        raise ValueError("every rule needs a literal token")
    if len(rules) > broadcast_rules:
        return spark.createDataFrame([(i, r.name, r.pattern, r.verdict, r.site, list(r.tokens)) for i, r in enumerate(rules)], RULE_SCHEMA)
    rows = [
        F.struct(
            F.lit(i).alias("rule_no"), F.lit(r.name).alias("name"), F.lit(r.pattern).alias("pattern"), F.lit(r.verdict).alias("rule_verdict"),
            F.lit(r.site).alias("site"), F.array(*[F.lit(t) for t in r.tokens]).alias("tokens"),
        )
        for i, r in enumerate(rules)
    ]
    return spark.range(1, numPartitions=1).select(F.inline(F.array(*rows)))


def _rarest(rule_table: DataFrame, tokens: DataFrame, counts: DataFrame | None) -> DataFrame:
    """The rules, each under its rarest literal. ``counts`` of all tokens, if there, stand for those of the literals only."""
    literals = rule_table.select("rule_no", F.explode("tokens").alias("token"))
    few = counts is None
    seen = tokens.join(F.broadcast(literals.select("token").distinct()), "token", "left_semi").groupBy("token").count() if few else counts
    rarest = (
        literals.join(F.broadcast(seen) if few else seen, "token", "left")
        .groupBy("rule_no")
        .agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), F.col("token").alias("token"))).alias("least"))
        .select("rule_no", F.col("least.token").alias("token"))
    )
    return rule_table.drop("tokens").join(F.broadcast(rarest) if few else rarest, "rule_no")


def _salted(urls: DataFrame, index: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of the join with a ``_salt``: URLs of a hot token go to one of its tasks, its rules to all."""
    total = counts.agg(F.sum("count").alias("_total"))
    hot = counts.join(F.broadcast(total), F.col("count") * HOT_SHARE > F.col("_total")).select(F.col("token").alias("_hot"))
    mark = lambda df: df.join(F.broadcast(hot), F.col("token") == F.col("_hot"), "left")
    salt = F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64("_url"), F.lit(SALTS)).cast("int")).otherwise(0)
    salts = F.when(F.col("_hot").isNotNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return mark(urls).withColumn("_salt", salt).drop("_hot"), mark(index).withColumn("_salt", F.explode(salts)).drop("_hot")


def judge_urls(pages: DataFrame, rules, url_col: str = "url", default: str = "allow", broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    Of fitting site rules the longest name wins, then the name first in order; a site rule beats any other. Without one,
    any other rule that fits gives the verdict and ``rule`` is null; else ``default``. Null URLs, and those without
    ``://``, have an empty host and path, which no site rule fits. Repeated rows each come back; columns of ``pages`` called like
    the new ones are replaced. Any number of rules is taken; beyond ``broadcast_rules`` their index is joined by a shuffle.
    """
    spark = pages.sparkSession
    pages = pages.drop("host", "path", "rule", "verdict")
    rule_table = _rule_table(spark, rules, broadcast_rules)
    urls = pages.select(F.col(url_col).alias("_url")).where("_url IS NOT NULL").distinct()
    host, path = split_url(F.col("_url"))
    parts = urls.select("_url", ascii_lower(F.col("_url")).alias("_low"), host.alias("_host"), path.alias("_path")).withColumn(
        "_tokens",
        F.array_distinct(F.split(F.concat_ws(" ", "_host", "_path", "_low"), "[^A-Za-z0-9]+")),
    )
    tokens = parts.select(F.explode("_tokens").alias("token"))
    by_token = parts.select("_url", "_low", F.concat("_host", "_path").alias("_address"), F.explode("_tokens").alias("token"))
    if len(rules) <= broadcast_rules:
        candidates = by_token.join(F.broadcast(_rarest(rule_table, tokens, None)), "token")
    else:
        counts = tokens.groupBy("token").count()
        candidates, index = _salted(by_token, _rarest(rule_table, tokens, counts), counts)
        candidates = candidates.join(index, ["token", "_salt"])
    fitting = (
        candidates
        .where(F.regexp_like(F.when(F.col("site"), F.col("_address")).otherwise(F.col("_low")), F.col("pattern")))
        .groupBy("_url")
        .agg(
            F.max(F.struct(F.col("site").alias("site"), F.length("name").alias("size"), (-F.col("rule_no")).alias("at"), F.col("name").alias("name"), F.col("rule_verdict").alias("verdict"))).alias("_best")
        )
    )
    own_host, own_path = split_url(F.col(url_col))
    return pages.join(fitting, F.col(url_col) == F.col("_url"), "left").select(
        *[pages[c] for c in pages.columns],
        own_host.alias("host"),
        own_path.alias("path"),
        F.when(F.col("_best.site"), F.col("_best.name")).alias("rule"),
        F.coalesce("_best.verdict", F.lit(default)).alias("verdict"),
    )


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, SITE_RULES + WORD_RULES).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    longest_first = sorted(SITE_RULES, key=lambda r: -len(r.name))
    quoted = {r: r.pattern.replace("'", "''") for r in SITE_RULES + WORD_RULES}
    case = " ".join(f"WHEN regexp_matches(host || path, '{quoted[r]}') THEN '{r.name}'" for r in longest_first)
    verdict = " ".join(f"WHEN '{r.name}' THEN '{r.verdict}'" for r in longest_first)
    words = " OR ".join(f"regexp_matches(low, '{quoted[r]}')" for r in WORD_RULES)
    return f"""
WITH a AS (SELECT page_id, url, translate(url, '{UPPER}', '{UPPER.lower()}') AS low,
  coalesce(CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END, '') AS rest FROM pages),
b AS (SELECT page_id, low, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM a),
c AS (SELECT page_id, low, translate(raw, '{UPPER}', '{UPPER.lower()}') AS host,
  regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM b),
d AS (SELECT page_id, low, host, path, CASE {case} END AS rule FROM c)
SELECT page_id, host, path, rule,
  CASE rule {verdict} ELSE CASE WHEN {words} THEN 'block' ELSE 'allow' END END AS verdict FROM d
"""


OP3_SQL = _sql()
