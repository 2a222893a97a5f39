"""URL filters: pattern rules indexed by their rarest literal token.

A rule is either a *site rule* (``example.com/en/``: a host with its subdomains and a path prefix) or a *pattern*
(``^`` is any separator or an end, ``*`` is any run of characters, matched anywhere in host and path, lower-cased).
Every rule becomes one regular expression over ``host || path``. A literal token of a rule that must stand between
separators in any matching url is a safe index token; the one that is rarest among all urls is chosen. Urls are cut
into tokens once, tokens fetch candidate rules by an equi-join, and only candidates run their expression. Rules
without a safe token (``*casino*``) are few by nature and are tried on every distinct url.

Defined cases: a null url or one without ``://`` has empty host and path, so no site rule can fit it; equal urls are
judged once; an empty rule table leaves the default verdict everywhere; an empty table of urls gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ALLOW, BLOCK = "allow", "block"

# The site rules of the url query.
SITE_RULES = (
    ("com/", ALLOW),
    ("example.com/en/", BLOCK),
    ("www.example.com/en/", ALLOW),
    ("net/es/", BLOCK),
    ("net/fr/", BLOCK),
)

# The method's own patterns for urls that no site rule fits.
PATTERNS = (
    ("^casino^", BLOCK), ("^poker^", BLOCK), ("^pills^", BLOCK), ("^viagra^", BLOCK), ("^porn^", BLOCK),
    ("^xxx^", BLOCK), ("^torrent^", BLOCK), ("^warez^", BLOCK), ("^login^", BLOCK), ("^cart^", BLOCK),
    ("^checkout^", BLOCK), (".exe^", BLOCK), (".zip^", BLOCK),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(text, _UPPER, _LOWER)


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, site_rules: Iterable[tuple[str, str]] = SITE_RULES,
               patterns: Iterable[tuple[str, str]] = PATTERNS) -> DataFrame:
    """(rule, action, site) from two lists; larger lists may come as a table of these columns."""
    rows = [(r, a, True) for r, a in site_rules] + [(p, a, False) for p, a in patterns]
    return spark.createDataFrame(rows, "rule string, action string, site boolean")


def compiled_rules(rules: DataFrame) -> DataFrame:
    """Adds ``regex`` over host || path and ``tokens``, the literal tokens any matching url must hold whole."""
    escaped = F.regexp_replace("rule", r"([\\\[\](){}.+?$|#\-])", r"\\$1")
    site = F.concat(F.lit(r"\A(?:[^/]*\.)?"), F.regexp_replace(escaped, r"([*^])", r"\\$1"))
    inner = F.regexp_replace(escaped, r"\A\*+|\*+\z", "")  # a star at either end says nothing to a search
    loose = F.regexp_replace(F.regexp_replace(inner, r"\*+", "(?s:.*)"), r"\^", r"(?:[^a-z0-9]|\\A|\\z)")
    # A run of letters and digits is a whole token of the url only between separators; a site rule begins at one.
    bounded = F.when(F.col("site"), F.concat(F.lit("^"), ascii_lower(F.col("rule")))).otherwise(F.col("rule"))
    tokens = F.array_distinct(F.regexp_extract_all(
        bounded, F.lit(r"(?<=[^a-z0-9*])([a-z0-9]+)(?=[^a-z0-9*])"), 1))
    return rules.select("rule", "action", "site", F.when(F.col("site"), site).otherwise(loose).alias("regex"),
                        tokens.alias("tokens"))


def judged_urls(urls: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """One row per distinct url that some rule fits: (url, best), best a struct of the winning rule.

    A site rule beats a pattern, then the longer rule wins, then a block, then the greater rule string.
    """
    known = compiled_rules(rules)
    distinct = urls.select(F.col(url_col).alias("_url")).where(F.col("_url").isNotNull()).distinct()
    parts = distinct.withColumn("_place", F.concat(url_host(F.col("_url")), url_path(F.col("_url")))) \
        .withColumn("_lower", ascii_lower(F.col("_place")))
    tokened = parts.withColumn("_token", F.explode(F.array_distinct(F.concat(
        F.regexp_extract_all("_lower", F.lit(r"[a-z0-9]+"), 0), F.array(F.lit(""))))))
    rule_tokens = known.select("rule", F.explode(
        F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit("")))).alias("_token"))
    counts = tokened.join(rule_tokens.select("_token").distinct(), "_token").groupBy("_token").agg(
        F.count(F.lit(1)).alias("_urls"))
    rarest = rule_tokens.join(counts, "_token", "left").groupBy("rule").agg(
        F.min(F.struct(F.coalesce("_urls", F.lit(0)).alias("n"), F.col("_token").alias("t"))).alias("_rarest"))
    indexed = known.join(rarest, "rule").select("rule", "action", "site", "regex", F.col("_rarest.t").alias("_token"))
    hits = tokened.join(indexed, "_token").where(F.expr("if(site, _place, _lower) rlike regex"))
    order = F.struct("site", F.length("rule").alias("n"), (F.col("action") == BLOCK).alias("b"), F.col("rule"))
    return hits.groupBy("_url").agg(F.max_by(F.struct("rule", "action", "site"), order).alias("_best"))


def filter_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = ALLOW) -> DataFrame:
    """All rows and columns of ``pages`` plus host, path, rule, verdict and pattern, which replace columns so named.

    ``rule`` is the winning site rule, ``pattern`` the winning pattern where no site rule fits.
    """
    best = judged_urls(pages, rules, url_col)
    own = {"host", "path", "rule", "verdict", "pattern", "_url", "_best"}
    kept = [c for c in pages.columns if c.lower() not in own and c != url_col]
    url = F.col("_url")
    return pages.select(F.col(url_col).alias("_url"), *(F.col(f"`{c}`") for c in kept)) \
        .join(best, "_url", "left").select(
            *(F.col(f"`{c}`") for c in kept), url.alias(url_col), url_host(url).alias("host"),
            url_path(url).alias("path"), F.when(F.col("_best.site"), F.col("_best.rule")).alias("rule"),
            F.coalesce("_best.action", F.lit(default)).alias("verdict"),
            F.when(~F.col("_best.site"), F.col("_best.rule")).alias("pattern"))
