"""URL rules and a blocklist: a blocked Bloom filter passes possible hits on to an exact hash join."""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoglens.llm.bloom import BlockedBloom

#: (verdict, host/path) as the query fixes them.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The A-Z-lower-cased host after the first ``://`` and the path up to ``?`` or ``#``; else both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without a leading ``www.`` or ``m.`` and path without ``.html`` and closing slashes; null without a host."""
    site = F.regexp_replace(host, r"^(www|m)\.", "")
    return F.when(host != "", F.concat(site, F.regexp_replace(path, r"(\.html)?/*$", "")))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: len(r[1])):
        site, slash, rest = text.partition("/")
        fits = ((host == site) | host.endswith("." + site)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def with_parts(pages: DataFrame, id_col: str, url_col: str) -> DataFrame:
    narrow = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    host, path = host_and_path(F.col("url"))
    return narrow.select("page_id", host.alias("host"), path.alias("path")).withColumn("canonical", canonical(F.col("host"), F.col("path")))


def shared_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """A blocklist of the canonical URLs under which more than one page was fetched (column ``canonical``)."""
    p = with_parts(pages, id_col, url_col).where(F.col("canonical").isNotNull())
    return p.groupBy("canonical").agg(F.min("page_id").alias("a"), F.max("page_id").alias("b")).where("a < b").select("canonical")


def url_filter(
    pages: DataFrame,
    listed: DataFrame,
    rules: Sequence[tuple[str, str]] = RULES,
    id_col: str = "page_id",
    url_col: str = "url",
    max_blocks: int = 1 << 17,
) -> DataFrame:
    """``page_id, host, path, rule, verdict, canonical, listed`` for every page.

    A rule decides where one fits; elsewhere a page is blocked if its canonical URL is in ``listed`` (column
    ``canonical``, repeats allowed). Null URLs and such without ``://`` have empty host and path, fit no rule
    and are allowed. Repeated pages are judged alike; other columns are not read; an empty list blocks
    nothing, an empty table gives no rows.
    """
    listed = listed.select("canonical").where(F.col("canonical").isNotNull()).distinct()
    bloom = BlockedBloom.of(listed, "canonical", max_blocks)
    p = with_parts(pages, id_col, url_col)
    rule, says = rule_for(F.col("host"), F.col("path"), rules)
    p = p.select("*", rule.alias("rule"), says.alias("says"))
    p = p.withColumn("maybe", bloom.may_hold(F.when(F.col("rule").isNull(), F.col("canonical"))))
    passed = p.where(~F.col("maybe")).withColumn("listed", F.lit(False))
    sure = p.where("maybe").join(listed.withColumn("listed", F.lit(True)), "canonical", "left")
    verdict = F.coalesce("says", F.when(F.col("listed"), "block").otherwise("allow"))
    both = passed.unionByName(sure.withColumn("listed", F.coalesce("listed", F.lit(False))))
    return both.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "canonical", "listed")
