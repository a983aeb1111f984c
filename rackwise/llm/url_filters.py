"""URL filter: hashed host-suffix and path-prefix expressions, joined with hashed rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rackwise.llm.common import any_names, without

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


@any_names("url")
def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", prefix_digits: int = 8) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to every row of ``pages``.

    ``rules`` has ``host``, ``path`` and ``verdict``. A rule fits its host and all subdomains, if the
    path starts with the rule's. The longest rule (host and path together) wins, then the longer
    host, then the verdict that sorts last. ``rule`` is the winner's host and path; without one it is
    null and the verdict is ``default``.

    Each distinct URL is expanded into the expressions that some rule's shape allows: the last *k*
    labels of its host and the first *n* characters of its path, for every *k* and *n* that occur in
    the rules. They meet the rules on the first ``prefix_digits`` hex digits of their SHA-256; then
    the full digests must be equal. URLs are judged once each, so a page that occurs very often costs
    one row; the verdicts go back to the pages by a join that Spark can split at a hot URL.

    A null URL, or one without ``://``, has an empty host and path. Rules with a null host, path or
    verdict fit nothing; repeated rules change nothing. No rules: every verdict is ``default``. No
    pages: no rows. Columns of ``pages`` with the added names are replaced, all others kept.
    """
    listed = rules.select("host", "path", "verdict").dropna().select(
        F.translate("host", UPPER, LOWER).alias("_rule_host"), F.col("path").alias("_rule_path"), "verdict")
    # Shapes, not rules: how many labels and how many characters occur, at most a few hundred each.
    labels = sorted(r[0] for r in listed.select(F.size(F.split("_rule_host", r"\."))).distinct().collect())
    lengths = sorted(r[0] for r in listed.select(F.length("_rule_path")).distinct().collect())
    listed = listed.withColumn("_rule", F.concat("_rule_host", "_rule_path")).withColumn("_digest", F.sha2("_rule", 256))

    parts = (
        pages.select(F.col(url).cast("string").alias("_url")).where(F.col("_url").isNotNull()).distinct()
        .select("_url", url_host(F.col("_url")).alias("_host"), url_path(F.col("_url")).alias("_path"))
        .withColumn("_labels", F.split("_host", r"\."))
    )
    suffixes = F.array_compact(F.array(*[
        F.when(F.size("_labels") >= k, F.array_join(F.slice("_labels", -k, k), ".")) for k in labels
    ])) if labels else F.array().cast("array<string>")
    prefixes = F.array_compact(F.array(*[
        F.when(F.length("_path") >= n, F.substring("_path", 1, n)) for n in lengths
    ])) if lengths else F.array().cast("array<string>")
    expressions = (
        parts.select("_url", F.explode(suffixes).alias("_suffix"), prefixes.alias("_prefixes"))
        .select("_url", "_suffix", F.explode("_prefixes").alias("_prefix"))
        .select("_url", F.sha2(F.concat("_suffix", "_prefix"), 256).alias("_digest"))
    )
    short = F.substring("_digest", 1, prefix_digits).alias("_short")
    hits = (
        expressions.select("_url", F.col("_digest").alias("_of_url"), short)
        .join(listed.select("*", short), "_short")
        .where(F.col("_of_url") == F.col("_digest"))
    )
    order = F.struct(F.length("_rule"), F.length("_rule_host"), F.col("verdict"), F.col("_rule"))
    best = hits.groupBy("_url").agg(F.max(order).alias("_best")).select(
        "_url", F.col("_best._rule").alias("rule"), F.col("_best.verdict").alias("verdict"))

    kept = without(pages, ["host", "path", "rule", "verdict"]) if url.lower() not in ("host", "path") else pages.drop("rule", "verdict")
    return (
        kept.withColumn("_url", F.col(url).cast("string")).join(best, "_url", "left")
        .withColumn("host", url_host(F.col("_url"))).withColumn("path", url_path(F.col("_url")))
        .withColumn("verdict", F.coalesce("verdict", F.lit(default)))
        .select(*[c for c in kept.columns if c.lower() not in ("host", "path")], "host", "path", "rule", "verdict")
    )
