"""Which sources a URL belongs to, as an equi-join on host and path beginning."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.urls import (
    authority, host_allowed, host_suffixes, matches_rules, path_keys, pattern_key,
)

RULE_COLUMNS = ("source", "source_ord", "_include", "_exclude")


def domain_rules(sources: DataFrame) -> DataFrame:
    """One row per (source, domain) with its patterns; without ``source_ord`` all are equal.

    A domain that lies below another one of the same source is left out: it adds nothing,
    and without it a page meets each source at most once, so no distinct is needed later.
    """
    domains = F.array_distinct("allowed_domains")
    top = F.filter(
        domains,
        lambda d: ~F.exists(domains, lambda other: d.endswith(F.concat(F.lit("."), other))),
    )
    return sources.select(
        F.col("name").alias("source"),
        source_order(sources).alias("source_ord"),
        *_patterns(),
        F.explode(top).alias("_domain"),
    )


def source_order(sources: DataFrame):
    """``source_ord``; rules that have none come first and are told apart by name."""
    if "source_ord" not in sources.columns:
        return F.lit(0)
    return F.coalesce("source_ord", F.lit(0))


def _patterns():
    none = F.array().cast("array<string>")
    return [
        F.coalesce("include_patterns", none).alias("_include"),
        F.coalesce("exclude_patterns", none).alias("_exclude"),
    ]


def keep_own(rows: DataFrame, sources: DataFrame, url: str = "url") -> DataFrame:
    """Rows (source, url, ...) whose URL their own source covers: one join by source name."""
    rules = sources.select(
        F.col("name").alias("source"), F.col("allowed_domains").alias("_domains"), *_patterns()
    )
    fits = host_allowed(F.col(url), F.col("_domains")) & matches_rules(
        F.col(url), F.col("_include"), F.col("_exclude")
    )
    return rows.join(rules, "source").filter(fits).drop("_domains", "_include", "_exclude")


def rule_keys(by_host: DataFrame) -> DataFrame:
    """Rules of a host by what their URLs' paths must begin with; '' where a rule does not say.

    Of one rule's keys those that begin with another one are left out, so a URL meets a rule once.
    """
    keys = F.array_distinct(F.transform("_include", lambda p: pattern_key(p, F.col("_domain"))))
    open_ = (F.size("_include") == 0) | (F.col("_host") != F.col("_domain"))
    keys = F.when(open_, F.array(F.lit(""))).otherwise(keys)
    keyed = by_host.withColumn("_keys", keys)
    least = F.filter(
        "_keys",
        lambda k: ~F.exists(
            "_keys", lambda o: (o != k) & ((o == "") | k.startswith(F.concat(o, F.lit("/"))))
        ),
    )
    return keyed.withColumn("_key", F.explode(least)).drop("_keys", "_domain")


def candidate_rules(pages: DataFrame, sources: DataFrame, url: str = "url") -> DataFrame:
    """Rows with each rule whose host and path beginning fit, ahead of the regular expressions.

    Rules are first matched with the distinct hosts, through the suffixes of each host. Rows then
    meet the rules of their host on the path, cut at its slashes: a host may have any number
    of rules for its sub-paths, and a row meets those of its own path only. Rows are repeated for
    the few cuts of a path, so they should be narrow.
    """
    hosts = pages.select(F.lower(authority(F.col(url))).alias("_host")).distinct()
    suffixes = hosts.select("_host", F.explode(host_suffixes(F.col("_host"))).alias("_domain"))
    rules = rule_keys(suffixes.join(domain_rules(sources), "_domain"))
    tagged = pages.withColumn("_host", F.lower(authority(F.col(url))))
    tagged = tagged.withColumn("_key", F.explode(path_keys(F.col(url))))
    return tagged.join(rules, ["_host", "_key"]).drop("_host", "_key")


def assign_sources(pages: DataFrame, sources: DataFrame, url: str = "url") -> DataFrame:
    """All (row, source) pairs whose host and patterns fit; adds source and source_ord."""
    fits = matches_rules(F.col(url), F.col("_include"), F.col("_exclude"))
    return candidate_rules(pages, sources, url).filter(fits).drop("_include", "_exclude")
