"""Rules by host and path: the same pairs as trying every rule, from few candidates."""

import random
import re

from pyspark.sql import functions as F

from docloom.functions.urls import path_keys, pattern_key
from docloom.operators.assign import assign_sources, candidate_rules
from docloom.plans.local import local_table
from docloom.schemas import SOURCES
from docloom.sources.rules import seed_rules, source_rules


def table(spark, rules):
    rows = [
        {"name": n, "start_urls": [], "allowed_domains": d, "include_patterns": i, "exclude_patterns": e,
         "max_pages": None, "source_ord": o}
        for o, (n, d, i, e) in enumerate(rules)
    ]
    return source_rules(local_table(spark, rows, SOURCES))


def plain_pairs(urls, rules):
    out = set()
    for url in urls:
        host = re.match(r"[a-z]+://([^/?#]*)", url)[1].lower()
        for name, domains, include, exclude in rules:
            near = any(host == d or host.endswith("." + d) for d in domains)
            wanted = not include or any(re.search(p, url) for p in include)
            if near and wanted and not any(re.search(p, url) for p in exclude):
                out.add((url, name))
    return out


PATTERNS = [
    "^https://h.org/a/", r"^https://h\.org/a/b(/|$)", "^https://h.org/a/b", "^https://h.org/(a|b)/", "/b/",
    "^https://h.org/a/|/c/", "^https://h.org/a/*", "^https://h.org/a/b?/", r"^https?://h\.org/a", r"^http://h\.org(/|$)",
    "^https://h.org/", r"^https://h\.org/a\.b/", r"^https://h\.org/a\d/", "^https://h.org/a.b/c/", "^https://[a-z.]+/a/",
    r"^https://h\.org/a/\?q=/x/", "^https://h.orgs?/a/", "^https://h.org/a/{1,2}b/", "b$", r"^https://h\.org/a/b/c/d/e/f/g/h/i/j/",
    "^https://s.h.org/a/",
]


def test_pairs_equal_trying_every_rule(spark):
    source = random.Random(4)
    parts = ["a", "b", "c", "a.b", "axb", "a1", "", "?q=", "d/e/f/g/h/i/j"]
    hosts = ["h.org", "s.h.org", "H.org", "h.orgs", "hxorg"]
    urls = {
        f"{source.choice(['http', 'https'])}://{source.choice(hosts)}"
        + "".join("/" + source.choice(parts) for _ in range(source.randint(0, 5)))
        for _ in range(1500)
    }
    rules = [(f"r{i}", ["h.org"], [p], []) for i, p in enumerate(PATTERNS)]
    rules += [("two", ["h.org", "h.orgs"], ["^https://h.org/a/", "^https://h.org/a/b/", "^https://h.org/c/"], ["/c/"]),
              ("all", ["h.org"], [], ["b$"]), ("other", ["hxorg", "s.h.org"], ["^https://hxorg/a", "/b"], [])]
    pages = spark.createDataFrame([(u,) for u in urls], "url string")
    got = [(r.url, r.source) for r in assign_sources(pages, table(spark, rules)).collect()]
    assert len(got) == len(set(got))
    assert set(got) == plain_pairs(urls, rules)


def test_keys(spark):
    row = spark.range(1).select(
        path_keys(F.lit("https://h.org/a/b?x#y")).alias("deep"),
        path_keys(F.lit("https://h.org")).alias("bare"),
        *[pattern_key(F.lit(p), F.lit("h.org")).alias(f"p{i}") for i, p in enumerate(PATTERNS)],
    ).first()
    assert row.deep == ["", "/a", "/a/b?x#y"] and row.bare == [""]
    assert [row[f"p{i}"] for i in range(len(PATTERNS))] == [
        "/a", "/a/b", "/a", "", "", "", "", "/a", "", "", "", "/a.b", "", "", "", "/a/?q=/x", "", "", "",
        "/a/b/c/d/e/f/g/h", "",
    ]


def test_rows_follow_the_matches_on_a_host_with_many_rules(spark):
    """2,000 seeds of one host and 20,000 of its URLs: one candidate for each URL."""
    seeds = spark.range(2000).select(
        F.concat(F.lit("s"), "id").alias("name"),
        F.concat(F.lit("https://docs.hub.org/project"), "id", F.lit("/en/")).alias("doc_url"),
        F.lit("auto").alias("doc_type"),
        F.lit(None).cast("int").alias("max_pages"),
    )
    pages = spark.range(20_000).select(
        F.concat(F.lit("https://docs.hub.org/project"), F.col("id") % 2500, F.lit("/en/page"), "id").alias("url")
    )
    for repair in (False, True):
        rules = seed_rules(seeds, repair)
        assert candidate_rules(pages, rules).count() == 16_000
        assert assign_sources(pages, rules).count() == 16_000
