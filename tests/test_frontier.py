from pyspark.sql import functions as F

from docloom.operators.assign import assign_sources
from docloom.operators.frontier import SHARDS, add_seen, crawl_frontier, seen_among
from docloom.operators.links import pending_links
from docloom.plans.local import local_table
from docloom.plans.scratch import materialize
from docloom.schemas import SOURCES
from docloom.sources.rules import read_seeds, read_sources, seed_rules, source_rules
from test_tables import files_read

SITE = {
    "/": ["/a", "b?x=1", "/a#top", "http://other.org/z", "mailto:x@y", "/missing"],
    "/a": ["/c", "/", "d/e", "/private/1"],
    "/b?x=1": ["/c", "/f", "//sub.h.org/s"],
    "/c": ["/g", "/a"],
    "/d/e": ["../f", "g", "./h"],
    "/f": ["/empty", "/deep/1"],
    "/g": [],
    "/d/g": ["/d/e"],
    "/deep/1": ["2"],
    "/deep/2": ["3", "/"],
    "/empty": ["/never"],
    "/never": [],
}


def pages(spark):
    rows = []
    for i, (path, links) in enumerate(SITE.items()):
        html = "" if path == "/empty" else "<p>t</p>" + "".join(f'<a href="{h}">x</a>' for h in links)
        rows.append((i, "http://h.org" + path, html))
    rows.append((99, "http://sub.h.org/s", '<p>s</p><a href="http://h.org/g">g</a>'))
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def sources(spark):
    rows = [
        ("site", ["http://h.org/", "http://h.org/#x", "http://h.org/g"], ["h.org"], [], ["/private/"], 50, 0),
        ("part", ["http://h.org/d/e"], ["h.org"], ["/d/"], None, 50, 1),
        ("small", ["http://h.org/"], ["h.org", "sub.h.org"], [], [], 4, 2),
        ("none", ["http://x.org/", "ftp://h.org/"], ["h.org"], [], [], 4, 3),
    ]
    made = [dict(zip(SOURCES.names, row)) for row in rows]
    return source_rules(local_table(spark, made, SOURCES))


HOME = "http://h.org"
SITE_VISITS = [HOME + p for p in ("/", "/g", "/a", "/b?x=1", "/missing", "/c", "/d/e", "/f")]
SITE_VISITS += ["http://sub.h.org/s"]
SITE_VISITS += [HOME + p for p in ("/d/g", "/d/h", "/empty", "/deep/1", "/deep/2", "/deep/3")]
SMALL_VISITS = [HOME + p for p in ("/", "/a", "/b?x=1", "/missing", "/c")]
VISITS = {
    "site": SITE_VISITS,
    "part": [HOME + p for p in ("/d/e", "/d/g", "/d/h")],
    "small": SMALL_VISITS[:4],
    "none": [],
}


def test_crawl_visits_in_queue_order(spark):
    rules = sources(spark)
    full = pages(spark).filter("html <> ''")
    limited = VISITS | {"site": SITE_VISITS[:5], "small": SMALL_VISITS}
    for limit, want in ((None, VISITS), (5, limited), (0, VISITS)):
        visits = crawl_frontier(full, rules, limit).collect()
        for name, urls in want.items():
            own = sorted((v for v in visits if v.source == name), key=lambda v: v.crawl_ord)
            assert [v.url for v in own] == urls, (name, limit)
            assert [v.crawl_ord for v in own] == list(range(1, len(own) + 1))


def test_visits_are_looked_up_in_their_shards(spark, folder):
    """Four links read four of the 64 shards at most, however many visits there are."""
    path = folder + "/seen"
    visits = spark.range(5000).select(F.lit("s").alias("source"), F.concat(F.lit("u"), "id").alias("url"))
    add_seen(visits, path)
    add_seen(spark.createDataFrame([("t", "u1"), ("t", "x")], "source string, url string"), path)
    rows = [("s", "u7", 1), ("s", "x", 2), ("t", "x", 3), ("t", "u7", 4)]
    found = materialize(spark.createDataFrame(rows, "source string, url string, pos int"), "found")
    assert {tuple(r) for r in seen_among(found, path).collect()} == {("s", "u7"), ("t", "x")}
    every = files_read(spark.read.parquet(path), "shard")
    assert 0 < files_read(seen_among(found, path), "shard") <= 2 * len(rows) < SHARDS <= every


def test_pending_links_and_assignment(spark):
    found = {(r.source, r.url) for r in pending_links(pages(spark), sources(spark)).collect()}
    assert ("site", "http://h.org/missing") in found
    assert ("site", "http://h.org/private/1") not in found
    assert ("small", "http://h.org/private/1") in found
    assert not any(u == "http://h.org/a" or "other" in u for _, u in found)
    pairs = assign_sources(pages(spark).select("page_id", "url"), sources(spark))
    assert pairs.filter("page_id = 99 and source = 'small'").count() == 1
    assert pairs.groupBy("page_id", "source").count().filter("count > 1").count() == 0


def test_rules_from_files(spark, folder):
    with open(f"{folder}/sources.json", "w") as out:
        out.write('[{"name": "a", "start_urls": ["u"], "allowed_domains": ["d"], "source_ord": 0}]')
    row = read_sources(spark, f"{folder}/sources.json").first()
    assert (row.include_patterns, row.exclude_patterns, row.max_pages) == ([], [], 5000)
    with open(f"{folder}/seeds.json", "w") as out:
        out.write('[{"name": "a", "doc_url": "https://d.org/x/"}]')
    row = seed_rules(read_seeds(spark, f"{folder}/seeds.json")).first()
    assert (row.allowed_domains, row.include_patterns, row.max_pages) == (["d.org"], ["^https://d.org/x/"], 1000)


def test_no_nested_loop_join(spark):
    text = assign_sources(pages(spark).select("url"), sources(spark))
    plan = text._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
