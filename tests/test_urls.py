import itertools
import re
from urllib.parse import urljoin, urlparse

from pyspark.sql import functions as F

from docloom.functions import urls as U

# Expected forms of URLs as a browser-like client writes them; other schemes give nothing.
NORMALIZED = {
    "HTTP://A.org/X#y": "http://A.org/X",
    "http://a.org/?": "http://a.org/",
    "//h.org/a#b": "https://h.org/a",
    "mailto:x@y": "",
    "javascript:void(0)": "",
    "ftp://q/z": "",
    "http://u@h:80/p": "http://u@h:80/p",
    "https://h/#a#b": "https://h/",
    "foo/bar": "https:foo/bar",
    "": "https://",
    "/root": "https:///root",
    "?q": "https://?q",
    "#f": "https://",
    "http:": "http://",
    "http:foo": "http:foo",
    "http:/foo": "http:///foo",
    "http:///foo": "http:///foo",
    "http:////foo": "http:////foo",
    "////foo": "https:////foo",
    "http://h/a;": "http://h/a",
    "http://h/a;p": "http://h/a;p",
    "http://h/a;?q": "http://h/a?q",
    "http://h;x/": "http://h;x/",
    "a;": "https:a",
    "  http://h/a ": "http://h/a ",
    "1http://x": "https:1http://x",
    "a:b": "",
    "http://h?x": "http://h?x",
    "http://h?": "http://h",
    "//": "https://",
    "///": "https:///",
    "https:////": "https:////",
    "http://h//a//b": "http://h//a//b",
    "/a;b/c;": "https:///a;b/c",
    "http://h/;": "http://h/",
    "http:;": "http://",
    "http://h/a;;": "http://h/a;;",
    "http://h/a;b;": "http://h/a;b;",
    "http://h/a;/b;": "http://h/a;/b",
    "http://h/é?ü=ö#x": "http://h/é?ü=ö",
    "http://h/a b": "http://h/a b",
}

BASES = ["http://h.org/a/b/c?q=1", "https://h.org", "http://h.org/", "http://h.org/a/b/", "http://h/a;p"]
HREFS = """../x|./y|z?q=1|#top|?p=2|//other.org/a|/root|http://o.org/a?b#c||.|..|../..|../../../../g
/./g|/../g|g.|..g|./../g|./g/.|g/./h|g/../h|g;x=1/../y|;x|g;x?y#s|mailto:a@b|http:rel|x//y
/x//y|a/b/../../c|?|#|/|//|g?y/./x|/a/.hidden|//o.org|https://o.org|../b c""".replace("\n", "|").split("|")


def test_normalize_url(spark):
    rows = spark.createDataFrame([(u,) for u in NORMALIZED], "u string")
    got = {r.u: r.n for r in rows.select("u", U.normalize_url(F.col("u")).alias("n")).collect()}
    assert got == NORMALIZED


def test_resolve_link_equals_stdlib(spark):
    pairs = list(itertools.product(BASES, HREFS))
    rows = spark.createDataFrame(pairs, "b string, h string")
    target = U.resolve_link(F.col("b"), F.col("h"))
    rows = rows.select("b", "h", target.alias("t"), U.normalize_url(target).alias("n"))
    wrong = [
        (r.b, r.h, r.t, urljoin(r.b, r.h))
        for r in rows.collect()
        if r.t != urljoin(r.b, r.h) or (r.n == "") != (urlparse(r.t).scheme not in ("http", "https"))
    ]
    assert wrong == []


def test_host_allowed(spark):
    cases = [
        ("http://example.com/", True),
        ("http://a.b.example.com/x", True),
        ("http://badexample.com/", False),
        ("http://EXAMPLE.com", True),
        ("http://example.com:80/", False),
        ("https:foo", False),
        ("http://com/", False),
    ]
    rows = spark.createDataFrame(cases, "u string, want boolean")
    ok = U.host_allowed(F.col("u"), F.array(F.lit("example.com")))
    assert rows.filter(ok != F.col("want")).count() == 0


def test_matches_rules(spark):
    cases = [("http://a/x/1", ["/x/"], ["/2"]), ("http://a/x/2", ["/x/"], ["/2"])]
    cases += [("http://a/y", ["/x/", "y$"], []), ("http://a/z", [], ["q", "z"]), ("http://a/", [], [])]
    cases += [("zbb", ["(a)x", "(b)\\1"], []), ("zbc", ["(a)x", "(b)\\1"], [])]
    rows = spark.createDataFrame(cases, "u string, inc array<string>, exc array<string>")
    ok = U.matches_rules(F.col("u"), F.col("inc"), F.col("exc"))
    found = [row.ok for row in rows.withColumn("ok", ok).collect()]
    assert found == [True, False, True, False, True, True, False]


def test_package_include_pattern(spark):
    cases = [
        ("https://x.readthedocs.io/en/latest/", "auto", "^https://x.readthedocs.io/en/latest/"),
        ("https://docs.x.org/a/b", "readthedocs", "^https://docs.x.org/a/b/"),
        ("https://github.com/o/r", "auto", "^https://github.com/"),
        ("https://x.org/a/", "github", "^https://x.org/"),
        ("https://x.org/a/b/", "auto", "^https://x.org/a/b/"),
        ("https://x.org", "auto", "^https://x.org/"),
        ("http://x.org/", "sphinx", "^https://x.org/"),
    ]
    rows = spark.createDataFrame(cases, "u string, t string, want string")
    made = U.package_include_pattern(F.col("u"), F.col("t"))
    fixed = U.package_include_pattern(F.col("u"), F.col("t"), repair=True)
    for row in rows.withColumn("made", made).withColumn("fixed", fixed).collect():
        assert row.made == row.want
        if row.t != "github" and "github.com" not in row.u:
            assert re.search(row.fixed, row.u), row
