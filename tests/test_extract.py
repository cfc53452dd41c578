from docloom.operators.extract import extract_pages

PAGES = [
    (1, "http://a.org/1", "<title>One</title><script>x</script><article><p>a  b</p></article>"),
    (2, "http://a.org/2", "<title>Two</title><article>  \x1f\x85 </article>"),
    (3, "http://a.org/3", "<!-- <title>No</title> --><p>c</p><p>d"),
    (4, "http://a.org/4", None),
    (5, "http://a.org/5", "<title>Five</title><article>​</article>"),
    (6, "http://a.org/6", "<p>e</p><b cut"),
]


def test_boilerplate_is_looked_for_once_and_texts_are_normalised_once(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    plan = extract_pages(pages)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("<(script|style|noscript)") == 1
    assert plan.count(r"\n{3,}") == 1


def test_pages_without_content_are_dropped(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    rows = sorted(extract_pages(pages).collect())
    assert [tuple(r) for r in rows] == [
        (1, "http://a.org/1", "One", "a b"),
        (3, "http://a.org/3", "http://a.org/3", "c\n\nd"),
        (5, "http://a.org/5", "Five", "​"),
        (6, "http://a.org/6", "http://a.org/6", "e"),
    ]
