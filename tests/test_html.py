import html as stdlib_html

from pyspark.sql import functions as F

from docloom.functions import html as H
from docloom.functions.markdown import to_markdown
from docloom.operators.extract import main_content
from docloom.operators import extract
from docloom.sources.pages import admit_fetch

GOLDEN = [
    ("<h2>A  b</h2><p>c<b>d</b> e</p>", "## A b\n\nc**d** e"),
    ("<p>x <a href='/u' title='t'>y</a> <a href='z_1'>z_1</a></p>", 'x [y](/u "t") <z_1>'),
    ("<ul><li>a<ul><li>b</li></ul></li><li>c</ul>", "* a\n + b\n* c"),
    ("<ol start=3><li>a<li>b</ol>", "3. a\n4. b"),
    ("<p>one<br>two</p><hr><p><em>i</em> <code>a_b</code></p>", "one \ntwo\n\n---\n\n*i* `a_b`"),
    ("<pre>\nif x:\n    y  = 1\n</pre>", "```\nif x:\n y = 1\n\n```"),
    ("<blockquote><p>q</p><p>r</p></blockquote>", "> q\n>\n> r"),
    ("<p>a*b_c &amp; &lt;d&gt;</p>", r"a\*b\_c & <d>"),
    ("<img src=s alt=a><p>t", "![a](s)\n\nt"),
    (
        "<table><tr><th>a</th><th>b</th></tr><tr><td>1<td>2</table>",
        "| a | b |\n| --- | --- |\n| 1 | 2 |",
    ),
    ("<table><tr><td>1</td><td>2</td></tr></table>", "| | |\n| --- | --- |\n| 1 | 2 |"),
    ("<p><b>x<p>y</p>", "**x**\n\n**y**"),
    ("<div>a\r\n\r\n\r\n b</div>", "a\nb"),
    ("<body><p>out</p><article>in</article><main>first</main></body>", "first"),
    ("<article>one</article><article>two</article>", "one"),
    ("<div class='x content'>c</div><div id=content>d</div>", "d"),
    ("<p>cut <b>off</b> tag <a hr", "cut **off** tag"),
    ("<script>only</script>", ""),
    ("", ""),
    ("<title>t</title><nav>n</nav>", "n"),
]


def test_markdown(spark):
    rows = spark.createDataFrame([(page,) for page, _ in GOLDEN], "html string")
    made = rows.select("html", main_content(F.col("html")).alias("content")).collect()
    assert {r.html: r.content for r in made} == dict(GOLDEN)


def test_markdown_survives_depth():
    assert to_markdown("<div>" * 5000 + "x").strip() == "x"


def test_unescape(spark):
    texts = ["a &amp; b", "&copy &copyx &notit; &notin;", "&#65;&#x42; &#128512;", "&am &bogus; &", "x"]
    texts += ["&amp;lt;", "&eacute;&Eacute", "&middot;&quot;&nbsp;", "&#65 &#x41g"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.u for r in rows.select("t", H.unescape(F.col("t")).alias("u")).collect()}
    assert got == {t: stdlib_html.unescape(t) for t in texts}


def test_native_html_functions(spark):
    page = (
        "<head><!-- <title>no</title> --><title> A &amp; B\n</title><style>x</style></head>"
        "<script>var a='<a href=\"/s\">'; <!-- </script><p data-href='q' title=\"href='no'\">"
        "<a href='/1'>a</a><A class=\"c>d\" HREF=/2>b</A><a name=x>c</a><a href=''>d</a>"
        "<!-- <a href='/3'> --><noscript><a href=\"/4?a=1&amp;b=2\">e</a></noscript>"
        "<a title='href=/no' data-href=\"/no\" href=\"/5\">f</a><abbr href='/no'>"
    )
    row = spark.createDataFrame([(page,)], "h string").select(
        H.page_title(F.col("h")).alias("title"),
        H.link_hrefs(F.col("h")).alias("links"),
        H.drop_boilerplate(F.col("h")).alias("bare"),
    ).first()
    assert row.title == "A & B"
    assert row.links == ["/1", "/2", "/4?a=1&b=2", "/5"]
    assert "<style" not in row.bare and "<script" not in row.bare and "/4" not in row.bare


def test_extract_pages_drops_empty_and_fills_titles(spark):
    pages = spark.createDataFrame(
        [(1, "http://a/1", "<p>x"), (2, "http://a/2", "<script>y</script>"), (3, "http://a/3", "")],
        "page_id long, url string, html string",
    )
    rows = extract.extract_pages(pages, links=True).collect()
    assert [(r.page_id, r.title, r.content, r.links) for r in rows] == [(1, "http://a/1", "x", [])]


def test_admit_fetch(spark):
    log = [(200, "text/html; charset=utf-8", True), (404, "text/html", False), (200, "", False)]
    log += [(301, "text/html", False), (200, "application/pdf", False)]
    rows = spark.createDataFrame(log, "status int, content_type string, want boolean")
    assert [r.want for r in admit_fetch(rows).collect()] == [True]


def test_unescape_never_raises_and_equals_the_standard_library(spark):
    numbers = [*range(300), 0xD7FF, 0xD800, 0xDFFF, 0xFDD0, 0xFFFE, 0x10000, 0x1FFFE, 0x10FFFF]
    numbers += [0x110000, 99999999, 10**30]
    texts = [f"&#{n};" for n in numbers] + [f"&#x{n:X}" for n in numbers]
    texts += ["&#00000065;", "&#x00000041;b", "&#65x", "&#xg;", "&#;", "&#", "&", "a&b"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.u for r in rows.select("t", H.unescape(F.col("t")).alias("u")).collect()}
    assert got == {t: stdlib_html.unescape(t) for t in texts}


def test_links_behind_any_number_of_attributes(spark):
    many = " ".join(f'a{k}="v"' for k in range(700))
    pages = {
        f'<a {many} href="/x">': ["/x"],
        '<a data-href="/n" href=/y>t</a>': ["/y"],
        "<a title='href=\"z\"' href='/q'>": ["/q"],
        "<a x=1>no</a> href='/w'": [],
        '<A\nHREF = "/k&amp;l">': ["/k&l"],
        "<a/href=/s>": ["/s"],
        "<abbr href='/no'>": [],
        "<a " + "x" * 50_000 + " href=/long>": ["/long"],
    }
    rows = spark.createDataFrame([(p,) for p in pages], "h string")
    got = {r.h: r.l for r in rows.select("h", H.link_hrefs(F.col("h")).alias("l")).collect()}
    assert got == pages


def test_pages_are_converted_some_at_a_time(spark):
    import pyarrow as pa

    from docloom.functions.markdown import PIECE, in_pieces
    from docloom.operators.extract import main_content

    pages = [None if i == 7 else f"<main><p>page {i}</p></main>" for i in range(2 * PIECE + 1)]
    assert [len(made) for made in in_pieces(pa.array(pages))] == [PIECE, PIECE, 1]
    rows = spark.createDataFrame(list(enumerate(pages)), "n int, html string").coalesce(1)
    got = dict(rows.select("n", main_content(F.col("html"))).collect())
    assert got == {n: f"page {n}" if page else got[7] for n, page in enumerate(pages)}
