"""Page extraction: title, Markdown content and links."""

from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import markdown
from docloom.functions.html import bare_title, drop_boilerplate, link_hrefs
from docloom.functions.text import NOT_SPACE, normalize_text, title_or_url

# Executors get the helper with the task, so the package need not be installed there.
cloudpickle.register_pickle_by_value(markdown)


def main_content(html: Column) -> Column:
    """Markdown of the main content."""
    return normalize_text(raw_content(drop_boilerplate(html)))


def raw_content(bare: Column) -> Column:
    """Markdown of a page without boilerplate, as converted. Only this column crosses to Python,
    by Arrow.

    A page is a Python string only while it is converted, and texts go back to Arrow in pieces.
    """

    @F.arrow_udf("string")
    def convert(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pages in batches:
            for made in markdown.in_pieces(pages):
                yield pa.array(made, pa.string())

    # Marked so that a filter on the result is not pushed down as a second conversion.
    return convert.asNondeterministic()(bare)


def keep_nonempty(pages: DataFrame, raw: str | None = None) -> DataFrame:
    """Pages with content. Judged by the ``raw`` text, where given, the content is not made for the
    filter as well: it is empty if, and only if, that text is all white space."""
    return pages.filter(F.col("content") != "" if raw is None else F.col(raw).rlike(NOT_SPACE))


def extract_pages(pages: DataFrame, links: bool = False) -> DataFrame:
    """Replace ``html`` by title and content (and the raw links); empty pages are dropped.

    Boilerplate is looked for once, for title and content, and texts are normalised once.
    """
    kept = [c for c in pages.columns if c != "html"]
    made = [
        *kept,
        title_or_url(bare_title(F.col("_bare")), F.col("url")).alias("title"),
        raw_content(F.col("_bare")).alias("_raw"),
    ]
    if links:
        made.append(link_hrefs(F.col("html")).alias("links"))
    bare = pages.withColumn("_bare", drop_boilerplate(F.col("html")))
    full = keep_nonempty(bare.select(*made), "_raw")
    names = [*kept, "title", "content", *(["links"] if links else [])]
    return full.withColumn("content", normalize_text(F.col("_raw"))).select(*names)
