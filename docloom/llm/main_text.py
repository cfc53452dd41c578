"""Main text of web pages by line-block distribution.

Markup is stripped to one line for each block element, a removed part (menu, advert, form ...)
leaving empty lines. Text lengths, without link text, are summed over a sliding window of
lines; a region goes from a surge, where the sums leave zero, to the dive where they return
to it. The main text lies between the first surge and the last dive of the regions that belong to
it, and everything between them is kept, short and linked lines too. An article or main element
bounds the lines that are looked at.
"""

import html
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import slices, texts

#: Lines in a window; a removed part leaves as many empty ones.
WINDOW = 3
#: Share of the highest sum at which a region belongs to the text by itself. Smaller ones do with
#: a heading, with a sentence of their own, or between two others.
NEAR = 0.25
SENTENCE = re.compile(r"\S\s.*[.!?…:;][\"'”’»)\]]*$")

#: Element names by role.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg"}
DROPPED = {
    "nav", "header", "footer", "aside", "form", "button", "select", "dialog", "menu", "head",
    "canvas", "audio", "video", "annotation", "annotation-xml",
}
INLINE = {
    "a", "abbr", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em",
    "font", "i", "img", "input", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s",
    "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
    "td", "th", "math", "semantics", "menclose", "mfrac", "mi", "mn", "mo", "mover", "mpadded",
    "mroot", "mrow", "ms", "mspace", "msqrt", "mstyle", "msub", "msubsup", "msup", "mtable", "mtd",
    "mtext", "mtr", "munder", "munderover",
}
VOID = {
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param",
    "source", "track", "wbr",
}
#: Whole class, id or role names of removed parts, alone or with a usual word before or after.
MARKED = re.compile(
    r"(?:(?:site|page|main|top|bottom|global|post|article|blog|entry|user|reader)[_-])?"
    r"(?:ads?|adverts?|advertisements?|alerts?|banner|breadcrumbs?|comments?|cookies?|disqus|footer|header|menu"
    r"|modal|nav|navbar|navigation|newsletter|notice|popup|promo|recommended|related|share|sharing"
    r"|sidebar|signup|social|sponsored|subscribe|toolbar|widget)"
    r"(?:[_-](?:area|banner|bar|block|box|buttons?|consent|container|links?|list|menu|notice|section"
    r"|slot|widget|wrapper|this|top|bottom|left|right|thread|form|reply|count|\d+(?:x\d+)?))?",
    re.I,
)
#: Elements that no name removes.
KEPT = {"html", "body", "main", "article", "h1", "h2", "h3", "h4", "h5", "h6"}
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)(>|\Z)",
    re.S,
)
LABEL = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
MAIN = {"article", "main"}
HEADINGS = {"h1", "h2", "h3"}
FORM_END = re.compile(r"</form(?=[\s/>])", re.I)
STORY = re.compile(r"<(?:article|main|h1)(?=[\s/>])", re.I)


@dataclass
class Lines:
    """Text lines of a page, the length of their text outside links, and whether in an article."""

    text: list[str] = field(default_factory=list)
    weight: list[int] = field(default_factory=list)
    inside: list[bool] = field(default_factory=list)
    heading: list[bool] = field(default_factory=list)
    titled: bool = False
    parts: list[str] = field(default_factory=list)
    plain: int = 0

    def add(self, piece: str, link: bool) -> None:
        piece = html.unescape(piece)
        self.parts.append(piece)
        if not link:
            self.plain += len("".join(piece.split()))

    def end(self, inside: bool) -> None:
        line = " ".join("".join(self.parts).split())
        if line:
            self.text.append(line)
            self.weight.append(self.plain)
            self.inside.append(inside)
            self.heading.append(self.titled)
        self.parts, self.plain, self.titled = [], 0, False

    def gap(self, inside: bool) -> None:
        self.end(inside)
        self.text += [""] * WINDOW
        self.weight += [0] * WINDOW
        self.inside += [inside] * WINDOW
        self.heading += [False] * WINDOW


def _marked(attributes: str) -> bool:
    names = (name for found in LABEL.findall(attributes) for name in "".join(found).split())
    return any(MARKED.fullmatch(name) for name in names)


def _holds(page: str, at: int, name: str, article: int) -> bool:
    """Whether an element of a dropped name holds the story itself: the header of an article, or a
    form around an article or a heading."""
    if name == "header":
        return article > 0
    if name != "form":
        return False
    end = FORM_END.search(page, at)
    return STORY.search(page, at, end.start() if end else len(page)) is not None


def read_lines(page: str, marks: bool = True) -> Lines:
    """The page's blocks in order; unclosed parts end with the page. Without ``marks`` only
    element names remove parts."""
    lines, at, article, links = Lines(), 0, 0, 0
    skipped, depth = "", 0  # the removed element that is open, and how deep its name is nested
    size = len(page)
    while at < size:
        tag = TAG.search(page, at)
        start = tag.start() if tag else size
        if start > at and not skipped:
            lines.add(page[at:start], links > 0)
        if not tag:
            break
        at = tag.end()
        name = (tag[2] or "").lower()
        if not name:
            continue
        closing = bool(tag[1])
        if name in RAW and not closing and not tag[3].endswith("/"):
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if skipped:
            # A removed paragraph ends where the next block begins.
            if skipped == "p" and name not in INLINE:
                skipped = ""
            elif name == skipped:
                depth += -1 if closing else 1
                if not depth:
                    skipped = ""
                continue
            elif closing and name in ("body", "html"):
                skipped = ""
            else:
                continue
        # Articles inside an article are comments if they say so.
        kept = name in KEPT and not (name == "article" and article > 0)
        marked = marks and not closing and not kept and _marked(tag[3])
        if not closing and name not in VOID and (marked or name in DROPPED and not _holds(page, at, name, article)):
            lines.gap(article > 0)
            skipped, depth = name, 1
            continue
        if name == "a":
            links = max(0, links + (-1 if closing else 1))
        elif name in ("br", "td", "th"):
            lines.parts.append(" ")
        if name not in INLINE:
            lines.titled = lines.titled or closing and name in HEADINGS
            lines.end(article > 0)
            links = 0
            if name in MAIN:
                article = max(0, article + (-1 if closing else 1))
    lines.end(article > 0)
    return lines


def main_text(page: str) -> str:
    """Blocks of the main text in page order, joined by two line feeds."""
    lines = read_lines(page)
    if not any(lines.text):
        lines = read_lines(page, marks=False)  # a marked wrapper holds the whole page
    keep = range(len(lines.text))
    bounded = any(i and w for i, w in zip(lines.inside, lines.weight, strict=True))
    if bounded:
        keep = [k for k in keep if lines.inside[k]]
    weights = [lines.weight[k] for k in keep]
    run, sums = 0, []
    for k, weight in enumerate(weights):
        run += weight - (weights[k - WINDOW] if k >= WINDOW else 0)
        sums.append(run)
    # Regions: places of the surge and the dive.
    regions: list[list[int]] = []
    for k, total in enumerate(sums):
        if total and (not k or not sums[k - 1]):
            regions.append([k, k])
        if total:
            regions[-1][1] = k
    highest = max(sums, default=0)

    def belongs(first: int, last: int) -> bool:
        rows = range(first, last + 1)
        return bounded or max(sums[first : last + 1]) >= NEAR * highest or any(
            lines.heading[keep[k]] or weights[k] and SENTENCE.search(lines.text[keep[k]]) for k in rows
        )

    own = [region for region in regions if belongs(*region)]
    if not own:
        return "\n\n".join(lines.text[k] for k in keep if lines.text[k])
    return "\n\n".join(
        lines.text[k] for k in keep[own[0][0] : own[-1][1] + 1] if lines.text[k]
    )


def extract(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """(page_id, url, text, n_chars) of every page, from its whole html.

    Null, empty and text-free pages have an empty text; repeated rows give a row each. Other
    columns are not read.
    """

    def read(batches):
        for batch in slices(batches, 200):
            found = [main_text(page) for page in texts(batch.column(2))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(found, pa.string()),
                    pa.array([len(t) for t in found], pa.int64()),
                ],
                ["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(
        F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string")
    )
    return rows.mapInArrow(read, "page_id long, url string, text string, n_chars long")
