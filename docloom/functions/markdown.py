"""HTML of one page to Markdown of its main content (no Spark in here).

Each open element is a frame that collects the Markdown of its children; closing it turns
them into one string for the parent. Nothing recurses, so nesting depth does not matter.
"""

import re
from html.parser import HTMLParser

# Where the main content is looked for, in this order.
MAIN_SELECTORS = (
    "main",
    "article",
    "#main-content",
    "#content",
    ".document",
    ".content",
    ".main-content",
)

# Classes of elements in HTML.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
FORMATTING = set("a b big code em font i nobr s small strike strong tt u".split())
CLOSES_P = HEADINGS | set(
    "address article aside blockquote center details dialog dd dir div dl dt fieldset "
    "figcaption figure footer form header hgroup hr li main menu nav ol p pre search section "
    "summary table ul".split()
)
TRIMMED = HEADINGS | set(
    "p blockquote article div section ol ul li dl dt dd table thead tbody tfoot tr td th".split()
)
SKIPPED = {"script", "style", "noscript", "template", "head", "title"}
# An opening tag on the left closes any of the open elements on the right.
SIBLINGS = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "tbody": {"thead", "tbody", "tr", "td", "th"},
    "tfoot": {"tbody", "tr", "td", "th"},
    "option": {"option"},
}
SCOPES = {"ul", "ol", "dl", "table", "blockquote", "td", "th", "select"}
MARKS = {"b": "**", "strong": "**", "em": "*", "i": "*", "del": "~~", "s": "~~"}
LITERAL = {"code", "kbd", "samp"}
BULLETS = "*+-"
SELECTED = {selector for selector in MAIN_SELECTORS if selector[0] not in "#."}
BREAKS = re.compile(r"[ \t\r\n]*[\r\n][ \t\r\n]*")
GAPS = re.compile(r"[ \t]+")
CUT_TAG = re.compile(r"</?[a-zA-Z!][^<>]*\Z")

#: Pages converted at a time.
PIECE = 256


class _Frame:
    __slots__ = ("tag", "attrs", "parts", "order", "last", "items", "plain")

    def __init__(self, tag, attrs, order):
        self.tag, self.attrs, self.order = tag, attrs, order
        self.parts, self.last, self.items, self.plain = [], "", 0, False


def _chomp(text):
    inner = text.strip()
    lead = " " if text[:1] == " " and inner else ""
    trail = " " if text[-1:] == " " and inner else ""
    return lead, inner, trail


def _indent(text, first, rest):
    lines = text.split("\n")
    return "\n".join(
        [first + lines[0]] + [(rest + line) if line else "" for line in lines[1:]]
    )


class _Converter(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.frames = [_Frame("", {}, 0)]
        self.counts = {}
        self.lost = []
        self.order = 0
        self.skip = None
        self.found = {}
        self.body = None

    # Context of the innermost frame.

    def inside(self, *tags):
        count = self.counts.get
        for tag in tags:
            if count(tag):
                return True
        return False

    def _push(self, tag, attrs):
        self.order += 1
        self.frames.append(_Frame(tag, attrs, self.order))
        self.counts[tag] = self.counts.get(tag, 0) + 1

    def _add(self, text, kind):
        frame = self.frames[-1]
        frame.last = kind
        if not text:
            return
        if frame.parts and not self.inside("pre"):
            last = frame.parts[-1]
            gap = len(last) - len(last.rstrip("\n"))
            lead = len(text) - len(text.lstrip("\n"))
            if gap and lead:
                frame.parts[-1] = last.rstrip("\n")
                text = "\n" * min(2, max(gap, lead)) + text.lstrip("\n")
        frame.parts.append(text)

    def _trim(self):
        frame = self.frames[-1]
        if frame.last == "#text" and frame.parts:
            frame.parts[-1] = frame.parts[-1].rstrip(" \t\r\n")

    def _pop(self):
        frame = self.frames[-1]
        if frame.tag in TRIMMED:
            self._trim()
        self.frames.pop()
        self.counts[frame.tag] -= 1
        text = self._render(frame, "".join(frame.parts))
        if frame.tag in SELECTED or "id" in frame.attrs or "class" in frame.attrs:
            for number, selector in enumerate(MAIN_SELECTORS):
                if self._is(frame, selector):
                    known = self.found.get(number)
                    if known is None or frame.order < known[0]:
                        self.found[number] = (frame.order, text)
        if frame.tag == "body" and self.body is None:
            self.body = text
        self._add(text, frame.tag)

    @staticmethod
    def _is(frame, selector):
        if selector[0] == "#":
            return frame.attrs.get("id") == selector[1:]
        if selector[0] == ".":
            return selector[1:] in (frame.attrs.get("class") or "").split()
        return frame.tag == selector

    def _close_until(self, index):
        """Close all frames from ``index`` up; formatting among them stays in force."""
        lost = [f for f in self.frames[index + 1 :] if f.tag in FORMATTING]
        while len(self.frames) > index:
            self._pop()
        self.lost += [(f.tag, f.attrs) for f in lost]

    def _close_open(self, tags, scopes):
        for index in range(len(self.frames) - 1, 0, -1):
            tag = self.frames[index].tag
            if tag in tags:
                self._close_until(index)
                return
            if tag in scopes:
                return

    def _reopen(self):
        lost, self.lost = self.lost, []
        for tag, attrs in lost:
            self._push(tag, attrs)

    # Parser events.

    def handle_starttag(self, tag, attrs):
        if self.skip:
            return
        if tag in SKIPPED:
            self.skip = tag
            return
        if tag in ("html", "body") and self.inside(tag):
            return
        attrs = dict(reversed(attrs))
        if tag in CLOSES_P:
            self._close_open({"p"}, {"td", "th", "caption", "button"})
        if tag in HEADINGS and self.frames[-1].tag in HEADINGS:
            self._pop()
        if tag in SIBLINGS:
            own_scope = {"table"} if tag in ("tr", "td", "th", "tbody", "tfoot") else SCOPES
            if tag in ("td", "th"):
                own_scope = {"table", "tr"}
            for _ in range(3):
                before = len(self.frames)
                self._close_open(SIBLINGS[tag], own_scope)
                if len(self.frames) == before:
                    break
        if tag == "a":
            self._end("a")
        if tag in TRIMMED or tag == "pre":
            self._trim()
        elif tag not in VOID or tag in ("br", "img"):
            self._reopen()
        if tag not in VOID:
            self._push(tag, attrs)
            return
        if tag == "br":
            self._add(" " if self._inline() else "  \n", tag)
        elif tag == "hr":
            self._add("\n\n---\n\n", tag)
        elif tag == "img":
            self._add(self._image(attrs), tag)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if self.skip:
            if tag == self.skip or tag in ("html",):
                self.skip = None
            return
        if tag in HEADINGS:
            open_heading = [f.tag for f in self.frames if f.tag in HEADINGS]
            tag = open_heading[-1] if open_heading else tag
        self._end(tag)

    def _end(self, tag):
        if tag in FORMATTING:
            for index in range(len(self.lost) - 1, -1, -1):
                if self.lost[index][0] == tag:
                    del self.lost[index]
                    return
        for index in range(len(self.frames) - 1, 0, -1):
            name = self.frames[index].tag
            if name == tag:
                self._close_until(index)
                return
            if tag in FORMATTING and name in CLOSES_P:
                return
            if tag in ("p", "li") and name in SCOPES:
                return

    def handle_data(self, data):
        if self.skip:
            return
        if data.strip(" \t\r\n"):
            self._reopen()
        frame = self.frames[-1]
        if not self.inside("pre"):
            if "\n" in data or "\r" in data:
                data = BREAKS.sub("\n", data)
            if "  " in data or "\t" in data:
                data = GAPS.sub(" ", data)
            after_block = frame.last in TRIMMED or frame.last == "pre"
            if after_block or (not frame.last and frame.tag in TRIMMED):
                data = data.lstrip(" \t\r\n")
        if not self.inside("pre", *LITERAL):
            data = data.replace("*", r"\*").replace("_", r"\_")
        if data:
            self._add(data, "#text")

    def finish(self):
        self.close()
        while len(self.frames) > 1:
            self._pop()
        for number in range(len(MAIN_SELECTORS)):
            if number in self.found:
                return self.found[number][1]
        return self.body if self.body is not None else "".join(self.frames[0].parts)

    # Markdown of one element.

    def _inline(self):
        return self.inside("td", "th", *HEADINGS)

    def _image(self, attrs):
        alt, src = attrs.get("alt") or "", attrs.get("src") or ""
        if self._inline():
            return alt
        title = attrs.get("title")
        return f"![{alt}]({src}{_title(title)})"

    def _render(self, frame, text):
        tag = frame.tag
        if self.inside("pre", *LITERAL) and (tag in MARKS or tag in LITERAL or tag == "a"):
            return text
        if tag in MARKS or tag in LITERAL:
            lead, inner, trail = _chomp(text)
            mark = MARKS.get(tag, "`")
            return f"{lead}{mark}{inner}{mark}{trail}" if inner else ""
        if tag == "a":
            return self._link(frame.attrs, text)
        if tag in HEADINGS:
            if self._inline():
                return text
            return f"\n\n{'#' * int(tag[1])} {' '.join(text.split())}\n\n"
        if tag in ("p", "div", "article", "section", "dl"):
            inner = text.strip(" \t\r\n")
            if self._inline():
                return f" {inner} " if inner else ""
            return f"\n\n{inner}\n\n" if inner else ""
        if tag == "pre":
            text = text[1:] if text[:1] == "\n" else text
            return f"\n\n```\n{text}\n```\n\n" if text else ""
        if tag == "blockquote":
            inner = text.strip(" \t\r\n")
            if self._inline():
                return f" {inner} "
            quoted = "\n".join(f"> {line}" if line else ">" for line in inner.split("\n"))
            return f"\n{quoted}\n\n" if inner else "\n"
        if tag in ("ul", "ol"):
            return "\n" + text.rstrip() if self.inside("li") else f"\n\n{text}\n"
        if tag == "li":
            return self._item(text)
        if tag in ("td", "th"):
            cell = text.strip().replace("\n", " ")
            self.frames[-1].items += 1
            self.frames[-1].plain |= tag == "td"
            return f" {cell} |"
        if tag == "tr":
            return self._row(frame, text)
        if tag == "table":
            return f"\n\n{text.strip()}\n\n"
        if tag == "dt":
            return f"\n\n{text.strip()}\n" if text.strip() else "\n"
        if tag == "dd":
            return _indent(text.strip(), ":   ", "    ") + "\n" if text.strip() else "\n"
        if tag == "q":
            return f'"{text}"'
        return text

    def _link(self, attrs, text):
        lead, inner, trail = _chomp(text)
        href, title = attrs.get("href"), attrs.get("title")
        if not inner:
            return ""
        if inner.replace(r"\_", "_") == href and not title:
            return f"<{href}>"
        return f"{lead}[{inner}]({href}{_title(title)}){trail}" if href else text

    def _item(self, text):
        inner = text.strip()
        parent = self.frames[-1]
        parent.items += 1
        if not inner:
            return "\n"
        if parent.tag == "ol":
            first = parent.attrs.get("start") or "1"
            bullet = f"{(int(first) if first.isdigit() else 1) + parent.items - 1}. "
        else:
            bullet = BULLETS[max(self.counts.get("ul", 0) - 1, 0) % 3] + " "
        return _indent(inner, bullet, " " * len(bullet)) + "\n"

    def _row(self, frame, text):
        """A pipe row; a table without a header row gets an empty one first."""
        tables = [f for f in self.frames if f.tag == "table"]
        if not tables:
            return text
        tables[-1].items += 1
        rule = "|" + " --- |" * max(frame.items, 1) + "\n"
        row = f"|{text}\n"
        if tables[-1].items > 1:
            return row
        if self.frames[-1].tag == "thead" or not frame.plain:
            return row + rule
        return "|" + "  |" * frame.items + "\n" + rule + row


def _title(title):
    return ' "{}"'.format(title.replace('"', r"\"")) if title else ""


def to_markdown(html):
    """Markdown of the main content; '' when there is none."""
    if not html:
        return ""
    converter = _Converter()
    # A tag that the end of the input cuts off is not text; it begins at the last bracket.
    last = html.rfind("<")
    converter.feed(html[:last] if last >= 0 and CUT_TAG.match(html, last) else html)
    return converter.finish()


def in_pieces(pages):
    """Markdown of an Arrow column of pages, some pages at a time."""
    for at in range(0, len(pages), PIECE):
        yield [to_markdown(page.as_py()) for page in pages[at : at + PIECE]]
