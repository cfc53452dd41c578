"""URL column functions, all native expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.let import let

# Fixed value: scheme, authority, path, query and fragment of a URL (RFC 3986, appendix B,
# with the scheme limited to its legal characters).
PARTS = r"(?s)^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
SCHEME, AUTHORITY, PATH, QUERY, FRAGMENT = 1, 2, 3, 4, 5

# Doc types with their own scope rule, the pages every seed leaves out.
HOSTED_DOCS, CODE_HOST = "readthedocs", "github"
SEED_EXCLUDES = ("/_sources/", "/search.html", "/genindex.html")


def _clean(url: Column) -> Column:
    """Leading control characters and spaces, and line breaks anywhere, are not part of it."""
    return F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")


def part(url: Column, number: int) -> Column:
    return F.regexp_extract(url, PARTS, number)


def authority(url: Column) -> Column:
    return part(url, AUTHORITY)


def _split(url: Column) -> Column:
    return F.struct(
        F.lower(part(url, SCHEME)).alias("scheme"),
        part(url, AUTHORITY).alias("netloc"),
        part(url, PATH).alias("path"),
        part(url, QUERY).alias("query"),
        part(url, FRAGMENT).alias("fragment"),
    )


def _build(scheme: Column, netloc: Column, path: Column, query: Column, fragment: Column) -> Column:
    """Put the parts together. An empty parameter, query or fragment loses its separator."""

    def rooted(path):
        return F.when(
            (netloc != "") & (path != "") & ~path.startswith("/"), F.concat(F.lit("/"), path)
        ).otherwise(path)

    def joined(path):
        absolute = (path == "") | path.startswith("/")
        return F.concat(
            scheme,
            F.when(absolute, F.concat(F.lit("://"), netloc, path)).otherwise(
                F.concat(F.lit(":"), path)
            ),
            F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
            F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(""),
        )

    trimmed = F.regexp_replace(path, r"(^|/)([^;/]*);$", "$1$2")
    return let(trimmed, lambda p: let(rooted(p), joined))


def normalize_url(url: Column) -> Column:
    """Absolute http(s) form without fragment; '' for any other scheme."""

    def built(u):
        scheme = F.when(u["scheme"] == "", "https").otherwise(u["scheme"])
        whole = _build(scheme, u["netloc"], u["path"], u["query"], F.lit(""))
        return F.when(u["scheme"].isin("", "http", "https"), whole).otherwise("")

    return let(_clean(url), lambda cleaned: let(_split(cleaned), built))


def _segments(base_path: Column, path: Column) -> Column:
    """Path segments of a reference seen from the folder of ``base_path``."""
    empty = F.array().cast("array<string>")

    def below(base):
        folder = F.slice(base, F.lit(1), F.size(base) - 1)
        return F.when(F.element_at(base, -1) != "", folder).otherwise(base)

    def without_empty(joined):
        inner = F.slice(joined, F.lit(2), F.greatest(F.size(joined) - 2, F.lit(0)))
        last = F.when(F.size(joined) > 1, F.slice(joined, F.lit(-1), F.lit(1))).otherwise(empty)
        return F.concat(F.slice(joined, F.lit(1), F.lit(1)), F.array_remove(inner, ""), last)

    own = F.split(path, "/", -1)
    relative = let(
        F.concat(let(F.split(base_path, "/", -1), below), own), without_empty
    )
    return F.when(path.startswith("/"), own).otherwise(relative)


def _resolve_dots(segments: Column) -> Column:
    def step(kept, segment):
        parent = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
        return (
            F.when(segment == "..", parent)
            .when(segment == ".", kept)
            .otherwise(F.concat(kept, F.array(segment)))
        )

    kept = F.aggregate(segments, F.array().cast("array<string>"), step)
    open_end = F.when(F.element_at(segments, -1).isin(".", ".."), F.array(F.lit("")))
    ends = F.coalesce(open_end, F.array().cast("array<string>"))
    merged = F.array_join(F.concat(kept, ends), "/")
    return F.coalesce(F.nullif(merged, F.lit("")), F.lit("/"))


def resolve_link(base: Column, href: Column) -> Column:
    """``href`` as seen from the page ``base`` (an absolute http(s) URL)."""

    def resolved(href, b, h):
        params = F.regexp_extract(h["path"], r";[^/]*$", 0)
        path = F.regexp_replace(h["path"], r";[^/]*$", "")
        base_path = F.regexp_replace(b["path"], r";[^/]*$", "")
        merged = let(_segments(base_path, path), _resolve_dots)
        plain = h["path"].startswith("/") & ~h["path"].contains("/.") & ~h["path"].contains("//")
        whole = F.when(plain, h["path"]).otherwise(F.concat(merged, params))
        same_page = (path == "") & params.isin("", ";")
        own_host = h["netloc"] != ""
        inherited = F.when(same_page & ~own_host & (h["query"] == ""), b["query"])
        built = _build(
            b["scheme"],
            F.when(own_host, h["netloc"]).otherwise(b["netloc"]),
            F.when(own_host, h["path"]).when(same_page, b["path"]).otherwise(whole),
            inherited.otherwise(h["query"]),
            h["fragment"],
        )
        foreign = (h["scheme"] != "") & (h["scheme"] != b["scheme"])
        return F.when(href == "", base).when(foreign, href).otherwise(built)

    return let(
        _clean(href),
        lambda h: let(
            F.struct(_split(base).alias("b"), _split(h).alias("h")),
            lambda both: resolved(h, both["b"], both["h"]),
        ),
    )


def host_suffixes(host: Column) -> Column:
    """'a.b.c' gives ['a.b.c', 'b.c', 'c']; an empty host gives no suffix."""

    def tails(labels):
        return F.transform(
            F.sequence(F.lit(1), F.size(labels)),
            lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
        )

    suffixes = let(F.split(host, r"\.", -1), tails)
    return F.when(host != "", suffixes).otherwise(F.array().cast("array<string>"))


def host_allowed(url: Column, domains: Column) -> Column:
    """Host equals a domain or lies below it; for domains stored in the same row."""
    return F.arrays_overlap(host_suffixes(F.lower(authority(url))), domains)


def matches_rules(url: Column, include: Column, exclude: Column) -> Column:
    """Some pattern of ``include`` is found, or there is none, and none of ``exclude`` is.

    Every pattern is tried on its own, so that groups keep their numbers.
    """
    wanted = (F.size(include) == 0) | F.exists(include, lambda p: F.rlike(url, p))
    return wanted & ~F.exists(exclude, lambda p: F.rlike(url, p))


# Path segments that rules and URLs are compared by ahead of the regular expressions.
KEY_SEGMENTS = 8

# The signs that a pattern does not take literally, and those that repeat what
# stands before them; the ending of a scope that takes the start page with and without slash.
_SIGNS = r"\\.^$*+?()\[\]{}|"
_REPEATS = ("*", "+", "?", "{")
SLASH_OR_END = "(/|$)"


def _rest(url: Column) -> Column:
    """Everything behind the authority."""
    return F.regexp_extract(url, r"(?s)^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*(.*)$", 1)


def path_keys(url: Column) -> Column:
    """What stands behind the authority up to each slash (without it), and as a whole:
    'https://h/a/b' gives ['', '/a', '/a/b']. Only the first ``KEY_SEGMENTS`` segments count."""
    whole = F.regexp_replace(_rest(url), "(\r\n|[\n\r\u0085\u2028\u2029])$", "")
    return let(
        F.split(whole, "/", -1),
        lambda parts: F.transform(
            F.sequence(F.lit(1), F.least(F.size(parts), F.lit(KEY_SEGMENTS + 1))),
            lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"),
        ),
    )


def pattern_key(pattern: Column, domain: Column) -> Column:
    """A key that ``path_keys`` of every URL on the host ``domain`` has which ``pattern`` matches.

    Only a pattern that is tied to the start and names scheme and host (as they are or escaped)
    says something about the path: its literal beginning, up to the last slash. All
    others, and those with alternatives, get '' as every URL does.
    """
    escaped = F.regexp_replace(domain, f"([{_SIGNS}])", r"\\$1")
    tail = F.lit("")
    for host in (escaped, domain):
        for scheme in ("http://", "https://"):
            start = F.concat(F.lit("^" + scheme), host)
            behind = F.substring(pattern, F.length(start) + 1, F.length(pattern))
            tail = F.when(pattern.startswith(F.concat(start, F.lit("/"))), behind).otherwise(tail)

    def literal(tail):
        ends = tail.endswith(SLASH_OR_END)
        body = F.when(ends, F.substring(tail, F.lit(1), F.length(tail) - len(SLASH_OR_END))).otherwise(tail)
        run = F.regexp_extract(body, rf"^((?:[^{_SIGNS}]|\\[^A-Za-z0-9])*)", 1)
        after = F.substring(body, F.length(run) + 1, F.lit(1))
        run = F.when(after.isin(*_REPEATS), F.regexp_replace(run, r"(\\.|.)$", "")).otherwise(run)
        text = F.regexp_replace(run, r"\\(.)", "$1")
        # A literal that the pattern's own ending closes is a whole segment, any other is cut.
        whole = ends & (after == "")
        cut = F.regexp_replace(text, "/[^/]*$", "")
        key = F.when(whole, F.regexp_replace(text, "/$", "")).otherwise(cut)
        key = F.array_join(F.slice(F.split(key, "/", -1), 1, KEY_SEGMENTS + 1), "/")
        return F.when(body.contains("|"), "").otherwise(key)

    return let(tail, literal)


def package_include_pattern(doc_url: Column, doc_type: Column, repair: bool = False) -> Column:
    """Scope pattern of a seed URL.

    The plain form writes the host as it is and always asks for https. With ``repair`` the
    host and path are escaped, the seed's own scheme is kept and the start page itself
    matches when it has no trailing slash.
    """
    domain = authority(doc_url)
    base = F.rtrim(part(doc_url, PATH), F.lit("/"))
    hosted = (doc_type == HOSTED_DOCS) | domain.contains("readthedocs.io")
    code_host = (doc_type == CODE_HOST) | domain.contains("github.com")
    base = F.when(hosted, base).when(code_host, "").otherwise(base)
    if not repair:
        return F.concat(F.lit("^https://"), domain, base, F.lit("/"))
    escaped = F.regexp_replace(F.concat(domain, base), r"([.+*?()\[\]{}|^$\\])", r"\\$1")
    scheme = F.lower(part(doc_url, SCHEME))
    return F.concat(F.lit("^"), scheme, F.lit("://"), escaped, F.lit("(/|$)"))
