"""Table schemas. They are always given explicitly, never inferred."""

from pyspark.sql import types as T

STR, LONG, INT = T.StringType(), T.LongType(), T.IntegerType()


def _struct(**fields):
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


PAGES = _struct(page_id=LONG, url=STR, html=STR)

# What a capture may also record.
CAPTURE = _struct(fetched_at=T.TimestampType(), status=INT, content_type=STR)

SOURCES = _struct(
    name=STR,
    start_urls=T.ArrayType(STR),
    allowed_domains=T.ArrayType(STR),
    include_patterns=T.ArrayType(STR),
    exclude_patterns=T.ArrayType(STR),
    max_pages=INT,
    source_ord=INT,
)

SEEDS = _struct(name=STR, doc_url=STR, doc_type=STR, max_pages=INT)

EXTRACTED = _struct(
    url=STR,
    source=STR,
    source_ord=INT,
    seq=LONG,
    page_id=LONG,
    title=STR,
    content=STR,
    fetched_at=T.TimestampType(),
)

CORPUS = _struct(
    doc_id=LONG,
    url=STR,
    source=STR,
    title=STR,
    content=STR,
    content_hash=STR,
    fetched_at=T.TimestampType(),
)

POSTINGS = _struct(
    term=STR,
    bucket=INT,
    doc_id=LONG,
    col=T.ByteType(),
    tf=INT,
    positions=T.ArrayType(INT),
    n_tokens=INT,
)

CLAUSE = _struct(
    phrase=T.ArrayType(STR),
    kind=STR,
    slot=INT,
    cols=T.ArrayType(T.ByteType()),
    prefix=T.BooleanType(),
    initial=T.BooleanType(),
    near_group=INT,
    near=INT,
)

QUERIES = _struct(query_id=STR, clauses=T.ArrayType(CLAUSE), source=STR)

# What a table of nested boolean queries has in addition (operators/boolean.py).
PROGRAM = T.StructField("program", T.ArrayType(INT))

# Indexed columns, numbered in this order.
INDEXED = ("title", "content", "source", "url")
