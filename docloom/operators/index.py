"""Positional inverted index over the title, content, source and url columns.

Layout under one folder, each part split into numbered segments:

    postings/segment=N/bucket=B   one row per (term, document, column), sorted by term
    dictionary/segment=N/bucket=B one row per term: documents that it gains and its levels
    vocabulary/segment=N/part=P   its terms in order, dealt into blocks of the parts P
    heads/segment=N/bucket=B      for every beginning of a term the blocks that hold such terms
    doc_len/segment=N             tokens per document
    retired/segment=N             (doc_id, old segment) pairs that segment N replaces
    stats/segment=N               document and token totals up to segment N; written last

A refresh appends a segment for the changed documents only. Postings of replaced document
versions stay in place and are removed on read by an anti-join with ``retired``, which is
empty after a rebuild; the dictionary of the segment that retires them counts them off.
"""

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.text import tokenize
from docloom.plans.ordered import place
from docloom.plans.scratch import exists, materialize
from docloom.schemas import INDEXED, LONG, POSTINGS, STR

BUCKETS = 16

#: Rows of postings that one task adds up (about 200 MB), where the set number of partitions is too low.
TASK_ROWS = 1 << 21

#: Terms in a block of the sorted vocabulary, and characters of a beginning that leads to blocks.
BLOCK = 256
HEAD = 8


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def doc_tokens(corpus: DataFrame) -> DataFrame:
    """One row per document: token arrays of the four columns and their total size."""
    # Outer explodes below keep Catalyst from adding a size filter that tokenises twice.
    tokens = corpus.select("doc_id", F.array(*[tokenize(F.col(c)) for c in INDEXED]).alias("cells"))
    sizes = [F.size(F.col("cells")[i]) for i in range(len(INDEXED))]
    return tokens.select("doc_id", "cells", reduce(Column.__add__, sizes).alias("n_tokens"))


def build_postings(corpus: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(term, document, column) rows with positions, without any shuffle.

    All occurrences of a term in one document column sit in one row of the corpus, so
    grouping them is array work inside that row: sort (term, position) pairs, cut the sorted
    array where the term changes and explode the pieces.
    """
    cells = doc_tokens(corpus).select(
        "doc_id", "n_tokens", F.posexplode_outer("cells").alias("col", "tokens")
    )
    pairs = F.sort_array(
        F.transform("tokens", lambda t, i: F.struct(t.alias("term"), i.alias("pos")))
    )
    pairs = cells.select("doc_id", "n_tokens", "col", pairs.alias("p"))
    cuts = F.filter(
        F.when(F.size("p") > 0, F.sequence(F.lit(1), F.size("p"))),
        lambda i: (i == 1) | (F.get("p", i - 1)["term"] != F.get("p", i - 2)["term"]),
    )
    def piece(first: Column, nth: Column) -> Column:
        # Not slice(): it unpacks the whole array on every call.
        last = F.coalesce(F.get("cuts", nth + 1) - 1, F.size("p"))
        places = F.transform(F.sequence(first, last), lambda i: F.get("p", i - 1)["pos"])
        return F.struct(F.get("p", first - 1)["term"].alias("term"), places.alias("positions"))

    pieces = pairs.withColumn("cuts", cuts).select(
        "doc_id", "n_tokens", "col", F.explode(F.transform("cuts", piece)).alias("piece")
    )
    return pieces.select(
        "piece.term",
        bucket_of(F.col("piece.term"), buckets).alias("bucket"),
        "doc_id",
        F.col("col").cast("tinyint").alias("col"),
        F.size("piece.positions").alias("tf"),
        "piece.positions",
        "n_tokens",
    )


def doc_lengths(corpus: DataFrame) -> DataFrame:
    return doc_tokens(corpus).select("doc_id", F.col("n_tokens").cast("long").alias("n_tokens"))


def term_stats(postings: DataFrame) -> DataFrame:
    """Documents per term, over all columns, in two counting steps without a distinct set."""
    per_doc = postings.groupBy("term", "doc_id").agg(F.lit(1).alias("one"))
    return per_doc.groupBy("term").agg(F.count("*").alias("df"))


def dealt(postings: DataFrame) -> DataFrame:
    """Narrow rows of written postings, those of a term and document in one partition. With more rows
    than the set number of partitions can hold they get partitions of bounded size."""
    narrow = postings.select("bucket", "term", "doc_id", "tf", "n_tokens")
    parts = -(-postings.count() // TASK_ROWS)
    if parts <= int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return narrow
    return narrow.repartition(parts, "bucket", "term", "doc_id")


def dictionary(postings: DataFrame) -> DataFrame:
    """(term, bucket, df, levels): documents per term and what bounds its part of any score.

    A level holds the documents whose frequency ``f`` of the term lies between two powers of two:
    the largest ``f`` and the fewest tokens in it. No document of a level scores more than one that
    has both, whatever the average length is at the time of a search.
    """
    per_doc = postings.groupBy("bucket", "term", "doc_id").agg(
        F.sum("tf").alias("f"), F.max("n_tokens").alias("n")
    )
    level = F.floor(F.log2("f")).alias("level")
    per_level = per_doc.groupBy("bucket", "term", level).agg(
        F.count("*").alias("df"), F.max("f").cast("long").alias("f"), F.min("n").cast("long").alias("n")
    )
    return per_level.groupBy("term", "bucket").agg(
        F.sum("df").alias("df"), F.collect_list(F.struct("f", "n")).alias("levels")
    )


def corpus_stats(doc_len: DataFrame) -> DataFrame:
    return doc_len.agg(
        F.count("*").alias("n_docs"),
        F.coalesce(F.sum("n_tokens"), F.lit(0)).cast("long").alias("n_tokens"),
    ).withColumn("avgdl", F.try_divide(F.col("n_tokens").cast("double"), F.col("n_docs")))


@dataclass(frozen=True)
class Index:
    """Live view of a written index."""

    path: str
    postings: DataFrame
    dictionary: DataFrame
    words: DataFrame
    heads: DataFrame
    doc_len: DataFrame
    n_docs: int
    n_tokens: int
    buckets: int
    segment: int

    @property
    def vocabulary(self) -> DataFrame:
        return self.dictionary.select("term")

    @property
    def avgdl(self) -> float:
        return self.n_tokens / self.n_docs if self.n_docs else 0.0


_SEGMENT = T.StructField("segment", T.IntegerType())
_STATS = T.StructType(
    [
        T.StructField("n_docs", LONG),
        T.StructField("n_tokens", LONG),
        T.StructField("buckets", T.IntegerType()),
        _SEGMENT,
    ]
)
_PAIRS = T.StructType([T.StructField("doc_id", LONG), T.StructField("old", T.IntegerType()), _SEGMENT])
_LENGTHS = T.StructType([T.StructField("doc_id", LONG), T.StructField("n_tokens", LONG), _SEGMENT])
_LEVELS = T.ArrayType(T.StructType([T.StructField("f", LONG), T.StructField("n", LONG)]))
_TERMS = T.StructType(
    [
        T.StructField("term", STR),
        T.StructField("df", LONG),
        T.StructField("levels", _LEVELS),
        T.StructField("bucket", T.IntegerType()),
        _SEGMENT,
    ]
)
_INT = T.IntegerType()
_WORDS = T.StructType(
    [T.StructField("term", STR), T.StructField("block", _INT), T.StructField("part", _INT), _SEGMENT]
)
_HEADS = T.StructType(
    [
        T.StructField("head", STR),
        T.StructField("part", _INT),
        T.StructField("low", _INT),
        T.StructField("high", _INT),
        T.StructField("bucket", _INT),
        _SEGMENT,
    ]
)


def _read(spark: SparkSession, path: str, schema: T.StructType, segment: int) -> DataFrame:
    return spark.read.schema(schema).parquet(path).filter(F.col("segment") <= segment)


def _last_segment(spark: SparkSession, path: str):
    if not exists(spark, f"{path}/stats"):
        return None
    stats = spark.read.schema(_STATS).parquet(f"{path}/stats")
    return stats.orderBy(F.desc("segment")).first()


def read_index(spark: SparkSession, path: str) -> Index:
    last = _last_segment(spark, path)
    if last is None:
        raise FileNotFoundError(f"no index at {path}")
    schema = T.StructType([*POSTINGS.fields, _SEGMENT])
    postings = _read(spark, f"{path}/postings", schema, last.segment)
    doc_len = _read(spark, f"{path}/doc_len", _LENGTHS, last.segment)
    words = _read(spark, f"{path}/dictionary", _TERMS, last.segment).drop("segment")
    if last.segment > 0:
        words = words.groupBy("term", "bucket").agg(
            F.sum("df").alias("df"), F.flatten(F.collect_list("levels")).alias("levels")
        ).filter("df > 0")
        retired = _read(spark, f"{path}/retired", _PAIRS, last.segment).select(
            "doc_id", F.col("old").alias("segment")
        )
        postings = postings.join(retired, ["doc_id", "segment"], "left_anti")
        doc_len = doc_len.join(retired, ["doc_id", "segment"], "left_anti")
    return Index(
        path=path,
        postings=postings,
        dictionary=words.select("term", "bucket", "df", "levels"),
        words=_read(spark, f"{path}/vocabulary", _WORDS, last.segment),
        heads=_read(spark, f"{path}/heads", _HEADS, last.segment),
        doc_len=doc_len,
        n_docs=last.n_docs,
        n_tokens=last.n_tokens,
        buckets=last.buckets,
        segment=last.segment,
    )


def _write_segment(corpus: DataFrame, path: str, segment: int, buckets: int, lost=None) -> None:
    """Postings, dictionary and lengths of ``corpus``; the statistics row is left to the caller.

    The texts are tokenised once: everything else is read from the postings written first.
    ``rebalance`` lets adaptive execution split the bucket of a very frequent term into
    several even files, so no salt is needed. ``lost`` are terms of retired documents.
    """
    spark = corpus.sparkSession
    (
        build_postings(corpus, buckets)
        .hint("rebalance", "bucket")
        .sortWithinPartitions("bucket", "term", "doc_id")
        .write.mode("overwrite")
        .partitionBy("bucket")
        .parquet(f"{path}/postings/segment={segment}")
    )
    written = spark.read.schema(POSTINGS).parquet(f"{path}/postings/segment={segment}")
    words = dictionary(dealt(written))
    if lost is not None:
        words = words.unionByName(lost)
    (
        words.hint("rebalance", "bucket")
        .sortWithinPartitions("bucket", "term")
        .write.mode("overwrite")
        .partitionBy("bucket")
        .parquet(f"{path}/dictionary/segment={segment}")
    )
    gained = spark.read.schema(_TERMS).parquet(f"{path}/dictionary/segment={segment}").filter("df > 0")
    _write_vocabulary(gained.select("term"), path, segment, buckets)
    # A document without any token has no posting.
    sizes = written.groupBy("doc_id").agg(F.max("n_tokens").cast("long").alias("n_tokens"))
    (
        corpus.select("doc_id").join(sizes, "doc_id", "left").fillna(0, ["n_tokens"])
        .write.mode("overwrite")
        .parquet(f"{path}/doc_len/segment={segment}")
    )


def _write_vocabulary(terms: DataFrame, path: str, segment: int, buckets: int) -> None:
    """The sorted vocabulary in blocks and, for every beginning of up to ``HEAD`` characters, the
    interval of blocks in each part that it reaches.

    Terms that share a beginning are neighbours, so a beginning needs one row for each part that it
    reaches. Longer prefixes use the row of their first characters.
    """
    spark = terms.sparkSession
    row = F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    words = place(terms, [], ["term"]).select(
        "term", F.floor(row / BLOCK).cast("int").alias("block"), F.col("_part").alias("part")
    )
    folder = f"{path}/vocabulary/segment={segment}"
    words.sortWithinPartitions("part", "term").write.mode("overwrite").partitionBy("part").parquet(folder)
    lengths = F.sequence(F.lit(1), F.least(F.length("term"), F.lit(HEAD)))
    heads = spark.read.schema(_WORDS).parquet(folder).select(
        "part", "block", F.explode(F.transform(lengths, lambda n: F.substring("term", F.lit(1), n))).alias("head")
    )
    spans = heads.groupBy("head", "part").agg(F.min("block").alias("low"), F.max("block").alias("high"))
    (
        spans.withColumn("bucket", bucket_of(F.col("head"), buckets))
        .hint("rebalance", "bucket")
        .write.mode("overwrite")
        .partitionBy("bucket")
        .parquet(f"{path}/heads/segment={segment}")
    )


def prefix_words(prefixes: DataFrame, index: Index) -> DataFrame:
    """Add ``word`` to (prefix, ...) rows: every term of the vocabulary that begins with it.

    The beginning of a prefix names its interval of blocks; only these blocks are read and tested.
    A term of several segments comes more than once.
    """
    head = F.substring("prefix", 1, HEAD)
    wanted = prefixes.withColumn("head", head).withColumn("bucket", bucket_of(head, index.buckets))
    spans = wanted.join(index.heads, ["bucket", "head"]).drop("bucket", "head")
    blocks = spans.withColumn("block", F.explode(F.sequence("low", "high"))).drop("low", "high")
    words = index.words.withColumnRenamed("term", "word")
    found = words.join(blocks, ["segment", "part", "block"]).filter(F.startswith("word", "prefix"))
    return found.drop("segment", "part", "block")


def _totals(doc_len: DataFrame) -> tuple[int, int]:
    row = corpus_stats(doc_len).first()
    return row.n_docs, row.n_tokens


def _write_stats(spark: SparkSession, path: str, segment: int, n_docs: int, n_tokens: int, buckets: int):
    row = spark.range(1).select(
        F.lit(n_docs).cast("long").alias("n_docs"),
        F.lit(n_tokens).cast("long").alias("n_tokens"),
        F.lit(buckets).alias("buckets"),
    )
    row.coalesce(1).write.mode("overwrite").parquet(f"{path}/stats/segment={segment}")
    return read_index(spark, path)


def write_index(
    corpus: DataFrame, path: str, buckets: int = BUCKETS, partitions: int | None = None
) -> Index:
    """Full build (also the rebuild of an existing corpus) into the empty folder ``path``.

    ``partitions`` deals the corpus anew before it is tokenised, for a corpus stored in a few
    large row groups that Spark would read with as few tasks.
    """
    spark = corpus.sparkSession
    if exists(spark, f"{path}/stats"):
        raise FileExistsError(f"{path} already holds an index; rebuild into a new folder")
    if partitions:
        corpus = corpus.repartition(partitions)
    _write_segment(corpus, path, 0, buckets)
    totals = _totals(spark.read.schema(_LENGTHS).parquet(f"{path}/doc_len"))
    return _write_stats(spark, path, 0, *totals, buckets)


def merge_index(spark: SparkSession, path: str, changed: DataFrame) -> Index:
    """Append a segment for ``changed`` corpus rows and retire their older versions.

    Nothing already written is rewritten. Totals follow from the retired and the added
    documents. The terms of retired documents are counted off in the new dictionary; for them the
    term and id columns of the postings are read. A run that failed before its statistics row was
    written is invisible to readers and its segment number is used again.
    """
    current = read_index(spark, path)
    segment = current.segment + 1
    old = materialize(
        current.doc_len.join(changed.select("doc_id"), "doc_id", "left_semi"), "retired"
    )
    (
        old.select("doc_id", F.col("segment").alias("old"))
        .write.mode("overwrite")
        .parquet(f"{path}/retired/segment={segment}")
    )
    gone = current.postings.join(old.select("doc_id"), "doc_id", "left_semi")
    gone = gone.groupBy("bucket", "term", "doc_id").agg(F.lit(1).alias("one"))
    lost = gone.groupBy("term", "bucket").agg((-F.count("*")).alias("df"))
    lost = lost.withColumn("levels", F.array().cast(_LEVELS))
    _write_segment(changed, path, segment, current.buckets, lost)
    added = _totals(spark.read.schema(_LENGTHS).parquet(f"{path}/doc_len/segment={segment}"))
    left = [a - b + c for a, b, c in zip((current.n_docs, current.n_tokens), _totals(old), added, strict=True)]
    return _write_stats(spark, path, segment, *left, current.buckets)


def merge_postings(postings: DataFrame, changed: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The same merge on plain DataFrames: drop postings of changed documents, add new ones."""
    kept = postings.join(changed.select("doc_id"), "doc_id", "left_anti")
    return kept.unionByName(build_postings(changed, buckets))
