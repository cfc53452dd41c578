"""Document fingerprints by Order MinHash.

Every k-mer of a text is numbered by its earlier occurrences. Each of ``HASHES`` orders picks the
``LENGTH`` smallest numbered k-mers, keeps them in text order and hashes the tuple, so equal
slots tell of text that is alike in content and in order, as edit distance asks.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import U, mix, seeds, texts
from docloom.plans.scratch import materialize

KMER = 8
LENGTH = 2
HASHES = 32
#: Positions hashed at a time, so that an order's values stay in the processor's cache.
BLOCK = 1 << 12
ORDERS = seeds(HASHES, 6)
STEP = U(0x9E3779B97F4A7C15)


def numbered_kmers(text: str) -> np.ndarray:
    """Hashes of the k-mers in text order, each with the number of equal ones before it."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32).astype(U)
    width = min(KMER, len(codes))
    if not width:
        return codes
    count = len(codes) - width + 1
    grams = np.full(count, U(width))
    for at in range(width):
        grams *= STEP
        grams += codes[at : at + count]
    grams = mix(grams)
    # Sorting hash and position as one number brings equal k-mers together in text order.
    bits = U(max(1, int(count - 1).bit_length()))
    order = np.sort((grams >> bits << bits) | np.arange(count, dtype=U))
    place = (order & ((U(1) << bits) - U(1))).astype(np.int64)
    fresh = np.ones(count, dtype=bool)
    fresh[1:] = (order[1:] >> bits) != (order[:-1] >> bits)
    run = np.arange(count)
    earlier = run - np.maximum.accumulate(np.where(fresh, run, 0))
    grams[place] += earlier.astype(U) * U(0xD6E8FEB86659FD93)
    return grams


def slots(text: str) -> np.ndarray:
    """One 32-bit hash of the chosen tuple for every order; no text, no slots."""
    grams = numbered_kmers(text)
    if not len(grams):
        return np.zeros(0, dtype=np.uint32)
    take = min(LENGTH, len(grams))
    best = np.zeros((HASHES, 0), dtype=U)
    where = np.zeros((HASHES, 0), dtype=np.int64)
    for at in range(0, len(grams), BLOCK):
        values = grams[at : at + BLOCK] ^ ORDERS[:, None]
        values *= U(0xBF58476D1CE4E5B9)
        values ^= values >> U(32)
        rows = np.arange(HASHES)
        for _ in range(min(take, values.shape[1])):
            low = values.argmin(axis=1)
            best = np.concatenate((best, values[rows, low][:, None]), axis=1)
            where = np.concatenate((where, low[:, None] + at), axis=1)
            values[rows, low] = U(0xFFFFFFFFFFFFFFFF)
        if best.shape[1] > take:
            keep = np.argsort(best, axis=1, kind="stable")[:, :take]
            best = np.take_along_axis(best, keep, axis=1)
            where = np.take_along_axis(where, keep, axis=1)
    chosen = grams[np.sort(where, axis=1)]
    out = np.full(HASHES, U(take))
    for at in range(take):
        out = mix(out * STEP + chosen[:, at])
    return (out >> U(32)).astype(np.uint32)


def to_text(values: np.ndarray) -> str:
    return values.astype(">u4").tobytes().hex()


def likeness(a: str, b: str) -> float:
    """Share of equal slots; two empty fingerprints are alike, an empty and another are not."""
    if not a or not b:
        return float(a == b)
    size = 8
    same = sum(a[i : i + size] == b[i : i + size] for i in range(0, len(a), size))
    return same / (len(a) // size)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, fingerprint) of every whole text; null and empty texts have an empty
    fingerprint, repeated rows a row each. Other columns are not read."""

    def make(batches):
        for batch in batches:
            sizes, prints = [], []
            for text in texts(batch.column(1)):
                sizes.append(len(text))
                prints.append(to_text(slots(text)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(prints, pa.string())],
                ["doc_id", "n_chars", "fingerprint"],
            )

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return rows.mapInArrow(make, "doc_id long, n_chars long, fingerprint string")


ROW = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double"
)
NAMES = [part.split(" ")[0] for part in ROW.split(", ")]


def _compare(doc_id, text: str, own: str, follower: str, other: str) -> tuple:
    """A result row of a document from its text and fingerprint and the next document's."""
    half = len(text) // 2
    edited = text[: len(text) - half] + follower[:half]
    changed = to_text(slots(edited))
    digest = hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest()
    return (
        doc_id, len(text), digest, own, changed, likeness(own, changed), likeness(own, other),
    )


def edit_probe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of the text with its second half replaced by the beginning
    of the next document's, and how near they are.

    The next document is the one with the next smaller id; the one after the last is the
    first. Equal ids are ordered by a hash of the text and the text, null ids come last; a
    document that is alone is its own next. The rows are range-partitioned by id once; a document and its next meet inside
    a partition, and the few at the borders of partitions are joined by partition number.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    # The keys that place a row are sampled to the driver, so they hold no text.
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text").asc()]
    placed = (
        rows.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order, F.col("text").asc())
        .withColumn("part", F.spark_partition_id())
    )

    def walk(batches):
        """Result rows, and for each partition its first and its last document."""
        before = None
        for batch in batches:
            out = []
            part = batch.column(2)[0].as_py() if batch.num_rows else 0
            for doc_id, now in zip(batch.column(0), texts(batch.column(1)), strict=True):
                own = to_text(slots(now))
                if before is None:
                    out.append(("first", part, now, *[None] * 3, own, *[None] * 3))
                else:
                    out.append(("row", part, None, *_compare(*before, now, own)))
                before = (doc_id.as_py(), now, own)
            yield _border_rows(out)
        if before is not None:
            doc_id, now, own = before
            yield _border_rows([("last", part, now, doc_id, len(now), None, own, *[None] * 3)])

    walked = materialize(placed.mapInArrow(walk, f"kind string, part int, text string, {ROW}"), "walk")
    borders = walked.where("kind <> 'row'").select("kind", "part", "text", "doc_id", "fingerprint")
    # One row for each partition that has rows: the next one's number, and round to the first.
    used = sorted(r["part"] for r in borders.where("kind = 'last'").select("part").collect())
    if not used:
        return walked.select(*NAMES)
    links = spark.createDataFrame(list(zip(used, used[1:] + used[:1], strict=True)), "part int, after int")
    heads = borders.where("kind = 'first'").select(
        F.col("part").alias("after"), F.col("text").alias("_next"),
        F.col("fingerprint").alias("_other"),
    )
    ends = borders.where("kind = 'last'").join(links, "part").join(heads, "after")

    def close(batches):
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            yield _result_rows([_compare(*r) for r in zip(*columns, strict=True)])

    closed = ends.select("doc_id", "text", "fingerprint", "_next", "_other").mapInArrow(close, ROW)
    return walked.where("kind = 'row'").select(*NAMES).unionByName(closed)


TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def _result_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(NAMES)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, TYPES, strict=True)], NAMES
    )


def _border_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.string(), *TYPES]
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
        ["kind", "part", "text", *NAMES],
    )
