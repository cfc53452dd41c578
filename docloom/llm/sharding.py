"""Sharding by longest-processing-time scheduling.

Groups of equal texts stay together. The schedule depends on sizes only, so it is made from a
table of (group size, number of groups): the largest first, each to the least-loaded shard
through a heap. A table of D different sizes needs at least D * D / 2 bytes of text, so it has
at most 14 million rows for 100 TB; it is read one partition at a time and never kept whole.
Groups of one size are interchangeable: each shard takes a range of their running numbers.
"""

import heapq
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.plans.ordered import global_row_number
from docloom.plans.scratch import materialize, scratch_path

SHARDS = 8


def schedule(
    sizes: Iterable[tuple[int, int]], shards: int
) -> Iterator[tuple[int, int, int, int]]:
    """(size, from, to, shard) for (size, groups) by falling size; from and to are numbers of
    the groups of that size, to is exclusive.

    Runs of equal groups are dealt in whole rounds where the heap would do the same: once the
    loads lie within one size of each other, every shard takes one group a round.
    """
    heap = [(0, s) for s in range(shards)]
    for size, groups in sizes:
        takes = dict.fromkeys(range(shards), 0)
        while groups:
            low, high = heap[0][0], max(heap)[0]
            if high - low < size and groups >= shards:
                rounds = groups // shards
                heap = [(load + rounds * size, s) for load, s in heap]
                heapq.heapify(heap)
                for s in takes:
                    takes[s] += rounds
                groups -= rounds * shards
            else:
                # Up to the next load, or to the last group, the lowest shard keeps taking.
                load, shard = heapq.heappop(heap)
                gap = (heap[0][0] - load) // size if heap else groups
                count = min(groups, max(1, gap))
                heapq.heappush(heap, (load + count * size, shard))
                takes[shard] += count
                groups -= count
        at = 0
        for shard, count in takes.items():
            if count:
                yield size, at, at + count, shard
                at += count


def _chunks(rows: Iterator, count: int = 100_000) -> Iterator[list]:
    chunk = []
    for row in rows:
        chunk.append(row)
        if len(chunk) == count:
            yield chunk
            chunk = []
    yield chunk


def shard_documents(
    docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every document.

    Law ``bytes``: total sizes are near equal. A size is the text's UTF-8 bytes plus 1; a null
    text has no bytes and goes with the empty texts. Slots number a shard's documents from 0
    by (doc_id, checksum); a null id comes first, and rows alike in all of these are
    interchangeable. Other columns are not read. An empty table gives an empty result.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    spark = docs.sparkSession
    data = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = materialize(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            (F.octet_length(data) + 1).cast("long").alias("size"),
            F.crc32(data).alias("text_crc32"),
            F.sha2(data, 256).alias("_text"),
        ),
        "sizes",
    )
    groups = rows.groupBy("_text").agg(F.sum("size").alias("_total"))
    groups = global_row_number(groups, ["_total"], ["_text"], "_number")
    groups = materialize(groups, "groups")
    counts = materialize(groups.groupBy("_total").count(), "counts")
    falling = ((r["_total"], r["count"]) for r in counts.orderBy(F.desc("_total")).toLocalIterator())
    schema = "_total long, _from long, _to long, shard int"
    path = scratch_path(spark, "schedule")
    for chunk in _chunks(schedule(falling, shards)):
        spark.createDataFrame(chunk, schema).write.mode("append").parquet(path)
    plan = spark.read.schema(schema).parquet(path)
    number = F.col("_number") - 1
    placed = groups.join(plan, "_total").where((number >= F.col("_from")) & (number < F.col("_to")))
    sharded = rows.join(placed.select("_text", "shard"), "_text")
    numbered = global_row_number(sharded, ["shard"], ["doc_id", "text_crc32", "_text"], "slot")
    return numbered.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("slot") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
