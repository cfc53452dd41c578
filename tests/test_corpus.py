import random

import pytest
from pyspark.sql import functions as F

from docloom.functions.text import content_hash
from docloom.operators import corpus as C
from docloom.plans.ordered import global_lag, global_row_number
from docloom.schemas import CORPUS
from docloom.sources import tables

BATCH = (
    "url string, source string, source_ord int, seq long, title string, content string, "
    "fetched_at timestamp"
)


def sequential(stored, batch):
    """The plain loop: one version after the other."""
    rows = {r[1]: list(r) for r in stored}
    next_id = max([r[0] for r in stored], default=0) + 1
    flags = {}
    for url, source, order, seq, title, content, _ in sorted(batch, key=lambda r: (r[2], r[3])):
        known = rows.get(url)
        if known and known[4] == content:
            flags[(order, seq)] = "skipped"
        elif known:
            rows[url] = [known[0], url, source, title, content]
            flags[(order, seq)] = "updated"
        else:
            rows[url] = [next_id, url, source, title, content]
            next_id += 1
            flags[(order, seq)] = "inserted"
    return {tuple(r) for r in rows.values()}, flags


@pytest.mark.parametrize("seed", range(3))
def test_merge_equals_sequential_loop(spark, seed):
    rng = random.Random(seed)
    urls = [f"u{i}" for i in range(12)] + ["hot"] * 12
    stored = [(i + 1, f"u{i}", "old", f"t{i}", rng.choice("AB")) for i in range(0, 6)]
    batch = [
        (rng.choice(urls), f"s{order}", order, seq, f"t{order}-{seq}", rng.choice("ABC"), None)
        for order in range(3)
        for seq in rng.sample(range(100), 40)
    ]
    old = spark.createDataFrame(
        stored, "doc_id long, url string, source string, title string, content string"
    )
    old = old.withColumn("content_hash", content_hash(F.col("content")))
    old = old.withColumn("fetched_at", F.lit(None).cast("timestamp")).select(*CORPUS.names)
    new = spark.createDataFrame(batch, BATCH)
    flagged = C.flag_versions(new, old)
    merged = C.merge_corpus(old, C.changed_rows(new, flagged, old))
    rows, flags = sequential(stored, batch)
    got = {(r.doc_id, r.url, r.source, r.title, r.content) for r in merged.collect()}
    assert got == rows
    assert {(r.source_ord, r.seq): r.change for r in flagged.collect()} == flags
    names = spark.createDataFrame([("s0",), ("s1",), ("s2",), ("idle",)], "name string")
    for row in C.index_summary(names, flagged).collect():
        own = [f for (order, _), f in flags.items() if f"s{order}" == row.source]
        assert (row.processed, row.skipped) == (len(own), own.count("skipped"))
        assert row.updated == row.processed - row.skipped


def test_row_number_and_lag_over_a_group_of_many_partitions(spark):
    rows = spark.range(5000).select(
        F.when(F.col("id") % 10 < 7, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"),
        ((F.col("id") * 7919) % 5000).alias("o"),
        F.col("id").cast("string").alias("v"),
    )
    from pyspark.sql import Window

    w = Window.partitionBy("k").orderBy("o")
    numbered = global_row_number(rows, ["k"], ["o"], "n").withColumn("want", F.row_number().over(w))
    assert numbered.filter("n <> want").count() == 0 and numbered.count() == 5000
    lagged = global_lag(rows, ["k"], ["o"], F.col("v"), "p").withColumn("want", F.lag("v").over(w))
    assert lagged.filter("not (p <=> want)").count() == 0
    whole = global_row_number(rows, [], ["o"], "n")
    assert whole.filter(F.col("n") != F.col("o") + 1).count() == 0


def test_stored_corpus_grows_by_segments(spark, folder):
    path = folder + "/corpus"
    rows = spark.range(1, 40).select(
        F.col("id").alias("doc_id"),
        F.concat(F.lit("u"), "id").alias("url"),
        F.lit("s").alias("source"),
        F.lit("t").alias("title"),
        F.lit("c").alias("content"),
        F.lit("h").alias("content_hash"),
        F.lit(None).cast("timestamp").alias("fetched_at"),
    )
    assert tables.read_corpus(spark, path).count() == 0
    tables.write_corpus(rows, path)
    with pytest.raises(FileExistsError):
        tables.write_corpus(rows, path)
    change = rows.filter("doc_id in (3, 39)").withColumn("content", F.lit("new"))
    more = rows.filter("doc_id = 5").withColumn("url", F.lit("x")).withColumn("doc_id", F.lit(40).cast("long"))
    for _ in range(2):
        tables.update_corpus(change.unionByName(more), path)
        stored = tables.read_corpus(spark, path)
        assert stored.count() == 40
        assert {r.doc_id for r in stored.filter("content = 'new'").collect()} == {3, 39}
    # An update holds its own rows only, and one that broke off before its marker is not seen.
    assert spark.read.parquet(path + "/rows/segment=1").count() == 3
    lost = rows.withColumn("content", F.lit("lost")).withColumn("bucket", F.lit(0))
    lost.write.partitionBy("bucket").parquet(path + "/rows/segment=3")
    rows.select("url").write.parquet(path + "/replaced/segment=3")
    assert tables.read_corpus(spark, path).filter("content = 'lost'").count() == 0
    tables.update_corpus(change, path)
    tables.compact_corpus(spark, path, folder + "/compact")
    stored = tables.read_corpus(spark, folder + "/compact")
    assert stored.count() == 40 and stored.filter("content = 'new'").count() == 2
    assert C.get_document(stored, doc_id=3, url="u1").first().content == "new"
    assert C.get_document(stored, url="x").first().doc_id == 40
    assert C.get_document(stored, doc_id=999).first() is None
    with pytest.raises(ValueError):
        C.get_document(stored)
