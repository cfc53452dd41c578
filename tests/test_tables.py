"""Keyed reads of a stored corpus, the order of listed sources, clauses that make no sense."""

import json

import pytest
from pyspark.sql import functions as F

from docloom.operators.assign import assign_sources
from docloom.operators.match import clause, parse
from docloom.plans.local import local_table
from docloom.schemas import CORPUS, QUERIES
from docloom.sources.rules import read_sources
from docloom.sources.tables import read_corpus, update_corpus, write_corpus


def corpus(spark, first, count, text):
    return spark.range(first, first + count).select(
        F.col("id").alias("doc_id"),
        F.concat(F.lit("https://h.org/"), "id").alias("url"),
        F.lit("s").alias("source"),
        F.lit("t").alias("title"),
        F.lit(text).alias("content"),
        F.lit(text).alias("content_hash"),
        F.lit("2024-01-01").cast("timestamp").alias("fetched_at"),
    ).select(*CORPUS.names)


def files_read(df, column="content_hash"):
    """Files that scans with ``column`` opened, from the metrics of the executed plan.

    A second run of the same DataFrame would count none, as its files are already listed.
    """
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.executedPlan()
    found, todo = [], [plan]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "FileSourceScanExec" and column in node.schema().catalogString():
            found.append(node.metrics().apply("numFiles").value())
        if name.endswith("QueryStageExec"):
            todo.append(node.plan())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return sum(found)


def test_keys_read_their_buckets_only(spark, folder):
    path = folder + "/corpus"
    write_corpus(corpus(spark, 0, 2000, "old"), path, buckets=64)
    update_corpus(corpus(spark, 5, 3, "new"), path)
    keys = spark.createDataFrame([("https://h.org/6",), ("https://h.org/900",), ("https://h.org/x",), (None,)], "url string")
    found = read_corpus(spark, path, keys)
    assert {(r.doc_id, r.content) for r in found.collect()} == {(6, "new"), (900, "old")}
    opened = files_read(read_corpus(spark, path, keys))
    assert 0 < opened <= 6 < 64 <= files_read(read_corpus(spark, path))


def test_listed_sources_keep_their_order(spark, folder):
    listed = [{"name": n, "allowed_domains": ["h.org"], "start_urls": []} for n in ("zeta", "alpha")]
    listed.append({"name": "own", "allowed_domains": [], "source_ord": 9})
    (open(folder + "/s.json", "w")).write(json.dumps(listed, indent=1))
    sources = read_sources(spark, folder + "/s.json")
    assert [(r.name, r.source_ord) for r in sources.orderBy("source_ord").collect()] == [
        ("zeta", 0), ("alpha", 1), ("own", 9)
    ]
    pages = spark.createDataFrame([("https://h.org/",)], "url string")
    assert {(r.source, r.source_ord) for r in assign_sources(pages, sources).collect()} == {("zeta", 0), ("alpha", 1)}


def test_clauses_that_make_no_sense_raise(spark):
    with pytest.raises(ValueError, match="kind"):
        clause("a", "must")
    with pytest.raises(ValueError, match="titel"):
        clause("a", cols=["titel"])

    def batch(*queries):
        rows = [{"query_id": q, "clauses": [clause("a").asDict() | change], "source": None} for q, change in queries]
        return local_table(spark, rows, QUERIES)

    for bad, word in (
        (batch(("q", {"kind": "must"})), "kind"),
        (batch(("q", {"kind": None})), "kind"),
        (batch(("q", {"cols": [7]})), "column"),
        (batch(("q", {}), ("q", {})), "query_id"),
    ):
        with pytest.raises(ValueError, match=word):
            parse(bad)
    assert parse(batch(("q", {}), ("r", {}))).queries == 2
