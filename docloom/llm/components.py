"""Connected components of a large graph as repeated joins."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.plans.scratch import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that ``links`` (a, b) reach from each node.

    Every round takes the smallest label of the neighbours and then the label of that
    label, so the rounds grow with the logarithm of a component's diameter. Both steps are
    aggregations with partial sums; the edge list and the labels are written tables, so no
    round depends on an executor that may be lost. Nodes without links do not appear; null
    ends are ignored.
    """
    links = links.where("a is not null and b is not null and a <> b").select("a", "b")
    edges = materialize(
        links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
        "edges",
    )
    labels = materialize(
        edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
        .select("node", F.least("node", "m").alias("component")),
        "labels",
    )
    total = _total(labels)
    while True:
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").select(
            F.col("a").alias("node"), "component"
        )
        lower = near.unionByName(labels).groupBy("node").agg(F.min("component").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("far"))
        labels = materialize(
            lower.join(jump, "component", "left").select(
                "node", F.least("component", "far").alias("component")
            ),
            "labels",
        )
        before, total = total, _total(labels)
        if total == before:
            return labels


def _total(labels: DataFrame) -> object:
    """Labels only ever fall, so an unchanged sum means that none changed."""
    return labels.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]
