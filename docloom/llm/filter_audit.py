"""Filter interaction audit by forward-backward path counting.

A state is the set of filters applied so far. An edge adds one filter, and what it removes
depends on its state alone, however the filters before it were ordered. Forward counts (orders
that reach a state) times backward counts (orders that leave it to the end) weigh the edges for
the Shapley sums; the steps of every single order are read from the same edges.

The data come in once, as numbers of rows for each set of failed filters, so all that follows
has a size fixed by the filters and the parts.
"""

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.plans.local import local_table
from docloom.plans.scratch import materialize

#: Words are runs of other characters than space and \t \n \v \f \r.
GAPS = r"[\x20\x09-\x0D]+"
FEWEST_WORDS = 200
DISTINCT_PERCENT = 50
CAPITALS_PERCENT = 3
SYMBOLS = "[#$%&*|]"


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions that a text decides alone, by name."""
    words = F.array_remove(F.split(text, GAPS), "")
    distinct = F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": F.size(words) < FEWEST_WORDS,
        "B": 100 * distinct.cast("long") < DISTINCT_PERCENT * F.size(words).cast("long"),
        "C": 100 * capitals.cast("long") > CAPITALS_PERCENT * F.length(text).cast("long"),
        "D": text.rlike(SYMBOLS),
    }


#: Name of the filter that fails copies of a text with a smaller id.
COPIES = "E"
NAMES = "ABCDE"


def paths(names: str) -> list[tuple[int, int, int]]:
    """(state, filter, weight) of every edge: how many orders of all filters pass along it."""
    count, full = len(names), (1 << len(names)) - 1
    edges = [(s, f) for s in range(full + 1) for f in range(count) if not s >> f & 1]
    forward, backward = [0] * (full + 1), [0] * (full + 1)
    forward[0] = backward[full] = 1
    # An edge leads to a larger number, so rising order settles a state before it is left.
    for state, f in edges:
        forward[state | 1 << f] += forward[state]
    for state, f in reversed(edges):
        backward[state] += backward[state | 1 << f]
    return [(s, f, forward[s] * backward[s | 1 << f]) for s, f in edges]


def steps(names: str) -> list[tuple[str, int, int, int]]:
    """(filter_order, step, state, filter) along every order."""
    out = []
    for order in permutations(range(len(names))):
        state = 0
        for step, f in enumerate(order, 1):
            out.append(("".join(names[i] for i in order), step, state, f))
            state |= 1 << f
    return out


def failure_counts(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    part_col: str = "lang",
) -> DataFrame:
    """(part, failed, n, good, toxic): rows by the set of filters that they fail.

    Equal texts fail the same text filters, so only narrow rows are grouped by a digest of the
    text, with partial sums: a large group of copies shrinks before it is moved.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    failed = F.lit(0)
    for name, condition in text_filters(F.col("_text")).items():
        failed = failed + F.when(condition, 1 << NAMES.index(name)).otherwise(0)
    rows = docs.select(
        F.col(id_col).cast("long").alias("_id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        text.alias("_text"),
    ).select("_id", "part", F.unhex(F.sha2("_text", 256)).alias("_key"), failed.alias("_failed"))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_id"))
    marks = marks.agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("_good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("_toxic"),
    )
    one = [F.count("*").alias("n"), F.count_if("_good").alias("good"), F.count_if("_toxic").alias("toxic")]
    per_id = rows.join(marks, "_id", "left").groupBy("_key", "part", "_id").agg(
        F.first("_failed").alias("_failed"), *one
    )
    sums = [F.sum(c).alias(c) for c in ("n", "good", "toxic")]
    # A null id is never smaller than another, nor is another smaller than it.
    idless = F.struct(
        *[F.coalesce(F.sum(F.when(F.col("_id").isNull(), F.col(c))), F.lit(0)).alias(c)
          for c in ("n", "good", "toxic")]
    )
    lowest = F.min(F.when(F.col("_id").isNotNull(), F.struct("_id", "n", "good", "toxic")))
    per_part = materialize(
        per_id.groupBy("_key", "part").agg(
            F.first("_failed").alias("_failed"), *sums, idless.alias("_idless"), lowest.alias("_low")
        ),
        "audit",
    )
    first = per_part.groupBy("_key").agg(F.min("_low._id").alias("_first"))
    # At most one row for each part and text is left, so this join has no large group.
    found = per_part.join(first, "_key")
    originals = F.col("_low._id") == F.col("_first")
    split = []
    for c in ("n", "good", "toxic"):
        kept = F.col(f"_idless.{c}") + F.when(originals, F.col(f"_low.{c}")).otherwise(0)
        split.append(kept.alias(c))
    kept = F.struct(F.col("_failed").alias("failed"), *split)
    copies = F.struct(
        F.col("_failed").bitwiseOR(1 << NAMES.index(COPIES)).alias("failed"),
        *[(F.col(c) - k).alias(c) for c, k in zip(("n", "good", "toxic"), split, strict=True)],
    )
    both = found.select("part", F.explode(F.array(kept, copies)).alias("_x"))
    return both.select("part", "_x.*").groupBy("part", "failed").agg(*sums)


def audit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    part_col: str = "lang",
) -> DataFrame:
    """One row per part, order of the filters and step: (part, filter_order, step, kept, removed,
    redundant, unique_fails, good_lost, toxic_lost, shapley).

    ``removed`` counts the rows that the step's filter takes from those that are left, ``kept``
    what stays, ``redundant`` the rows failing it that were gone already, ``unique_fails`` those
    that fail nothing else; ``shapley`` sums ``removed`` over all orders. A null text is empty; a
    null part is the part ''. Repeated rows count each, rows that repeat an id are no copies of
    one another; a null id is never smaller than another. A label counts if any of the label rows of an id has it; other
    columns are not read. An empty table has no parts and gives an empty result.
    """
    spark = docs.sparkSession
    counts = materialize(failure_counts(docs, labels, id_col, text_col, part_col), "failed")
    edges = []
    for state, f, weight in paths(NAMES):
        for failed in range(1 << len(NAMES)):
            hit, gone = failed >> f & 1, (failed & state) != 0
            edges.append({
                "failed": failed, "state": state, "filter": f, "weight": weight,
                "removes": int(hit and not gone), "keeps": int(not hit and not gone),
                "repeats": int(hit and gone), "alone": int(failed == 1 << f),
            })
    fields = [T.StructField(name, T.LongType()) for name in edges[0]]
    # 80 edges and 32 sets for five filters: fixed, whatever the data.
    table = local_table(spark, edges, T.StructType(fields))
    lost = F.col("removes")
    per_edge = counts.join(table, "failed").groupBy("part", "state", "filter", "weight").agg(
        F.sum(F.col("keeps") * F.col("n")).alias("kept"),
        F.sum(lost * F.col("n")).alias("removed"),
        F.sum(F.col("repeats") * F.col("n")).alias("redundant"),
        F.sum(F.col("alone") * F.col("n")).alias("unique_fails"),
        F.sum(lost * F.col("good")).alias("good_lost"),
        F.sum(lost * F.col("toxic")).alias("toxic_lost"),
    )
    per_edge = materialize(per_edge, "edges")
    shapley = per_edge.groupBy("part", "filter").agg(
        F.sum(F.col("weight") * F.col("removed")).alias("shapley")
    )
    order = [dict(zip(("filter_order", "step", "state", "filter"), s, strict=True)) for s in steps(NAMES)]
    walk = local_table(
        spark, order,
        T.StructType([
            T.StructField("filter_order", T.StringType()), T.StructField("step", T.IntegerType()),
            T.StructField("state", T.LongType()), T.StructField("filter", T.LongType()),
        ]),
    )
    rows = per_edge.join(shapley, ["part", "filter"]).join(walk, ["state", "filter"])
    return rows.select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost",
        "toxic_lost", "shapley",
    )
