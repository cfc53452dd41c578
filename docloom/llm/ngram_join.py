"""N-gram Jaccard join with adaptive multi-match prefixes.

Each distinct shingle set is one vertex, so exact copies cost nothing further. Two sets with
Jaccard similarity of at least ``t`` share at least ``t`` times either's size. In any common
order of the shingles, the first ``n - ceil(t n) + l`` of both therefore have ``l`` in common
(for every ``l``), which gives three exact filters:

1. In hash order, which needs no statistics, with ``l = 1 + n // SPARE``: sets too few of whose
   prefix shingles occur in another set's prefix cannot link. Most documents end here, having
   shuffled about a third of their shingles.
2. The sets that remain are ordered by document frequency. Each set chooses its own ``l`` from
   the estimated cost of its candidates; a pair must share as many prefix shingles as the
   smaller ``l`` of the two asks for.
3. In each shingle's group one pivot, the set with the fewest shingles of its own, is verified
   against all others. Its links are merged into components; what is left are pairs from
   different components. How both differ from the pivot, kept as bit signatures of a fixed
   size, bounds their overlap from above, so a large group of copies is verified about as
   often as it has members.

Every verification compares whole sets. Nothing is capped or sampled.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import U, bit_filter, fresh, give_back, mix, passes, utf8
from docloom.llm.components import components
from docloom.llm.shingles import shingle_set
from docloom.plans.scratch import materialize

#: 64-bit hashes of shingles; the first filter shuffles only this many of their bits.
TOKEN_BITS = 48
#: Fixed sizes (8 MB) of the filters that save shuffling ahead of exact joins.
FILTER_BITS = 26
#: One more match is asked for, and one more prefix shingle read, per so many shingles.
SPARE = 12
#: Longest prefix that a set may choose: so many matches.
MATCHES = 4
#: Longs in the signature of a difference between two sets.
SIGNATURE = 8
#: Cost of verifying a candidate, in postings read.
VERIFY = 8


def _vertex(shingles: np.ndarray) -> int:
    """Identifies a set of hashes by an order-independent 64-bit sum of their mixes."""
    total = np.add.reduce(mix(shingles ^ U(0x5851F42D4C957F2D)), keepdims=True)
    return int(mix(total + U(len(shingles)))[0])


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
    values = np.concatenate(rows) if rows else np.zeros(0, dtype=U)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def _blocks(batches, column: int, most: int = 200_000):
    """(row numbers, sets) of a few documents at a time, with the batch they are from."""
    for batch in batches:
        rows, sets, size = [], [], 0
        for at, text in enumerate(utf8(batch.column(column))):
            rows.append(at)
            sets.append(shingle_set(text))
            size += len(sets[-1])
            if size >= most:
                yield batch, rows, sets
                rows, sets, size = [], [], 0
        if rows:
            yield batch, rows, sets
    batch = None
    give_back()


def _cut(shingles: np.ndarray, over: int, under: int) -> np.ndarray:
    """The hash-order prefix of a set, ``TOKEN_BITS`` of each hash."""
    n = len(shingles)
    return shingles[: n + -over * n // under + 1 + n // SPARE] >> U(64 - TOKEN_BITS)


def _prefixes(texts: DataFrame, over: int, under: int) -> DataFrame:
    """(token): the hash-order prefix of each distinct set of a task."""

    def cut(batches):
        done: set[int] = set()
        for _, _, sets in _blocks(batches, 0):
            tokens = []
            for s in sets:
                if len(s) and (key := _vertex(s)) not in done:
                    done.add(key)
                    tokens.append(_cut(s, over, under))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64))], ["token"])

    return texts.mapInArrow(cut, "token long")


def document_sets(
    docs: DataFrame, id_col: str, text_col: str, over: int, under: int, known
) -> DataFrame:
    """(doc_id, vertex, n_shingles, tokens) of every document; vertex is null for an empty set.
    The first document of a vertex in a task has the tokens of its prefix that pass ``known``."""

    def read(batches):
        done: set[int] = set()
        for batch, rows, sets in _blocks(batches, 1):
            keys, tokens = [], []
            for s in sets:
                key = _vertex(s) if len(s) else None
                if key is None or key in done:
                    tokens.append(None)
                else:
                    done.add(key)
                    prefix = _cut(s, over, under)
                    prefix = prefix[passes(known.value, prefix, TOKEN_BITS, FILTER_BITS)]
                    tokens.append(prefix.view(np.int64))
                keys.append(None if key is None else _signed(key))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(rows[0], len(rows)),
                    pa.array(keys, pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(tokens, pa.list_(pa.int64())),
                ],
                ["doc_id", "vertex", "n_shingles", "tokens"],
            )

    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string"))
    return ids.mapInArrow(read, "doc_id long, vertex long, n_shingles long, tokens array<long>")


def _sets(texts: DataFrame, known) -> DataFrame:
    """(vertex, shingles) of the sets that pass ``known``; a task may repeat another's."""

    def pick(batches):
        done: set[int] = set()
        for _, _, sets in _blocks(batches, 0):
            keys, kept = [], []
            for s in sets:
                if not len(s) or (key := _vertex(s)) in done:
                    continue
                if passes(known.value, np.array([key], dtype=U), 64, FILTER_BITS)[0]:
                    done.add(key)
                    keys.append(_signed(key))
                    kept.append(s)
            if kept:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), _lists(kept)], ["vertex", "shingles"]
                )

    return texts.mapInArrow(pick, "vertex long, shingles array<long>")


def _need(n, over: int, under: int):
    """ceil(n * over / under) as a column."""
    return F.floor((n * over + (under - 1)) / under).cast("int")


def _candidates(
    docs: DataFrame, id_col: str, text_col: str, over: int, under: int
) -> tuple[DataFrame, DataFrame]:
    """(doc_id, vertex, n_shingles) of all documents, and (vertex, shingles) of every set that the
    hash-order prefixes cannot rule out. Texts are read three times: for the counts of prefix
    tokens, for the documents with the tokens that occur again, and for the sets that remain."""
    spark = docs.sparkSession
    texts = docs.select(F.col(text_col).cast("string"))
    counts = _prefixes(texts, over, under).groupBy("token").count()
    shared = materialize(counts.where("count > 1").select("token"), "shared")
    known = spark.sparkContext.broadcast(bit_filter(shared, "token", TOKEN_BITS, FILTER_BITS))
    info = materialize(document_sets(docs, id_col, text_col, over, under, known), "doc-sets")
    # A task counts a set once, so a count above 1 may still come from copies in other tasks.
    postings = info.select(
        "vertex", F.col("n_shingles").cast("int").alias("n"), F.explode("tokens").alias("token")
    ).distinct()
    matched = postings.join(shared, "token").select("vertex", "n", "token")
    matched = materialize(matched, "matched")
    spread = matched.groupBy("token").agg(
        F.min("vertex").alias("_low"), F.max("vertex").alias("_high")
    )
    met = matched.join(spread.where("_low <> _high"), "token")
    least = 1 + F.floor(_need(F.col("n"), over, under) / SPARE)
    alive = materialize(
        met.groupBy("vertex", "n").count().where(F.col("count") >= least).select("vertex"),
        "alive",
    )
    mask = spark.sparkContext.broadcast(bit_filter(alive, "vertex", 64, FILTER_BITS))
    found = _sets(texts, mask).join(alive, "vertex", "left_semi")
    sets = found.groupBy("vertex").agg(F.first("shingles").alias("shingles"))
    return info.drop("tokens"), materialize(sets, "sets")


def _adaptive(sets: DataFrame, over: int, under: int) -> DataFrame:
    """(token, vertex, n, shared, level, after, matches): the prefixes that the sets choose.

    ``shared`` counts the shingles of a set that occur in another one, ``after`` those from
    this one on; ``level`` is the number of matches for which the prefix first reaches the
    shingle, ``matches`` the number that the set has chosen.
    """
    tokens = sets.select("vertex", F.size("shingles").alias("n"), F.explode("shingles").alias("token"))
    often = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    mine = tokens.join(often, "token").groupBy("vertex", "n").agg(
        F.sort_array(F.collect_list(F.struct("df", "token"))).alias("order")
    )
    need = _need(F.col("n"), over, under)
    mine = mine.withColumn("shared", F.size("order")).where(F.col("shared") >= need)
    # The shingles that occur nowhere else come first in the order and match nothing.
    room = F.col("n") - need + MATCHES - (F.col("n") - F.col("shared"))
    mine = mine.withColumn("order", F.slice("order", 1, F.greatest(room, F.lit(0))))
    mine = mine.withColumn("_start", F.col("shared") - need)
    mine = mine.withColumn(
        "order",
        F.transform(
            "order",
            lambda x, i: F.struct(
                x["token"].alias("token"),
                x["df"].alias("df"),
                F.greatest(F.lit(1), i - F.col("_start") + 1).cast("int").alias("level"),
                (F.col("shared") - i).alias("after"),
            ),
        ),
    )

    def cost(matches: int):
        read = F.aggregate(
            F.filter("order", lambda x: x["level"] <= matches),
            F.lit(0).cast("long"),
            lambda total, x: total + x["df"],
        )
        # At most read / matches candidates can meet the set that often.
        return F.struct((read + read * VERIFY / matches).alias("cost"), F.lit(matches).alias("m"))

    best = F.least(*[cost(m) for m in range(1, MATCHES + 1)])
    mine = mine.withColumn("matches", F.least(best["m"], F.greatest(need, F.lit(1))))
    return mine.select(
        "vertex", "n", "shared", "matches", F.explode("order").alias("_p")
    ).select(
        F.col("_p.token").alias("token"), "vertex", "n", "shared", "matches",
        F.col("_p.level").alias("level"), F.col("_p.after").alias("after"),
    ).where("level <= matches")


def _overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, overlap, na, nb): sizes of the intersections of whole sets."""
    right = sets.select(F.col("vertex").alias("b"), F.col("shingles").alias("_right"))
    left = sets.select(F.col("vertex").alias("a"), F.col("shingles").alias("_left"))
    both = pairs.join(right, "b").join(left, "a")
    return both.select(
        "a", "b",
        F.size(F.array_intersect("_left", "_right")).alias("overlap"),
        F.size("_left").alias("na"),
        F.size("_right").alias("nb"),
    )


def _linked(over: int, under: int):
    return F.col("overlap") * under >= over * (F.col("na") + F.col("nb") - F.col("overlap"))


def _signature(values):
    """Bits set by hashed values, as SIGNATURE longs."""

    def bits(k):
        own = F.filter(values, lambda v: v.bitwiseAND(SIGNATURE - 1) == k)
        place = F.transform(own, lambda v: F.shiftright(v, 8).bitwiseAND(63).cast("int"))
        return F.aggregate(
            place, F.lit(0).cast("long"),
            lambda acc, at: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), at)),
        )

    return F.array(*[bits(k) for k in range(SIGNATURE)])


def _differences(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``_overlaps`` with what b lacks of a and has besides it: counts and signatures."""
    right = sets.select(F.col("vertex").alias("b"), F.col("shingles").alias("_right"))
    left = sets.select(F.col("vertex").alias("a"), F.col("shingles").alias("_left"))
    both = pairs.join(right, "b").join(left, "a").select(
        "a", "b",
        F.size("_left").alias("na"), F.size("_right").alias("nb"),
        F.array_except("_left", "_right").alias("_lacks"),
        F.array_except("_right", "_left").alias("_adds"),
    )
    return both.select(
        "a", "b", "na", "nb",
        (F.col("na") - F.size("_lacks")).alias("overlap"),
        _signature("_lacks").alias("lacks"),
        _signature("_adds").alias("adds"),
    )


def _common(name: str, counts):
    """Upper bound of the values that two differences share: those on common bits, besides
    values that fell on a bit already set."""

    def ones(array):
        return F.aggregate(array, F.lit(0), lambda acc, v: acc + F.bit_count(v))

    x, y = F.col(f"x.{name}"), F.col(f"y.{name}")
    met = ones(F.zip_with(x, y, lambda p, q: p.bitwiseAND(q)))
    hidden = F.least(counts[0] - ones(x), counts[1] - ones(y))
    return met + hidden


def set_links(sets: DataFrame, over: int, under: int) -> DataFrame:
    """(a, b): links that connect exactly the sets that all links connect."""
    postings = materialize(_adaptive(sets, over, under), "postings")
    pivots = postings.groupBy("token").agg(
        F.max_by("vertex", F.struct(F.col("shared") / F.col("n"), "vertex")).alias("pivot"),
        F.count("*").alias("_size"),
    )
    grouped = materialize(postings.join(pivots.where("_size > 1"), "token").drop("_size"), "grouped")
    stars = grouped.where("pivot <> vertex").select(
        F.col("pivot").alias("a"), F.col("vertex").alias("b")
    ).distinct()
    measured = materialize(_differences(stars, sets), "measured")
    first = measured.where(_linked(over, under)).select("a", "b")
    merged = components(first)

    # Members of the groups that still span several components.
    members = grouped.where("pivot <> vertex").join(
        merged.withColumnRenamed("node", "vertex"), "vertex", "left"
    ).withColumn("component", F.coalesce("component", "vertex"))
    members = materialize(members, "members")
    mixed = members.groupBy("token").agg(
        F.min("component").alias("_low"), F.max("component").alias("_high")
    )
    known = measured.select(
        F.col("a").alias("pivot"), F.col("b").alias("vertex"),
        F.col("na").alias("size"), "overlap", "lacks", "adds",
    )
    members = members.join(mixed.where("_low <> _high"), "token", "left_semi").join(
        known, ["pivot", "vertex"]
    )
    x, y = members.alias("x"), members.alias("y")

    def both(name):
        return F.col(f"x.{name}"), F.col(f"y.{name}")

    total = F.col("x.n") + F.col("y.n")
    asked = F.least(*both("matches"))
    lacks = [size - overlap for size, overlap in zip(both("size"), both("overlap"), strict=True)]
    adds = [n - overlap for n, overlap in zip(both("n"), both("overlap"), strict=True)]
    within = F.col("x.overlap") + F.col("y.overlap") - F.col("x.size")
    loose = within + F.least(*lacks) + F.least(*adds)
    tight = within + _common("lacks", lacks) + _common("adds", adds)
    pairs = x.join(
        y,
        (F.col("x.token") == F.col("y.token"))
        & (F.col("x.vertex") < F.col("y.vertex"))
        & (F.col("x.component") != F.col("y.component"))
        & (F.greatest(*both("level")) <= asked)
        # The first ``asked`` common shingles have nearly all of the overlap after them.
        & ((F.least(*both("after")) + asked - 1) * (over + under) >= total * over)
        & (loose * (over + under) >= total * over)
        & (tight * (over + under) >= total * over),
    )
    met = pairs.groupBy(F.col("x.vertex").alias("a"), F.col("y.vertex").alias("b")).agg(
        F.count("*").alias("_met"), F.first(asked).alias("_asked")
    )
    rest = _overlaps(met.where("_met >= _asked").select("a", "b"), sets)
    return first.unionByName(rest.where(_linked(over, under)).select("a", "b"))


def _membership(docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """(doc_id, vertex, n_shingles, component, component_id); an empty set has neither a
    vertex nor a component. ``component`` is a vertex, as rows may repeat ids."""
    if not 50 <= percent <= 100:
        raise ValueError("percent must be from 50 to 100")
    over, under = percent, 100
    info, sets = _candidates(docs, id_col, text_col, over, under)
    merged = components(set_links(sets, over, under)).withColumnRenamed("node", "vertex")
    lowest = info.where("vertex is not null").groupBy("vertex").agg(F.min("doc_id").alias("low"))
    lowest = lowest.join(merged, "vertex", "left").withColumn(
        "component", F.coalesce("component", "vertex")
    )
    lowest = materialize(lowest, "lowest")
    least = lowest.groupBy("component").agg(F.min("low").alias("component_id"))
    return info.join(lowest.drop("low").join(least, "component"), "vertex", "left")


def jaccard_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    percent: int = 75,
) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document.

    Two documents link when their sets of 5-word shingles have a Jaccard similarity of at
    least ``percent`` / 100; ``component_id`` is the smallest id that links reach. Null and
    blank texts have an empty set, link with nothing and keep their own id; rows that repeat
    an id or a text give one row each; a null id does not count as smallest. Other columns
    are not read. An empty table gives an empty result.
    """
    return _membership(docs, id_col, text_col, percent).select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75
) -> DataFrame:
    """One row of each component, with all its columns.

    The document with the smallest id stays; of rows that repeat this id within a component,
    one stays. Rows without an id or without words belong to no group and stay.
    """
    members = materialize(_membership(docs, id_col, text_col, percent), "members")
    first = members.where("doc_id = component_id").groupBy("doc_id", "component").agg(
        F.min("vertex").alias("vertex")
    )
    kept = materialize(first.select("doc_id", "vertex"), "kept")
    doc, vertex, found = (fresh(docs, n) for n in ("_doc", "_vertex", "_found"))
    named = kept.select(
        F.col("doc_id").alias(doc), F.col("vertex").alias(vertex), F.lit(True).alias(found)
    )
    rows = _with_vertex(docs, text_col, vertex).withColumn(doc, F.col(id_col).cast("long"))
    rows = rows.join(named, [doc, vertex], "left")
    alone = F.col(doc).isNull() | F.col(vertex).isNull()
    rows = rows.where(alone | F.col(found))
    repeated = members.join(kept, ["doc_id", "vertex"], "left_semi").groupBy("doc_id", "vertex")
    if repeated.count().where("count > 1").limit(1).count():
        # Rows that stand alone keep a number of their own, so that none of them is lost.
        number = F.when(alone, F.monotonically_increasing_id())
        once = fresh(docs, "_once")
        rows = rows.withColumn(once, number).dropDuplicates([doc, vertex, once])
    return rows.select(*docs.columns)


def _with_vertex(docs: DataFrame, text_col: str, name: str) -> DataFrame:
    """All rows and columns of ``docs`` with the vertex of the text."""
    at, names = docs.columns.index(text_col), docs.columns

    def add(batches):
        for batch, rows, sets in _blocks(batches, at):
            keys = [_signed(_vertex(s)) if len(s) else None for s in sets]
            part = batch.slice(rows[0], len(rows))
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(keys, pa.int64())], [*names, name]
            )

    return docs.mapInArrow(add, T.StructType(list(docs.schema.fields)).add(name, "long"))
