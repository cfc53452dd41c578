"""Clauses of a query and the documents they hit.

A query is a row of the ``QUERIES`` table. Each clause is a phrase of one or more tokens:

* ``kind`` 'all' (required), 'any' (clauses with the same ``slot`` are alternatives, every
  slot is required) or 'not' (removes the document);
* ``cols`` restricts it to some indexed columns, ``prefix`` makes its last token a prefix,
  ``initial`` ties it to the start of a column;
* clauses of one query that share a ``near_group`` must lie within ``near`` tokens;
* kinds are conjunctions of alternatives. Deeper nesting takes a program (``boolean.py``), which
  stands in the place of kinds and slots.

Equal clauses of different queries are looked up once: hits belong to a *pattern* (tokens
plus restrictions), and queries only refer to patterns.
"""

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions.let import let
from docloom.functions.text import tokenize
from docloom.operators.index import Index, bucket_of, prefix_words
from docloom.plans.scratch import materialize
from docloom.plans.local import local_table
from docloom.schemas import CLAUSE, INDEXED, QUERIES

KINDS = ("all", "any", "not")


def clause(phrase, kind="all", slot=0, cols=None, prefix=False, initial=False):
    """One clause; ``cols`` are column names, a leading '-' excludes instead."""
    if kind not in KINDS:
        raise ValueError(f"kind of a clause: {kind}, not one of {', '.join(KINDS)}")
    if cols is not None:
        named = {c.lstrip("-") for c in cols}
        if not named <= set(INDEXED):
            raise ValueError(f"no indexed column {', '.join(sorted(named - set(INDEXED)))}")
        keep = all(c.startswith("-") for c in cols)
        cols = [i for i, name in enumerate(INDEXED) if (name in named) != keep]
    return Row(
        phrase=[phrase] if isinstance(phrase, str) else list(phrase),
        kind=kind,
        slot=slot,
        cols=cols,
        prefix=prefix,
        initial=initial,
        near_group=None,
        near=None,
    )


def near(phrases, distance=10, group=0, **options):
    """Clauses whose hits must lie within ``distance`` tokens of each other."""
    made = [clause(p, **options).asDict() for p in phrases]
    return [Row(**{**c, "near_group": group, "near": distance}) for c in made]


def queries_frame(spark: SparkSession, queries: dict, source=None) -> DataFrame:
    """``QUERIES`` table from ``{query_id: [clauses]}`` given on the driver."""
    return local_table(
        spark,
        [
            {"query_id": qid, "clauses": [c.asDict() for c in clauses], "source": source}
            for qid, clauses in queries.items()
        ],
        QUERIES,
    )


def text_queries(df: DataFrame, query_id: Column, text: Column, kind: str = "all") -> DataFrame:
    """``QUERIES`` table from plain text: every token is one clause of the given kind."""

    def as_clause(token):
        fixed = {"phrase": F.array(token), "kind": F.lit(kind), "slot": F.lit(0)}
        fixed |= {"prefix": F.lit(False), "initial": F.lit(False)}
        return F.struct(
            *[fixed.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in CLAUSE]
        )

    return df.select(
        query_id.cast("string").alias("query_id"),
        F.transform(tokenize(text), as_clause).alias("clauses"),
        F.lit(None).cast("string").alias("source"),
    )


def _with_pattern(clause: Column) -> Column:
    """A clause with its tokens and the pattern key that equal clauses share."""
    fields = [f.name for f in CLAUSE if f.name != "phrase"]
    tokens = F.flatten(F.transform(clause["phrase"], tokenize))

    def keyed(tokens):
        cols = F.concat_ws(",", clause["cols"].cast("array<string>"))
        pattern = F.concat_ws(
            "|",
            F.concat_ws(" ", tokens),
            F.when(clause["cols"].isNotNull(), F.concat(F.lit("c"), cols)).otherwise(""),
            F.when(clause["prefix"], "p").otherwise(""),
            F.when(clause["initial"], "i").otherwise(""),
        )
        return F.struct(
            tokens.alias("tokens"),
            pattern.alias("pattern"),
            *[clause[name].alias(name) for name in fields],
        )

    return let(tokens, keyed)


def clause_rows(queries: DataFrame) -> DataFrame:
    """One row per clause with its tokens, pattern key and hit key. Empty clauses vanish.

    The members of a proximity group are collected inside the query's own row, so this
    needs no shuffle.
    """
    parsed = queries.select(
        "query_id",
        F.nullif("source", F.lit("")).alias("source"),
        F.transform("clauses", _with_pattern).alias("clauses"),
    )

    def slot_key(c, i):
        own = F.when(c["kind"] == "all", F.concat(F.lit("a"), i))
        own = own.when(c["kind"] == "any", F.concat(F.lit("s"), c["slot"]))
        return F.when(F.size(c["tokens"]) > 0, own)

    slots = F.transform("clauses", slot_key)

    def numbered(c, i):
        return F.named_struct(
            *[part for n in ("near_group", "near", "pattern") for part in (F.lit(n), c[n])],
            F.lit("clause_id"),
            i,
            F.lit("size"),
            F.size(c["tokens"]),
        )

    close = F.transform("clauses", numbered)
    close = F.filter(close, lambda c: c["near_group"].isNotNull() & (c["size"] > 0))
    rows = parsed.select(
        "query_id",
        "source",
        close.alias("close"),
        F.size(F.array_compact(F.array_distinct(slots))).alias("n_slots"),
        F.posexplode(F.arrays_zip("clauses", slots.alias("slot_key"))).alias("clause_id", "z"),
    ).select("query_id", "source", "close", "n_slots", "clause_id", "z.clauses.*", "z.slot_key")
    rows = rows.filter(F.size("tokens") > 0)
    own_group = F.filter("close", lambda m: m["near_group"] == F.col("near_group"))
    rows = rows.withColumn("members", F.when(F.col("near_group").isNotNull(), own_group))
    spots = F.array_sort(
        F.transform("members", lambda m: F.struct(m["pattern"].alias("pattern"), m["clause_id"].alias("clause_id")))
    )
    member = F.array_position(spots, F.struct("pattern", "clause_id"))
    distance = F.array_max(F.col("members")["near"])
    near_key = F.concat_ws("&", distance.cast("string"), F.array_sort(F.col("members")["pattern"]))
    rows = rows.select(
        "query_id",
        "source",
        "clause_id",
        "tokens",
        "pattern",
        "kind",
        "cols",
        "prefix",
        "initial",
        F.col("slot_key").alias("slot"),
        "n_slots",
        F.when(F.col("members").isNotNull(), near_key).alias("near_key"),
        member.alias("member"),
        distance.alias("near"),
        F.when(F.col("members").isNotNull(), F.size("members")).alias("n_members"),
    )
    near_hit = F.concat(F.col("near_key"), F.lit("#"), F.col("member"))
    return rows.withColumn("key", F.coalesce(near_hit, "pattern"))


@dataclass(frozen=True)
class Batch:
    """Parsed queries: their clauses as a written table, and small facts about them that
    decide which parts of the plan are needed."""

    clauses: DataFrame
    queries: int
    restricted: bool
    positional: bool
    near: bool
    prefixes: bool
    single_slot: bool
    source_bound: bool
    programs: DataFrame | None = None


def _positional() -> Column:
    """Clauses that need token positions; the others only need counts."""
    return (F.size("tokens") > 1) | F.col("initial") | F.col("near_key").isNotNull()


def _plain() -> Column:
    """One whole word in any column: the dictionary knows all that its weight needs."""
    return ~_positional() & F.col("cols").isNull() & ~F.col("prefix")


def parse(queries: DataFrame) -> Batch:
    """Tokenise a ``QUERIES`` table once and look over it; every fact has a fixed size.

    Raises ValueError for a kind or a column that does not exist and for a repeated query_id. In a
    table with programs every query needs a sound one.
    """
    clauses = materialize(clause_rows(queries), "clauses")
    bad_cols = F.exists("cols", lambda c: (c < 0) | (c >= len(INDEXED)))
    row = clauses.agg(
        F.count_distinct("query_id").alias("queries"),
        F.bool_or(F.col("kind").isNull() | ~F.col("kind").isin(*KINDS)).alias("bad_kind"),
        F.bool_or(F.coalesce(bad_cols, F.lit(False))).alias("bad_cols"),
        (F.count("*") - F.count_distinct("query_id", "clause_id")).alias("repeated"),
        F.bool_or(~_positional() & ~_plain()).alias("restricted"),
        F.bool_or(_positional()).alias("positional"),
        F.bool_or(F.col("near_key").isNotNull()).alias("near"),
        F.bool_or("prefix").alias("prefixes"),
        F.bool_and((F.col("n_slots") == 1) & F.col("slot").isNotNull()).alias("single_slot"),
        F.bool_or(F.col("source").isNotNull()).alias("source_bound"),
    ).first()
    if row.bad_kind:
        raise ValueError(f"a clause has a kind that is not one of {', '.join(KINDS)}")
    if row.bad_cols:
        raise ValueError(f"a clause names a column beyond the {len(INDEXED)} indexed ones")
    if row.repeated:
        raise ValueError("a query_id occurs more than once")
    programs = None
    if "program" in queries.columns:
        from docloom.operators.boolean import well_formed, without_empty

        sound = well_formed(F.col("program"), F.size("clauses"))
        programs = materialize(queries.select("query_id", "program", sound.alias("sound")), "programs")
        if not programs.filter("NOT sound").isEmpty():
            raise ValueError("a query has no program, or one that is not sound")
        known = clauses.groupBy("query_id").agg(F.collect_set("clause_id").alias("known"))
        programs = programs.join(known, "query_id")
        programs = programs.select("query_id", without_empty(F.col("program"), F.col("known")).alias("program"))
    return Batch(
        clauses=clauses,
        queries=row.queries,
        restricted=bool(row.restricted),
        positional=bool(row.positional),
        near=bool(row.near),
        prefixes=bool(row.prefixes),
        single_slot=bool(row.single_slot),
        source_bound=bool(row.source_bound),
        programs=programs,
    )


def pattern_tokens(batch: Batch, index: Index) -> DataFrame:
    """(pattern, idx, term) look-ups. A prefix token is expanded over the sorted vocabulary."""
    # A word that is also part of a proximity clause is looked up once, with positions.
    patterns = batch.clauses.groupBy("pattern", "tokens", "cols", "prefix", "initial").agg(
        F.bool_or(_positional()).alias("positional"), F.bool_and(_plain()).alias("plain")
    )
    tokens = patterns.select(
        "pattern",
        "cols",
        "initial",
        "positional",
        "plain",
        "prefix",
        F.size("tokens").alias("n_terms"),
        F.posexplode("tokens").alias("idx", "term"),
    )
    if batch.prefixes:
        is_prefix = F.col("prefix") & (F.col("idx") == F.col("n_terms") - 1)
        cut = tokens.filter(is_prefix).drop("prefix").withColumnRenamed("term", "prefix")
        expanded = prefix_words(cut, index).drop("prefix").withColumnRenamed("word", "term")
        # A term of several index segments is in the vocabulary more than once.
        return tokens.filter(~is_prefix).drop("prefix").unionByName(expanded.distinct())
    return tokens.drop("prefix")


def pattern_terms(batch: Batch, index: Index) -> DataFrame:
    """``pattern_tokens`` with what the dictionary holds of each term: bucket, df and levels.

    Written once: it is small, and its measured size lets Spark broadcast it to the postings.
    """
    tokens = pattern_tokens(batch, index).withColumn("bucket", bucket_of(F.col("term"), index.buckets))
    return materialize(tokens.filter("n_terms > 0").join(index.dictionary, ["bucket", "term"]), "terms")


def look_up(terms: DataFrame, index: Index) -> DataFrame:
    """Postings of the wanted terms, by join on bucket and term.

    The dictionary's buckets prune the partitions of the postings at run time, for two terms as
    for thousands.
    """
    wanted = F.col("cols").isNull() | F.array_contains("cols", F.col("col"))
    terms = terms.filter("df > 0").drop("df", "levels")
    return index.postings.join(terms, ["bucket", "term"]).filter(wanted)


def word_hits(terms: DataFrame, index: Index, keys: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """(key, doc_id, f, n_tokens) of plain words among ``keys``, of all documents or of ``docs``."""
    wanted = terms.filter("plain").join(keys.select(F.col("key").alias("pattern")).distinct(), "pattern", "left_semi")
    found = look_up(wanted, index).select("pattern", "doc_id", "tf", "n_tokens")
    if docs is not None:
        found = found.join(docs, "doc_id", "left_semi")
    return found.groupBy(F.col("pattern").alias("key"), "doc_id").agg(
        F.sum("tf").alias("f"), F.max("n_tokens").alias("n_tokens")
    )


def phrase_starts(found: DataFrame) -> DataFrame:
    """(pattern, doc_id, col, starts): where all tokens of a pattern stand in a row."""
    grouped = found.groupBy("pattern", "doc_id", "col", "n_terms", "initial").agg(
        F.collect_list(F.struct("idx", "positions")).alias("parts"),
        F.max("n_tokens").alias("n_tokens"),
    )

    def shifted(idx):
        own = F.filter("parts", lambda part: part["idx"] == idx)
        return F.flatten(
            F.transform(own, lambda part: F.transform(part["positions"], lambda p: p - idx))
        )

    later = F.when(F.col("n_terms") > 1, F.sequence(F.lit(1), F.col("n_terms") - 1))
    later = F.coalesce(later, F.array().cast("array<int>"))
    starts = F.aggregate(
        later, shifted(F.lit(0)), lambda kept, idx: F.array_intersect(kept, shifted(idx))
    )
    grouped = grouped.withColumn("starts", starts)
    first = F.filter("starts", lambda p: p == 0)
    return (
        grouped.withColumn("starts", F.when(F.col("initial"), first).otherwise(F.col("starts")))
        .filter(F.size("starts") > 0)
        .select("pattern", "doc_id", "col", "n_terms", "starts", "n_tokens")
    )


def near_starts(batch: Batch, starts: DataFrame) -> DataFrame:
    """Instances that take part in a proximity match, one row per (key, doc_id, col, start).

    A phrase of ``len`` tokens at ``s`` reaches the positions s .. s+len+distance. A start M
    completes a match when every member reaches it; an instance takes part when such an M
    lies in its reach. Both are sweeps over the sorted starts of one document column, so no
    pairs are formed.
    """
    members = batch.clauses.filter(F.col("near_key").isNotNull())
    members = members.select("near_key", "member", "key", "pattern", "near", "n_members").distinct()
    rows = members.join(starts, "pattern").select(
        "near_key",
        "member",
        "key",
        "n_members",
        "doc_id",
        "col",
        "n_tokens",
        (F.col("n_terms") + F.col("near")).alias("span"),
        F.explode("starts").alias("start"),
    )
    place = ["near_key", "doc_id", "col"]
    following = F.lead("start").over(Window.partitionBy(*place, "member").orderBy("start"))
    end = F.least(F.col("start") + F.col("span"), F.coalesce(following - 1, F.lit(2**31 - 2)))
    events = rows.withColumn("end", end).withColumn(
        "event",
        F.explode(
            F.array(
                F.struct(F.col("start").alias("at"), F.lit(1).alias("step")),
                F.struct((F.col("end") + 1).alias("at"), F.lit(-1).alias("step")),
            )
        ),
    )
    by_place = Window.partitionBy(*place).orderBy("event.at")
    reached = F.sum("event.step").over(by_place.rangeBetween(Window.unboundedPreceding, 0))
    events = events.withColumn("reached", reached)
    complete = F.when(
        (F.col("event.step") == 1) & (F.col("reached") == F.col("n_members")), F.col("event.at")
    )
    nearest = F.min(complete).over(by_place.rangeBetween(0, Window.unboundedFollowing))
    return (
        events.withColumn("nearest", nearest)
        .filter((F.col("event.step") == 1) & (F.col("nearest") <= F.col("start") + F.col("span")))
        .select("key", "doc_id", "col", "start", "n_tokens")
    )


HITS = "key string, doc_id long, f long, n_tokens int"


def pattern_hits(batch: Batch, terms: DataFrame, index: Index) -> DataFrame:
    """(key, doc_id, f, n_tokens) of all patterns but plain words, written once: their
    frequencies, candidates and scores come from here."""
    parts = [index.postings.sparkSession.createDataFrame([], HITS)]
    if batch.restricted:
        found = look_up(terms.filter(~F.col("positional") & ~F.col("plain")), index)
        parts.append(
            found.groupBy(F.col("pattern").alias("key"), "doc_id").agg(
                F.sum("tf").alias("f"), F.max("n_tokens").alias("n_tokens")
            )
        )
    if batch.positional:
        starts = phrase_starts(look_up(terms.filter("positional"), index))
        if batch.near:
            starts = materialize(starts, "starts")
            close = near_starts(batch, starts).groupBy("key", "doc_id")
            parts.append(close.agg(F.count("*").alias("f"), F.max("n_tokens").alias("n_tokens")))
        parts.append(
            starts.groupBy(F.col("pattern").alias("key"), "doc_id").agg(
                F.sum(F.size("starts")).alias("f"), F.max("n_tokens").alias("n_tokens")
            )
        )
    if len(parts) == 1:
        return parts[0]
    return materialize(reduce(DataFrame.unionByName, parts[1:]), "hits")


def match_all(left: DataFrame, right: DataFrame) -> DataFrame:
    """AND of two document sets; nested groups are built by composing these three."""
    return left.intersect(right)


def match_any(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.union(right).distinct()


def match_not(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right, left.columns, "left_anti").distinct()
