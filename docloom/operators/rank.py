"""BM25 scores and top-k."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.boolean import leading_clauses, verdict
from docloom.operators.index import Index
from docloom.operators.match import Batch, parse, pattern_hits, pattern_terms, word_hits
from docloom.plans.ordered import global_row_number
from docloom.plans.scratch import materialize

# Fixed values of the ranking formula.
K1 = 1.2
B = 0.75
FLOOR_IDF = 1e-6

# Scores closer than this are ties; floating-point sums differ in the last digits.
TIE_DIGITS = 12

# Documents of a query's strongest clauses that set the first mark, as a multiple of k; and how
# far below a mark a sum must stay to be out, more than rounding can shift it.
SEEDS = 4
SLACK = 1e-6
# Clauses are looked up in stages: those left for later can add less than such a share of the mark.
STAGES = (1.0, 0.6, 0.3)

# Bins of a query's scores, to find the one that holds its k-th.
BINS = 1024

SCORED = "query_id string, doc_id long, score double"


def idf(df: Column, n_docs: int) -> Column:
    raw = F.log((F.lit(n_docs) - df + 0.5) / (df + 0.5))
    return F.when(raw > 0, raw).otherwise(F.lit(FLOOR_IDF))


def bm25_part(weight: Column, f: Column, n_tokens: Column, avgdl: float) -> Column:
    norm = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * n_tokens / F.lit(avgdl))
    return weight * f * F.lit(K1 + 1) / (f + norm)


@dataclass(frozen=True)
class Lookup:
    """What a batch of queries needs of an index.

    ``clauses``: (query_id, source, clause_id, key, slot, n_slots, df, weight, bound); ``bound`` is
    what a clause can add to a score at most. ``hits`` are those of all patterns but plain words.
    """

    index: Index
    clauses: DataFrame
    terms: DataFrame
    hits: DataFrame

    def hits_of(self, keys: DataFrame, docs: DataFrame | None = None) -> DataFrame:
        """Hits of ``keys``, of all documents or of those in ``docs`` (doc_id)."""
        found = self.hits.join(keys.select("key").distinct(), "key", "left_semi")
        if docs is not None:
            found = found.join(docs, "doc_id", "left_semi")
        columns = ["key", "doc_id", "f", "n_tokens"]
        words = word_hits(self.terms, self.index, keys, docs)
        return found.select(columns).unionByName(words.select(columns))

    def part(self) -> Column:
        return bm25_part(F.col("weight"), F.col("f"), F.col("n_tokens"), self.index.avgdl)


def look_up_batch(batch: Batch, index: Index) -> Lookup:
    """Weights come from the dictionary for plain words, from the hits for other patterns."""
    terms = pattern_terms(batch, index)
    hits = pattern_hits(batch, terms, index)
    one, avgdl = F.lit(1.0), index.avgdl
    top = F.array_max(F.transform("levels", lambda x: bm25_part(one, x["f"], x["n"], avgdl)))
    facts = terms.filter("plain").select("pattern", "df", top.alias("top"))
    if batch.restricted or batch.positional:
        seen = hits.groupBy(F.col("key").alias("pattern")).agg(
            F.count("*").alias("df"),
            F.max(bm25_part(one, F.col("f"), F.col("n_tokens"), avgdl)).alias("top"),
        )
        facts = facts.unionByName(seen)
    clauses = batch.clauses.select("query_id", "source", "clause_id", "key", "slot", "n_slots", "pattern")
    clauses = clauses.join(facts, "pattern", "left").fillna(0, ["df"]).fillna(0.0, ["top"])
    clauses = clauses.withColumn("weight", idf(F.col("df"), index.n_docs))
    # An instance of a proximity clause counts within its phrase's hits, so that bound holds too.
    clauses = clauses.withColumn("bound", F.col("weight") * F.col("top")).drop("pattern", "top")
    return Lookup(index, materialize(clauses, "weighted"), terms, hits)


def filter_source(clauses: DataFrame, hits: DataFrame, corpus: DataFrame | None) -> DataFrame:
    """``clauses`` with the ``hits`` of their keys, of a query with a source in its documents only.

    The source is a key of the join, so a document meets the queries of its own source, however many
    others hold the same words. NULL means no restriction, as does a missing ``corpus``. Term and
    length statistics stay those of the whole corpus.
    """
    if corpus is None:
        return clauses.drop("source").join(hits, "key")
    free = clauses.filter("source IS NULL").drop("source").join(hits, "key")
    placed = hits.join(corpus.select("doc_id", "source").distinct(), "doc_id")
    bound = clauses.filter("source IS NOT NULL").join(placed, ["key", "source"])
    return free.unionByName(bound.drop("source"))


def bm25(queries: DataFrame | Batch, index: Index, corpus: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, score) of every matching document; lower scores are better.

    The candidates of a query come from its rarest required slot, by the frequencies of the
    dictionary; the other clauses are looked up for candidate documents only. A frequent word
    adds nothing for documents that cannot match anyway. Queries with programs: ``bm25_nested``.
    With ``corpus`` (doc_id, source) queries that name a source get documents of that source only.
    """
    batch = queries if isinstance(queries, Batch) else parse(queries)
    if not batch.queries:
        return index.postings.sparkSession.createDataFrame([], SCORED)
    if batch.programs is not None:
        return bm25_nested(batch, index, corpus)
    found = look_up_batch(batch, index)
    wanted = found.clauses.drop("df", "bound")
    if batch.single_slot:
        pairs = filter_source(wanted, found.hits_of(wanted), corpus)
    else:
        cost = found.clauses.filter("slot IS NOT NULL").groupBy("query_id", "slot")
        cost = cost.agg(F.sum("df").alias("cost"))
        rarest = cost.groupBy("query_id").agg(
            F.min_by("slot", F.struct("cost", "slot")).alias("slot")
        )
        pairs = candidate_pairs(found, wanted, wanted.join(rarest, ["query_id", "slot"]), corpus)
    scored = pairs.groupBy("query_id", "doc_id").agg(
        (-F.sum(F.when(F.col("slot").isNotNull(), found.part()))).alias("score"),
        F.size(F.collect_set("slot")).alias("met"),
        F.max("n_slots").alias("n_slots"),
        F.bool_or(F.col("slot").isNull()).alias("barred"),
    )
    keep = ~F.col("barred") & (F.col("n_slots") > 0) & (F.col("met") == F.col("n_slots"))
    return scored.filter(keep).select("query_id", "doc_id", "score")


def candidate_pairs(
    found: Lookup, wanted: DataFrame, leading: DataFrame, corpus: DataFrame | None = None
) -> DataFrame:
    """Hits of the ``wanted`` clauses in documents that hold one of the ``leading`` clauses."""
    leading = materialize(leading.select("query_id", "source", "key").distinct(), "leading")
    first = materialize(found.hits_of(leading), "first")
    # Spread by document as well: one query may hold a large share of all candidates.
    candidates = filter_source(leading, first, corpus).select("query_id", "doc_id")
    candidates = materialize(candidates.repartition("query_id", "doc_id").distinct(), "candidates")
    others = wanted.join(leading, "key", "left_anti")
    rest = found.hits_of(others, candidates.select("doc_id"))
    return candidates.join(wanted.drop("source"), "query_id").join(first.unionByName(rest), ["key", "doc_id"])


def bm25_nested(batch: Batch, index: Index, corpus: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, score, used) for queries with programs; ``used`` are the clauses that count.

    Each program is weighed with the document frequencies first: candidates are the documents of the
    cheapest clauses that every match must hold one of. The program is then run on what a
    candidate holds, which are as many values as its query has clauses at most.
    """
    found = look_up_batch(batch, index)
    wanted = found.clauses.drop("df", "bound")
    by_clause = F.map_from_entries(F.collect_list(F.struct("clause_id", "df")))
    costs = found.clauses.groupBy("query_id").agg(by_clause.alias("costs"))
    programs = batch.programs.filter(F.size("program") > 0).join(costs, "query_id")
    lead = leading_clauses(F.col("program"), F.col("costs")).alias("lead")
    programs = materialize(programs.select("query_id", "program", lead), "programs")
    leading = programs.select("query_id", F.explode("lead").alias("clause_id"))
    pairs = candidate_pairs(found, wanted, wanted.join(leading, ["query_id", "clause_id"]), corpus)
    held = pairs.groupBy("query_id", "doc_id").agg(
        F.map_from_entries(F.collect_list(F.struct("clause_id", found.part()))).alias("parts")
    )
    judged = held.join(programs.drop("lead"), "query_id").select(
        "query_id", "doc_id", verdict(F.col("program"), F.col("parts")).alias("v")
    )
    return judged.filter("v.met").select("query_id", "doc_id", (-F.col("v.score")).alias("score"), "v.used")


def bm25_best(batch: Batch, index: Index, k: int) -> DataFrame:
    """Scores of documents that can be among the ``k`` best, for queries of alternatives only.

    Clauses go by what they can add at most. Documents of the strongest are scored first, and the
    best of them in full: the k-th best document scores at least as much as the k-th of these. Clauses
    that together stay below this mark cannot make a document one of the best, so those which
    many documents hold are left to the end; only documents of the others (the essential clauses)
    are summed up, and of these only such as can still reach the mark are looked up in the rest.
    No document is left out that could be among the best.
    """
    found = look_up_batch(batch, index)
    columns = ["query_id", "clause_id", "key", "df", "weight", "bound"]
    clauses = found.clauses.select(columns)
    falling = Window.partitionBy("query_id").orderBy(F.desc("bound"), "clause_id")
    before = F.sum("df").over(falling.rowsBetween(Window.unboundedPreceding, -1))
    strong = clauses.withColumn("_before", F.coalesce(before, F.lit(0)))
    strong = strong.filter(F.col("_before") < SEEDS * k)
    hits = materialize(found.hits_of(strong), "strong")
    sums = strong.join(hits, "key").groupBy("query_id", "doc_id").agg(F.sum(found.part()).alias("sum"))
    seeds = materialize(_best(sums, SEEDS * k).select("query_id", "doc_id"), "seeds")
    scored = seeds.join(clauses, "query_id").join(
        found.hits_of(clauses, seeds.select("doc_id")), ["key", "doc_id"]
    )
    scored = scored.groupBy("query_id", "doc_id").agg(F.sum(found.part()).alias("sum"))
    # Sums over a query's own clauses, a row each: the most documents for the least of the mark.
    cheap = Window.partitionBy("query_id").orderBy(F.expr("bound / greatest(df, 1)"), "clause_id")
    below = F.sum("bound").over(cheap.rowsBetween(Window.unboundedPreceding, 0))
    stage = sum((F.when(below < F.col("kth") * s - SLACK, 1).otherwise(0) for s in STAGES), F.lit(0))
    ranked = clauses.join(_kth(scored, k), "query_id", "left").fillna(0.0, ["kth"])
    ranked = materialize(ranked.withColumn("stage", stage), "ranked")
    essential = ranked.filter("stage = 0")
    more = found.hits_of(essential.join(strong.select("key"), "key", "left_anti"))
    pairs = essential.join(hits.unionByName(more), "key")
    sums = pairs.groupBy("query_id", "doc_id").agg(F.sum(found.part()).alias("sum"))
    marks = ranked.groupBy("query_id").agg(
        F.first("kth").alias("kth"),
        *[F.coalesce(F.sum(F.when(F.col("stage") > i, F.col("bound"))), F.lit(0.0)).alias(f"left{i}")
          for i in range(len(STAGES))],
    )
    for i in range(len(STAGES)):
        able = sums.join(marks, "query_id").filter(F.col("sum") + F.col(f"left{i}") >= F.col("kth") - SLACK)
        able = materialize(able.select("query_id", "doc_id", "sum"), "able")
        weak = ranked.filter(F.col("stage") == i + 1)
        late = found.hits_of(weak, able.select("doc_id"))
        late = able.drop("sum").join(weak, "query_id").join(late, ["key", "doc_id"])
        parts = able.unionByName(late.select("query_id", "doc_id", found.part().alias("sum")))
        sums = parts.groupBy("query_id", "doc_id").agg(F.sum("sum").alias("sum"))
    return sums.select("query_id", "doc_id", (-F.col("sum")).alias("score"))


def _best(sums: DataFrame, k: int) -> DataFrame:
    """The ``k`` largest sums of each query and their rank."""
    best = Window.partitionBy("query_id").orderBy(F.desc("sum"))
    return sums.withColumn("_rank", F.row_number().over(best)).filter(F.col("_rank") <= k)


def _kth(sums: DataFrame, k: int) -> DataFrame:
    """(query_id, kth): the k-th largest sum of each query that has so many documents."""
    return _best(sums, k).filter(F.col("_rank") == k).select("query_id", F.col("sum").alias("kth"))


def top_k(scored: DataFrame, k: int = 10) -> DataFrame:
    """Best ``k`` rows per query with their rank; 0 gives none, a negative ``k`` all.

    The same plan for every ``k``: a histogram of each query's scores finds the bin that its k-th
    score is in, rows beyond that bin go, and the others are numbered over range partitions, so that
    one query's scores need not fit into one task.
    """
    rows = materialize(scored.withColumn("_tie", F.round("score", TIE_DIGITS)), "scored")
    if k >= 0:
        rows = _reaching(rows, k)
    ranked = global_row_number(rows, ["query_id"], ["_tie", "doc_id"], "rank")
    ranked = ranked.filter(F.col("rank") <= k) if k >= 0 else ranked
    return ranked.drop("_tie").withColumn("rank", F.col("rank").cast("long"))


def _reaching(rows: DataFrame, k: int) -> DataFrame:
    """Rows up to the bin that holds their query's k-th score; a query has ``BINS`` + 1 bins at most."""
    ends = rows.groupBy("query_id").agg(F.min("_tie").alias("_low"), F.max("_tie").alias("_high"))
    width = F.greatest(F.col("_high") - F.col("_low"), F.lit(10.0**-TIE_DIGITS))
    place = F.floor((F.col("_tie") - F.col("_low")) / width * BINS)
    placed = rows.join(ends, "query_id").withColumn("_bin", place)
    counts = placed.groupBy("query_id", "_bin").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("query_id").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    last = counts.filter(F.col("_before") < k).groupBy("query_id").agg(F.max("_bin").alias("_last"))
    return placed.join(last, "query_id").filter("_bin <= _last").select(rows.columns)
