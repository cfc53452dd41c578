"""Choice of the extract window and its mark-up, as column expressions.

The text is cut into tokens and the gaps around them (one gap more than tokens), so positions of
hits address tokens directly and an extract is put together from pieces, without character offsets.
Work per text is linear in its tokens, plus the hits inside one window for each hit.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.let import let
from docloom.functions.text import DROPPED_MARKS, TOKEN_BREAK

# Length of an extract in tokens, the marks around hits, the mark of a cut
# and the scores that choose the window.
WINDOW = 12
OPEN, CLOSE, CUT = "[", "]", "..."
NEW_PHRASE, REPEAT, AT_SENTENCE, AT_START = 1000, 1, 100, 120

# A token as functions.text breaks them, with the marks that it drops; these only continue a token.
_LETTERS, _MARKS = TOKEN_BREAK[2:-2], DROPPED_MARKS[1:-1]
_TOKEN = f"[{_LETTERS}][{_LETTERS}{_MARKS}]*+"

# A sentence ends in a gap with one of these signs before closing white space.
_SENTENCE_END = r"[.:][ \t\n\r]+\z"

HITS = "array<struct<start:int,phrase:int,size:int>>"
_RUNS = "array<struct<start:int,end:int>>"


def _sentence_at(gaps: Column, count: Column) -> Column:
    """For every token the number of the token that opens its sentence."""
    numbers = F.sequence(F.lit(0), count - 1)
    opens = F.filter(numbers, lambda i: (i == 0) | F.get(gaps, i).rlike(_SENTENCE_END))

    def spread(opens):
        def own(first, i):
            following = F.coalesce(F.get(opens, i + 1), count)
            return F.array_repeat(first, following - first)

        return F.flatten(F.transform(opens, own))

    return let(opens, spread)


def _first_hit_at(hits: Column) -> Column:
    """For every token up to the last hit's the number of hits that start before it."""

    def upto(hit, i):
        before = F.coalesce(F.get(hits, i - 1)["start"], F.lit(-1))
        return F.array_repeat(i, hit["start"] - before)

    return F.flatten(F.transform(hits, upto))


def _best_begin(hits: Column, first_hit: Column, sentence: Column, count: Column) -> Column:
    """First token of the best window; the earliest candidate wins a tie.

    Candidates are the windows from each hit on, moved so that their hits are centred, and those
    from the opening of its sentence. Two counts bound the hits of a window, in a slice.
    """

    def hits_before(token):
        return F.coalesce(F.get(first_hit, token), F.size(hits))

    def within(token):
        start = hits_before(token)
        return F.slice(hits, start + 1, hits_before(token + WINDOW) - start)

    def score(inside):
        phrases = F.size(F.array_distinct(inside["phrase"]))
        return phrases * NEW_PHRASE + (F.size(inside) - phrases) * REPEAT

    def candidate(score, order, begin):
        return F.struct(score.alias("score"), order.alias("order"), begin.cast("int").alias("begin"))

    def candidates(start, i):
        def centred(inside):
            last = F.element_at(inside, -1)
            spare = F.lit(WINDOW) - (last["start"] + last["size"] - start)
            begin = F.least(start - (spare / 2).cast("int"), count - WINDOW)
            return candidate(score(inside), -2 * i, F.greatest(F.lit(0), begin))

        def opening(first):
            bonus = F.when(first == 0, AT_START).otherwise(AT_SENTENCE)
            made = let(within(first), lambda inside: candidate(score(inside) + bonus, -2 * i - 1, first))
            return F.when((count > WINDOW) & (first < start), made)

        return F.array(let(within(start), centred), let(F.get(sentence, start), opening))

    places = F.array_distinct(hits["start"])
    return F.coalesce(F.array_max(F.flatten(F.transform(places, candidates)))["begin"], F.lit(0))


def _runs(hits: Column, begin: Column, last: Column) -> Column:
    """Overlapping hits as one marked run each; a run that starts before the window has no mark.

    A hit reaches as far as the longest phrase, so hits further before the window do not matter.
    """
    longest = F.array_max(hits["size"])
    close = F.filter(hits, lambda h: (h["start"] > begin - longest) & (h["start"] <= last))

    def run(start, end):
        return F.array(F.struct(start.alias("start"), end.cast("int").alias("end")))

    def merge(runs, hit):
        end = hit["start"] + hit["size"] - 1
        open_run = F.element_at(runs, -1)
        wider = run(open_run["start"], F.greatest(open_run["end"], end))
        longer = F.concat(F.slice(runs, F.lit(1), F.size(runs) - 1), wider)
        overlaps = (F.size(runs) > 0) & (hit["start"] <= F.get(runs, F.size(runs) - 1)["end"])
        return F.when(overlaps, longer).otherwise(F.concat(runs, run(hit["start"], end)))

    runs = F.aggregate(close, F.array().cast(_RUNS), merge)
    shown = F.filter(runs, lambda r: r["start"] >= begin)
    return F.transform(
        shown, lambda r: F.struct(r["start"].alias("start"), F.least(r["end"], last).alias("end"))
    )


def extract(text: Column, hits: Column) -> Column:
    """The extract of ``text`` for its ``hits``, sorted instances of phrases by token number.

    No hits give the beginning of the text, a text without tokens comes back whole, NULL gives NULL.
    """
    parts = F.struct(
        F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)).alias("tokens"),
        F.split(text, _TOKEN, -1).alias("gaps"),
        hits.cast(HITS).alias("hits"),
    )

    def measured(p):
        return F.struct(
            p.alias("p"),
            _first_hit_at(p["hits"]).alias("first_hit"),
            _sentence_at(p["gaps"], F.size(p["tokens"])).alias("sentence"),
        )

    def placed(m):
        count = F.size(m["p"]["tokens"])
        begin = _best_begin(m["p"]["hits"], m["first_hit"], m["sentence"], count)
        return F.struct(m["p"].alias("p"), begin.alias("begin"))

    def bounded(w):
        last = F.least(w["begin"] + WINDOW, F.size(w["p"]["tokens"])) - 1
        return let(
            F.struct(w["p"].alias("p"), w["begin"].alias("begin"), last.alias("last")),
            lambda b: F.struct(
                *[b[name].alias(name) for name in ("p", "begin", "last")],
                _runs(b["p"]["hits"], b["begin"], b["last"]).alias("runs"),
            ),
        )

    def assembled(w):
        tokens, gaps, begin, last, runs = w["p"]["tokens"], w["p"]["gaps"], w["begin"], w["last"], w["runs"]

        def piece(i):
            return F.concat(
                F.when((i == begin) & (begin > 0), F.lit(CUT)).otherwise(F.get(gaps, i)),
                F.when(F.array_contains(runs["start"], i), F.lit(OPEN)).otherwise(F.lit("")),
                F.get(tokens, i),
                F.when(F.array_contains(runs["end"], i), F.lit(CLOSE)).otherwise(F.lit("")),
            )

        shown = F.array_join(F.transform(F.sequence(begin, last), piece), "")
        rest = F.when(last >= F.size(tokens) - 1, F.get(gaps, last + 1)).otherwise(F.lit(CUT))
        return F.concat(shown, rest)

    def chosen(p):
        made = let(let(let(measured(p), placed), bounded), assembled)
        return F.when(F.size(p["tokens"]) > 0, made).otherwise(F.element_at(p["gaps"], 1))

    return F.when(text.isNotNull(), let(parts, chosen))
