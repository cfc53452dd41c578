"""Nested boolean queries.

An expression is built from words with ``&`` (and), ``|`` (or) and ``-`` (but not); ``-`` binds
tightest, then ``&``, then ``|``. It is stored as the query's clauses and a *program* in postfix
order: a number from 0 on puts that clause on a stack, the others combine the two on top. All
evaluation is a fold of the program with such a stack, inside one row.

A clause adds to a score only where every part of the expression that holds it is met, so in
``(a & b) | c`` a document with a and c, but without b, is scored by c alone. An operand without any
token is left out, as if it had not been written; what is taken from it goes with it.
"""

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.operators.match import clause, near
from docloom.plans.local import local_table
from docloom.schemas import PROGRAM, QUERIES

AND, OR, NOT = -1, -2, -3


@dataclass(frozen=True)
class Expression:
    """Clauses and the program that combines them."""

    clauses: tuple
    program: tuple[int, ...]

    def __and__(self, other: "Expression") -> "Expression":
        return self._joined(other, AND)

    def __or__(self, other: "Expression") -> "Expression":
        return self._joined(other, OR)

    def __sub__(self, other: "Expression") -> "Expression":
        return self._joined(other, NOT)

    def _joined(self, other: "Expression", step: int) -> "Expression":
        groups = [c["near_group"] for c in self.clauses if c["near_group"] is not None]
        first = max(groups, default=-1) + 1
        moved = tuple(
            c if c["near_group"] is None else c | {"near_group": c["near_group"] + first}
            for c in other.clauses
        )
        shifted = (at + len(self.clauses) if at >= 0 else at for at in other.program)
        return Expression(self.clauses + moved, (*self.program, *shifted, step))


def word(phrase, **options) -> Expression:
    """One word or phrase; ``options`` are those of ``clause`` but for kind and slot."""
    return Expression((clause(phrase, **options).asDict(),), (0,))


def close(phrases, distance: int = 10, **options) -> Expression:
    """Phrases within ``distance`` tokens of each other."""
    members = near(phrases, distance, **options)
    return reduce(
        lambda left, right: Expression(left.clauses + right.clauses, (*left.program, len(left.clauses), AND)),
        (Expression((m.asDict(),), (0,)) for m in members),
    )


def expressions_frame(spark: SparkSession, queries: dict, source=None) -> DataFrame:
    """``QUERIES`` table with programs from ``{query_id: expression}`` given on the driver."""
    rows = [
        {"query_id": qid, "clauses": list(e.clauses), "source": source, "program": list(e.program)}
        for qid, e in queries.items()
    ]
    return local_table(spark, rows, T.StructType([*QUERIES.fields, PROGRAM]))


def well_formed(program: Column, n_clauses: Column) -> Column:
    """Whether a program uses known steps and clauses and leaves one value on the stack."""

    def step(state, at):
        known = (at < n_clauses) & ((at >= 0) | ((at >= NOT) & (state["depth"] >= 2)))
        depth = F.when(at >= 0, state["depth"] + 1).otherwise(state["depth"] - 1)
        return F.struct(depth.alias("depth"), (state["good"] & known).alias("good"))

    start = F.struct(F.lit(0).alias("depth"), F.lit(True).alias("good"))
    checked = F.aggregate(program, start, step, lambda s: s["good"] & (s["depth"] == 1))
    return F.coalesce(checked, F.lit(False))


def fold(program: Column, kind: str, leaf: Callable, joined: Callable) -> Column:
    """The value of a program: ``leaf(clause)`` and ``joined(step, left, right)`` are of type ``kind``."""

    def step(stack, at):
        size = F.size(stack)
        left, right = F.get(stack, size - 2), F.get(stack, size - 1)
        below = F.slice(stack, 1, F.greatest(size - 2, F.lit(0)))
        value = F.when(at >= 0, leaf(at)).otherwise(joined(at, left, right))
        return F.concat(F.when(at >= 0, stack).otherwise(below), F.array(value.cast(kind)))

    empty = F.array().cast(f"array<{kind}>")
    return F.get(F.aggregate(program, empty, step), F.lit(0))


def without_empty(program: Column, known: Column) -> Column:
    """The program without the clauses that are not ``known``; empty if nothing is left."""

    def joined(step, left, right):
        both = F.concat(left, right, F.array(step))
        lone = F.when(step == NOT, left).otherwise(F.concat(left, right))
        return F.when((F.size(left) > 0) & (F.size(right) > 0), both).otherwise(lone)

    def leaf(at):
        return F.when(F.array_contains(known, at), F.array(at)).otherwise(F.array().cast("array<int>"))

    return fold(program, "array<int>", leaf, joined)


def leading_clauses(program: Column, costs: Column) -> Column:
    """Clauses of which every matching document holds one, with the least sum of ``costs``.

    Of an AND the cheaper side is enough, an OR needs both, and a NOT only what it takes from.
    """

    def joined(step, left, right):
        either = F.struct(
            (left["cost"] + right["cost"]).alias("cost"), F.concat(left["lead"], right["lead"]).alias("lead")
        )
        cheaper = F.when(left["cost"] <= right["cost"], left).otherwise(right)
        return F.when(step == AND, cheaper).when(step == OR, either).otherwise(left)

    def leaf(at):
        return F.struct(F.element_at(costs, at).alias("cost"), F.array(at).alias("lead"))

    return fold(program, "struct<cost:bigint,lead:array<int>>", leaf, joined)["lead"]


def verdict(program: Column, parts: Column) -> Column:
    """(met, score, used) of one document; ``parts`` maps the clauses it holds to what they add."""
    none = F.struct(
        F.lit(False).alias("met"), F.lit(0.0).alias("score"), F.array().cast("array<int>").alias("used")
    )

    def joined(step, left, right):
        both = F.struct(
            (left["met"] | right["met"]).alias("met"),
            (left["score"] + right["score"]).alias("score"),
            F.concat(left["used"], right["used"]).alias("used"),
        )
        return (
            F.when((step == AND) & left["met"] & right["met"], both)
            .when(step == OR, both)
            .when((step == NOT) & left["met"] & ~right["met"], left)
            .otherwise(none)
        )

    def leaf(at):
        held = F.struct(
            F.lit(True).alias("met"), F.element_at(parts, at).alias("score"), F.array(at).alias("used")
        )
        return F.when(F.map_contains_key(parts, at), held).otherwise(none)

    return fold(program, "struct<met:boolean,score:double,used:array<int>>", leaf, joined)
