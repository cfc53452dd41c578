"""Ranks of many, few and tied scores against plain sorting."""

import random

import pytest

from docloom.operators.rank import TIE_DIGITS, top_k


@pytest.fixture(scope="module")
def scores():
    rng = random.Random(5)
    rows = [("many", i, -rng.random() ** 8 * 40) for i in range(3000)]
    rows += [("ties", i, -float(i % 3)) for i in range(900)]
    rows += [("same", i, -1e-6 * (1 + i % 2 * 1e-9)) for i in range(50)]
    return rows + [("one", 7, -2.5)]


@pytest.mark.parametrize("k", [0, 1, 10, 2000, -1])
def test_ranks_equal_those_of_a_sort(spark, scores, k):
    table = spark.createDataFrame(scores, "query_id string, doc_id long, score double").repartition(5)
    got = {}
    for row in top_k(table, k).collect():
        got.setdefault(row.query_id, {})[row["rank"]] = row.doc_id
    for name in ("many", "ties", "same", "one"):
        own = sorted((round(s, TIE_DIGITS), doc) for query, doc, s in scores if query == name)
        want = dict(enumerate((doc for _, doc in (own if k < 0 else own[:k])), 1))
        assert got.get(name, {}) == want, (name, k)
