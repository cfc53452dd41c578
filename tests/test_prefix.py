"""Prefixes looked up in the sorted vocabulary, against a plain scan of the terms."""

import random

from docloom.operators import index as I

COLUMNS = "doc_id long, title string, content string, source string, url string"


def _corpus(spark, first, words):
    return spark.createDataFrame([(first, "", " ".join(words), "", "")], COLUMNS)


def test_prefix_words_equal_a_scan(spark, folder, monkeypatch):
    """Blocks of three terms, several segments, prefixes longer than a head, without a match, beyond
    the basic plane and shared by all terms."""
    monkeypatch.setattr(I, "BLOCK", 3)
    rng = random.Random(5)
    letters = "abñ\U00010400"
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 12))) for _ in range(300)]
    made += ["a" * n for n in range(1, 20)] + ["a" * 9 + x for x in "bñ"]
    path = folder + "/index"
    I.write_index(_corpus(spark, 1, made), path, buckets=4)
    index = I.merge_index(spark, path, _corpus(spark, 2, [*made[:40], "zeta", "zebra"]))
    terms = {r.term for r in index.vocabulary.collect()}
    prefixes = ["a", "ab", "ñ", "z", "ze", "zeb", "zz", "a" * 8, "a" * 10, "a" * 19, "a" * 20, "b\U00010428"]
    rows = spark.createDataFrame([(p,) for p in prefixes], "prefix string")
    got = {tuple(r) for r in I.prefix_words(rows, index).select("prefix", "word").collect()}
    assert got == {(p, t) for p in prefixes for t in terms if t.startswith(p)}
    assert len(got) > 100


def test_blocks_follow_the_matches(spark, folder):
    """A prefix meets the blocks of its interval, not the vocabulary."""
    words = [f"w{n:05d}" for n in range(20000)]
    index = I.write_index(_corpus(spark, 1, words), folder + "/index", buckets=4)
    spans = index.heads.filter("head = 'w0012'").selectExpr("sum(high - low + 1) AS n").first()
    assert spans.n <= 4
    every = index.heads.filter("head = 'w'").selectExpr("sum(high - low + 1) AS n").first()
    assert every.n >= 20000 // I.BLOCK


def test_empty_index(spark, folder):
    index = I.write_index(_corpus(spark, 1, []).limit(0), folder + "/index", buckets=4)
    rows = spark.createDataFrame([("a",)], "prefix string")
    assert I.prefix_words(rows, index).count() == 0
