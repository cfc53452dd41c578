"""Tokens against those of a text whose marks and accents go in two passes."""

from pyspark.sql import functions as F

from docloom.operators import index as I
from docloom.functions import text as X

TEXTS = ["Ünïcödé Straße éa ́ b́́c ́x xͅy", "the THE the", "", None, "日本 µm ſet Ǻ ẛ"]


def test_one_pass_gives_the_tokens_of_two(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    lowered = F.lower("text")
    folded = F.translate(F.regexp_replace(lowered, X.DROPPED_MARKS, ""), X._FROM, X._TO)
    first = F.array_remove(F.split(folded, X.TOKEN_BREAK), "")
    rows = df.select("text", X.tokenize(F.col("text")).alias("got"), first.alias("wanted")).collect()
    assert [r.got for r in rows] == [r.wanted for r in rows]
    assert "regexp_replace" not in str(X.fold(F.col("text")))


def test_more_rows_take_more_partitions(spark, monkeypatch):
    """What one task adds up for the dictionary does not grow with the postings."""
    rows = [(i, f"w{i % 7} x", f"a b c{i}", "s", "u") for i in range(30)]
    corpus = spark.createDataFrame(rows, "doc_id long, title string, content string, source string, url string")
    postings = I.build_postings(corpus)
    assert I.dealt(postings).rdd.getNumPartitions() == postings.rdd.getNumPartitions()
    want = I.dictionary(postings).select("term", "df").collect()
    monkeypatch.setattr(I, "TASK_ROWS", 10)
    dealt = I.dealt(postings)
    assert dealt.rdd.getNumPartitions() == -(-postings.count() // 10) > 12
    assert sorted(I.dictionary(dealt).select("term", "df").collect()) == sorted(want)
