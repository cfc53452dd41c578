import hashlib
import re
import sqlite3

from pyspark.sql import functions as F

from docloom.functions import text as X

WORDS = [
    "Straße ÉTÉ ñandú Ệ İstanbul",
    "x_y don't 3.14 日本語 ªº² Σας ΣΑΣ",
    "a\u0301b e\u0332f zero\u200djoin Ünïcödé ǅ ẛ µ ſ й Ё ά",
    "",
    "... -- +",
    "C++ asyncio.run foo-bar\nnew\tline",
    "Ⅷ ½ कित กัข 𝔘𝔫 😀ok",
]


def test_tokens_equal_fts5(spark):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(x)")
    db.execute("CREATE VIRTUAL TABLE v USING fts5vocab('t', 'instance')")
    want = {}
    for text in WORDS:
        db.execute("DELETE FROM t")
        db.execute("INSERT INTO t VALUES (?)", (text,))
        want[text] = [r[0] for r in db.execute("SELECT term FROM v ORDER BY offset")]
    rows = spark.createDataFrame([(w,) for w in WORDS], "text string")
    got = {r.text: r.ts for r in rows.select("text", X.tokenize(F.col("text")).alias("ts")).collect()}
    assert got == want


def test_normalize_text_and_hash(spark):
    want = {
        "a\r\nb\rc": "a\nb\nc",
        "a\n\n\n\nb": "a\n\nb",
        "  a \t b  ": "a b",
        "\n a\n \n \nb\xa0": "a\n \n \nb",
        "": "",
        "a  \n   b": "a \n b",
    }
    rows = spark.createDataFrame([(t,) for t in want], "t string").select(
        "t",
        X.normalize_text(F.col("t")).alias("n"),
        X.content_hash(F.col("t")).alias("h"),
        X.title_or_url(F.col("t"), F.lit("u")).alias("title"),
    )
    for row in rows.collect():
        assert row.n == want[row.t]
        assert row.h == hashlib.sha256(row.t.encode()).hexdigest()
        assert row.title == (row.t or "u")
