import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from docloom.functions.window import HITS, extract
from docloom.operators import index as I
from docloom.operators import rank
from docloom.operators import search as S
from docloom.operators import snippet as N
from docloom.operators.match import clause, near, queries_frame
from docloom.operators.rank import bm25
from docloom.operators.search import rank_batch, search, search_batch

WORDS = "alpha beta gamma delta men menu mente the of and 3.14 don't ñandú Straße x_y".split()


def _rows():
    rng = random.Random(7)
    rows = []
    for i in range(1, 61):
        words = [rng.choice(WORDS) for _ in range(rng.randint(0, 60))]
        text = ""
        for word in words:
            text += word + rng.choice([" ", " ", " ", ". ", ": ", ".\n", ", "])
        title = " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 4)))
        rows.append((i, title, text, f"src{i % 3}", f"https://h.org/{rng.choice(WORDS)}/{i}"))
    return rows


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    columns = "doc_id long, title string, content string, source string, url string"
    corpus = spark.createDataFrame(_rows(), columns)
    path = str(tmp_path_factory.mktemp("index"))
    return corpus, I.write_index(corpus, path, buckets=4)


@pytest.fixture(scope="module")
def fts():
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(title, content, source, url)")
    db.executemany("INSERT INTO t(rowid, title, content, source, url) VALUES (?,?,?,?,?)", _rows())
    return db


CASES = {
    "alpha": [clause("alpha")],
    "the of": [clause("the"), clause("of")],
    "the the": [clause("the"), clause("the")],
    "alpha OR delta": [clause("alpha", "any"), clause("delta", "any")],
    "the NOT gamma": [clause("the"), clause("gamma", "not")],
    '"of the"': [clause("of the")],
    '"the the"': [clause("the the")],
    "men*": [clause("men", prefix=True)],
    '"the m"*': [clause("the m", prefix=True)],
    "title: alpha": [clause("alpha", cols=["title"])],
    "- title : beta": [clause("beta", cols=["-title"])],
    "{title url} : gamma": [clause("gamma", cols=["title", "url"])],
    "^the": [clause("the", initial=True)],
    "src1": [clause("src1")],
    "NEAR(the of, 0)": near(["the", "of"], 0),
    "NEAR(the of, 3)": near(["the", "of"], 3),
    "NEAR(the of and, 5)": near(["the", "of", "and"], 5),
    'NEAR("of the" and alpha, 10)': near(["of the", "and", "alpha"]),
    '(alpha OR beta) AND (gamma OR "don t")': [
        clause("alpha", "any", slot=0),
        clause("beta", "any", slot=0),
        clause("gamma", "any", slot=1),
        clause("don't", "any", slot=1),
    ],
    '"Straße"': [clause("STRASSE", "any"), clause("straße", "any")],
}


def test_scores_and_snippets_equal_fts5(spark, built, fts):
    """All cases run as one batch, which also checks that queries do not disturb each other."""
    corpus, index = built
    queries = queries_frame(spark, {name: clauses for name, clauses in CASES.items()})
    got = {name: {} for name in CASES}
    for row in search_batch(queries, index, corpus, k=-1).collect():
        got[row.query_id][row.id] = (row.score, row.snippet)
    for name in CASES:
        want = fts.execute(
            "SELECT rowid, bm25(t), snippet(t, 1, '[', ']', '...', 12) FROM t WHERE t MATCH ?", (name,)
        ).fetchall()
        assert want, name
        assert set(got[name]) == {r[0] for r in want}, name
        for doc, score, snippet in want:
            assert got[name][doc][0] == pytest.approx(score, rel=1e-12), (name, doc)
            assert got[name][doc][1] == snippet, (name, doc)


def test_one_query_alone_gives_the_same(spark, built, fts):
    corpus, index = built
    for name in ("the of", "the NOT gamma"):
        rows = bm25(queries_frame(spark, {"q": CASES[name]}), index).collect()
        want = dict(fts.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", (name,)).fetchall())
        assert {r.doc_id: r.score for r in rows} == pytest.approx(want, rel=1e-12)


def test_search_limits_source_and_odd_text(spark, built, fts):
    corpus, index = built
    rows = search("the of", index, corpus, 3).collect()
    want = fts.execute("SELECT rowid FROM t WHERE t MATCH 'the of' ORDER BY bm25(t), rowid LIMIT 3")
    assert [r.id for r in rows] == [r[0] for r in want]
    assert [r["rank"] for r in rows] == [1, 2, 3]
    assert search("the", index, corpus, 0).count() == 0
    only = search("the of", index, corpus, -1, source="src2").collect()
    want = "SELECT rowid FROM t WHERE t MATCH 'the of' AND source = 'src2'"
    assert {r.id for r in only} == {r[0] for r in fts.execute(want)}
    everything = search("the of", index, corpus, -1, source="").count()
    assert everything == fts.execute("SELECT count(*) FROM t WHERE t MATCH 'the of'").fetchone()[0]
    for text in ("", "+", "."):
        assert search(text, index, corpus).count() == 0
    assert search("X_Y", index, corpus, -1).count() > 0


def test_only_negative_clauses_match_nothing(spark, built):
    corpus, index = built
    assert bm25(queries_frame(spark, {"q": [clause("the", "not")]}), index).count() == 0


def test_snippet_window_equals_fts5_on_random_texts(spark):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(x)")
    rng = random.Random(3)
    rows = []
    for _ in range(1500):
        words = [rng.choice("a b c d e f g h i j k l m".split()) for _ in range(rng.randint(1, 70))]
        text = rng.choice(["", " ", "- "]) + "".join(
            w + rng.choice([" ", " ", " ", ". ", ": ", "."]) for w in words
        )
        phrases = rng.choice([["a"], ["a", "b"], ["a b", "b"], ["a b c d", "c"], ["a", "b", "c"]])
        query = " OR ".join(f'"{p}"' for p in phrases)
        db.execute("DELETE FROM t")
        db.execute("INSERT INTO t VALUES (?)", (text,))
        row = db.execute("SELECT snippet(t,0,'[',']','...',12) FROM t WHERE t MATCH ?", (query,)).fetchone()
        if row is None:
            continue
        hits = sorted(
            (i, n, len(p.split()))
            for n, p in enumerate(phrases)
            for i in range(len(words))
            if words[i : i + len(p.split())] == p.split()
        )
        rows.append((text, hits, row[0]))
    made = spark.createDataFrame(rows, f"text string, hits {HITS}, want string")
    made = made.withColumn("got", extract(F.col("text"), F.col("hits")))
    assert len(rows) > 1000
    assert made.filter("NOT got <=> want").collect() == []


def test_snippet_of_odd_texts(spark):
    """No token, no hit, NULL, marks without a letter, and a hit that reaches past the window."""
    long = " ".join(f"w{i}" for i in range(20))
    rows = [
        (1, "", []),
        (2, " .. ", []),
        (3, None, []),
        (4, "(one) two.", []),
        (5, "\u0301 cafe\u0301 x", [(0, 0, 1)]),
        (6, long, [(0, 0, 15)]),
        (7, long, [(18, 0, 2)]),
    ]
    made = spark.createDataFrame(rows, f"id int, text string, hits {HITS}")
    got = made.select("id", extract(F.col("text"), F.col("hits"))).collect()
    assert dict(map(tuple, got)) == {
        1: "",
        2: " .. ",
        3: None,
        4: "(one) two.",
        5: "\u0301 [cafe\u0301] x",
        6: "..." + " ".join(f"w{i}" for i in range(1, 13)) + "...",
        7: "..." + " ".join(f"w{i}" for i in range(8, 18)) + " [w18 w19]",
    }


def test_merged_index_equals_rebuilt_index(spark, built, folder):
    corpus, _ = built
    path = folder + "/merged"
    I.write_index(corpus, path, buckets=4)
    changed = corpus.filter("doc_id in (1, 2, 3)").replace("src1", "srcx", "source")
    added = corpus.filter("doc_id = 4").selectExpr("doc_id + 100 as doc_id", "title", "content",
                                                   "source", "url")
    I.merge_index(spark, path, changed.unionByName(added))
    again = corpus.filter("doc_id = 2").replace("src2", "srcy", "source")
    merged = I.merge_index(spark, path, again)
    rows = corpus.filter("doc_id not in (1, 2, 3)").unionByName(added)
    rows = rows.unionByName(changed.filter("doc_id <> 2")).unionByName(again)
    fresh = I.write_index(rows, folder + "/fresh", buckets=4)
    assert (merged.n_docs, merged.n_tokens) == (fresh.n_docs, fresh.n_tokens)
    columns = ["term", "doc_id", "col", "tf", "positions", "n_tokens"]
    left, right = merged.postings.select(columns), fresh.postings.select(columns)
    assert left.exceptAll(right).count() == 0 and right.exceptAll(left).count() == 0
    queries = queries_frame(spark, {"q": [clause("src", prefix=True)]})
    both = [{r.doc_id: r.score for r in bm25(queries, i).collect()} for i in (merged, fresh)]
    assert both[0] == pytest.approx(both[1], rel=1e-12)


def test_a_document_meets_the_queries_of_its_own_source_only(spark, built, fts, monkeypatch):
    """Candidates are as many as documents, however many sources ask for the same words."""
    corpus, index = built
    made, write = {}, rank.materialize

    def recorded(df, name):
        made[name] = write(df, name)
        return made[name]

    monkeypatch.setattr(rank, "materialize", recorded)
    queries = queries_frame(spark, {"": CASES["the of"]})
    names = spark.range(40).select(F.concat(F.lit("src"), F.col("id")).alias("query_id"))
    queries = names.join(queries.drop("query_id")).withColumn("source", F.col("query_id"))
    free = queries_frame(spark, {"free": CASES["the of"]})
    rows = rank_batch(queries.unionByName(free.select(queries.columns)), index, corpus, -1).collect()
    want = {"free": {r[0] for r in fts.execute("SELECT rowid FROM t WHERE t MATCH 'the of'")}}
    for i in range(3):
        found = fts.execute(f"SELECT rowid FROM t WHERE t MATCH 'the of' AND source = 'src{i}'")
        want[f"src{i}"] = {r[0] for r in found}
    assert {q: {r.doc_id for r in rows if r.query_id == q} for q in want} == want
    assert {r.query_id for r in rows} == set(want)
    assert made["candidates"].count() <= 2 * len(_rows())


def test_snippets_of_all_matches_move_no_text_before_the_last_join(spark, built, monkeypatch):
    corpus, index = built
    queries = queries_frame(spark, {name: CASES[name] for name in ('"of the"', "NEAR(the of, 3)")})
    few = search_batch(queries, index, corpus, k=1000).collect()
    written = []
    for module in (S, N):
        def recorded(df, name, write=module.materialize):
            written.append(df.columns)
            return write(df, name)

        monkeypatch.setattr(module, "materialize", recorded)
    every = search_batch(queries, index, corpus, k=-1).collect()
    assert len(every) > 10 and sorted(every) == sorted(few)
    assert written and not [columns for columns in written if "content" in columns]
