"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import datetime

import pytest

import corpus_pipeline
from docloom.llm.queries import QUERIES

PROSE = "the quick brown fox jumps over the lazy dog while seven wizards watch the boxing match"
KEY = 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'

DOCUMENTS = [
    (5, PROSE, "en", "src0", len(PROSE)),
    (5, PROSE, "en", "src0", len(PROSE)),
    (3, PROSE, "en", None, None),
    (4, None, None, None, None),
    (None, None, None, None, None),
    (None, PROSE, "en", "src1", 1),
    (6, "", "en", "src1", 0),
    (7, " \n\t ", "xx", "src1", 4),
    (8, "word " * 30_000, "en", "src2", 150_000),
    (9, "x" * 50_000, "en", "src2", 50_000),
    (10, f"some text here {KEY} and more words 1234567890123456 follow", "en", "src3", 70),
    (11, "Ünïcödé 日本語 🎉 text", None, "src3", 18),
]
CLASH = (
    "token vertex ids keep shard slot _nats perplexity host path text_crc32 n_shingles word _size "
    "component fingerprint part label features _keep TEXT_2 law rule"
).split()


def write(spark, folder, empty=False):
    extra = "".join(f", {c} string" for c in CLASH)
    day = datetime.date(2024, 1, 1)

    def save(name, rows, schema):
        rows = [] if empty else [r + ("x",) * len(CLASH) + (day,) for r in rows]
        df = spark.createDataFrame(rows, f"{schema}{extra}, day date")
        df.write.parquet(f"{folder}/{name}.parquet")

    save("documents", DOCUMENTS, "doc_id long, text string, lang string, source string, n_chars long")
    save("labels", [(5, 1, 0), (5, 1, 0), (3, 1, None), (9, 0, 0), (None, 1, 0), (8, None, None)],
         "doc_id long, quality int, toxic int")
    save("benchmark", [(1, PROSE), (1, PROSE), (2, None), (None, PROSE), (3, "")],
         "item_id long, text string")
    page = "<html><nav>menu</nav><article><h1>T</h1><p>One &amp; two</p></article>"
    save("pages", [(1, "https://A.example.net/en/x", page), (1, "https://A.example.net/en/x", page),
                   (2, None, None), (None, "no scheme", ""), (3, "http://b.org", "<p>" + "a " * 90_000)],
         "page_id long, url string, html string")
    save("conversations", [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, None, None, None),
                           (None, 1, "SYSTEM", ""), (None, None, "assistant", "a"), (2, 1, "assistant", "b")],
         "conv_id long, turn long, role string, text string")


SIZES = {
    "op1_chat_formatting": 6,
    "op2_quality_classifier": len(DOCUMENTS),
    "op3_html_extraction": 5,
    "op4_byte_bpe": len(DOCUMENTS),
    "op6_document_fingerprints": len(DOCUMENTS),
    "op7_ngram_jaccard_join": len(DOCUMENTS),
    "op8_sharding": len(DOCUMENTS),
    "op9_url_filters": 5,
    "op11_suffix_array_dedup": len(DOCUMENTS),
    "op12_cross_tokenizer_alignment": len(DOCUMENTS),
    "op13_filter_audit": 3 * 600,
}


@pytest.fixture(scope="module")
def edge_tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("edges"))
    write(spark, folder)
    return folder


@pytest.fixture(scope="module")
def empty_tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    write(spark, folder, empty=True)
    return folder


@pytest.mark.parametrize("name", [n for n in QUERIES if n != "pipeline"])
def test_edge_rows_give_whole_results(spark, edge_tables, name):
    rows = QUERIES[name](spark, edge_tables).collect()
    if name in SIZES:
        assert len(rows) == SIZES[name]
    if name == "op7_ngram_jaccard_join":
        found = {(r.doc_id, r.n_shingles, r.component_id) for r in rows}
        n = len(PROSE.split()) - 4
        assert {(5, n, 3), (3, n, 3), (None, n, 3), (4, 0, 4), (None, 0, None), (6, 0, 6),
                (7, 0, 7), (8, 1, 8), (9, 1, 9)} <= found
    if name == "op5_benchmark_decontamination":
        assert {(r.doc_id, r.item_id) for r in rows} == {(5, 1), (3, 1), (None, 1)}
    if name == "op3_html_extraction":
        assert {(r.page_id, r.text) for r in rows if r.page_id != 3} == {
            (1, "T\n\nOne & two"), (2, ""), (None, "")
        }
    if name == "op11_suffix_array_dedup":
        gone = {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in rows}
        assert {(4, 0, 0, 0), (6, 0, 0, 0), (8, 150_000, 150_000, 1), (9, 50_000, 50_000, 1)} <= gone
    if name == "op12_cross_tokenizer_alignment":
        bare = [r for r in rows if r.doc_id in (4, 6)]
        assert [tuple(r)[1:] for r in bare] == [(0, 0, 0, 0, 0, 0, "")] * 2
    if name == "op9_url_filters":
        assert {(r.page_id, r.host, r.path, r.rule) for r in rows} == {
            (1, "a.example.net", "/en/x", "example.net/en/"), (2, "", "", None),
            (None, "", "", None), (3, "b.org", "", None),
        }


@pytest.mark.parametrize("name", list(QUERIES))
def test_empty_tables_give_empty_results(spark, empty_tables, name):
    assert QUERIES[name](spark, empty_tables).collect() == []


def test_stages_keep_the_columns_and_the_rows_that_stay(spark, edge_tables):
    docs = spark.read.parquet(f"{edge_tables}/documents.parquet")
    columns = docs.dtypes
    counts = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, edge_tables)
        assert out.dtypes == columns
        counts.append(out.count())
    kept = corpus_pipeline.STAGES[1][1](spark, docs, edge_tables).collect()
    # Of ids 3 and 5 with one text 3 stays; rows without an id or without words stay.
    assert sorted(str(r.doc_id) for r in kept) == sorted(
        str(x) for x in [3, 4, None, None, 6, 7, 8, 9, 10, 11]
    )
    assert counts[3] == len(DOCUMENTS)
