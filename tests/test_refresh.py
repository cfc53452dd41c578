from pyspark.sql import functions as F

from docloom.operators.index import read_index
from docloom.operators.search import search
from docloom.plans.refresh import rebuild_index, refresh
from docloom.plans.local import local_table
from docloom.schemas import PAGES, SEEDS, SOURCES
from docloom.sources.rules import seed_rules
from docloom.sources.tables import read_corpus, write_results
from docloom.streaming.refresh import page_stream, stream_refresh


def sources(spark):
    rows = [
        ("all", ["http://h.org/1"], ["h.org"], [], [], None, 0),
        ("part", ["http://h.org/p/2"], ["h.org"], ["/p/"], [], None, 1),
    ]
    return local_table(spark, [dict(zip(SOURCES.names, r)) for r in rows], SOURCES).fillna(50, ["max_pages"])


def pages(spark, text="old"):
    def page(body):
        return f"<title>t</title><main><p>{body}</p><a href='/p/2'>n</a><a href='/p/3'>m</a></main>"

    rows = [(1, "http://h.org/1", page("one")), (2, "http://h.org/p/2", page(f"two {text}"))]
    rows += [(3, "http://h.org/p/3#x", page("three")), (4, "http://z.org/", page("four"))]
    return spark.createDataFrame(rows, PAGES)


def state(spark, path):
    columns = ("doc_id", "url", "source", "title", "content", "content_hash")
    return {tuple(r) for r in read_corpus(spark, path).select(*columns).collect()}


def test_refresh_is_incremental_and_searchable(spark, folder):
    paths = folder + "/corpus", folder + "/index"
    counts = {r.source: tuple(r)[1:] for r in refresh(pages(spark), sources(spark), *paths).collect()}
    assert counts == {"all": (3, 3, 0), "part": (2, 0, 2)}
    again = {r.source: tuple(r)[1:] for r in refresh(pages(spark), sources(spark), *paths).collect()}
    assert again == {"all": (3, 0, 3), "part": (2, 0, 2)}
    assert read_index(spark, paths[1]).segment == 0
    before = state(spark, paths[0])
    changed = {r.source: tuple(r)[1:] for r in refresh(pages(spark, "new"), sources(spark), *paths).collect()}
    assert changed == {"all": (3, 1, 2), "part": (2, 0, 2)}
    index, corpus = read_index(spark, paths[1]), read_corpus(spark, paths[0])
    assert search("two old", index, corpus).count() == 0
    hit = search("two new", index, corpus).first()
    assert hit.id in {r[0] for r in before if "two" in r[4]} and "[two] [new]" in hit.snippet
    fresh = rebuild_index(corpus, folder + "/rebuilt")
    columns = ["term", "doc_id", "col", "positions", "n_tokens"]
    assert fresh.postings.select(columns).exceptAll(index.postings.select(columns)).count() == 0


def test_crawl_refresh_takes_reachable_pages_in_order(spark, folder):
    summary = refresh(pages(spark), sources(spark), folder + "/c", folder + "/i", crawl=True, max_pages=2)
    assert {r.source: r.processed for r in summary.collect()} == {"all": 2, "part": 2}
    rows = {r.url: (r.doc_id, r.source) for r in read_corpus(spark, folder + "/c").collect()}
    assert rows == {
        "http://h.org/1": (1, "all"),
        "http://h.org/p/2": (2, "all"),
        "http://h.org/p/3": (3, "part"),
    }


def test_stream_equals_batch_and_replay_changes_nothing(spark, folder):
    for i, text in enumerate(("old", "new")):
        pages(spark, text).coalesce(1).write.parquet(f"{folder}/in/{i}")
    stream = page_stream(spark, f"{folder}/in/*", files=1)
    paths = folder + "/corpus", folder + "/index"
    stream_refresh(stream, sources(spark), *paths, folder + "/ckpt").awaitTermination()
    batch = folder + "/corpus2", folder + "/index2"
    for text in ("old", "new"):
        refresh(pages(spark, text), sources(spark), *batch)
    assert state(spark, paths[0]) == state(spark, batch[0])
    stream_refresh(stream, sources(spark), *paths, folder + "/ckpt2").awaitTermination()
    urls = {r[1] for r in state(spark, paths[0])}
    assert urls == {r[1] for r in state(spark, batch[0])}


def test_late_captures_do_not_replace_newer_ones(spark, folder):
    from docloom.plans.refresh import apply_batch, drop_stale, extract_batch

    paths = folder + "/corpus", folder + "/index"
    for text, day in (("new", "2024-02-02"), ("old", "2024-01-01")):
        captured = pages(spark, text).withColumn("fetched_at", F.lit(day).cast("timestamp"))
        batch = extract_batch(captured, sources(spark))
        apply_batch(spark, drop_stale(batch, read_corpus(spark, paths[0])), sources(spark), *paths)
    contents = [r[4] for r in state(spark, paths[0])]
    assert any("two new" in c for c in contents) and not any("two old" in c for c in contents)


def test_captures_with_equal_or_no_time_keep_one_row_per_url(spark, folder):
    same = pages(spark).unionByName(
        pages(spark, "again").withColumn("url", F.concat("url", F.lit("#top"))).withColumn(
            "page_id", F.col("page_id") + 10
        )
    )
    for k, day in enumerate(("2024-01-01", None)):
        captured = same.withColumn("fetched_at", F.lit(day).cast("timestamp"))
        # Rules without an order are as good as others.
        rules = sources(spark).drop("source_ord") if k else sources(spark)
        counts = refresh(captured, rules, f"{folder}/c{k}", f"{folder}/i{k}").collect()
        assert sum(r.processed for r in counts) == 10
        stored = read_corpus(spark, f"{folder}/c{k}").collect()
        assert sorted(r.url for r in stored) == [f"http://h.org/{p}" for p in ("1", "p/2", "p/3")]
        assert len({r.doc_id for r in stored}) == 3
        assert any("two again" in r.content for r in stored)


def test_seeds_feed_a_refresh(spark, folder):
    seeds = spark.createDataFrame([("s", "https://h.org/", None, None)], SEEDS)
    secure = pages(spark).withColumn("url", F.replace("url", F.lit("http:"), F.lit("https:")))
    refresh(secure, seed_rules(seeds), folder + "/c", folder + "/i")
    assert read_corpus(spark, folder + "/c").count() == 3


def test_new_ids_pass_those_of_an_index_whose_corpus_write_was_lost(spark, folder):
    refresh(pages(spark), sources(spark), folder + "/lost", folder + "/index")
    refresh(pages(spark), sources(spark), folder + "/corpus", folder + "/index")
    assert read_corpus(spark, folder + "/corpus").agg(F.min("doc_id")).first()[0] == 4


def test_results_sink(spark, folder):
    write_results(spark.range(3).withColumn("x", F.lit("é")), folder + "/out")
    assert spark.read.text(folder + "/out").count() == 3
