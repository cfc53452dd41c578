"""One query per operator, over whole tables and with production parameters."""

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from docloom.llm import (
    align, bpe, chat, decontaminate, filter_audit, fingerprint, main_text, ngram_join, quality,
    repeats, secret_scan, sharding, url_filter,
)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_chat_formatting(spark, folder):
    return chat.repair(_table(spark, folder, "conversations"))


def op2_quality_classifier(spark, folder):
    docs = _table(spark, folder, "documents")
    model = quality.train(docs, _table(spark, folder, "labels"))
    return model.score(docs.select("doc_id", "lang", "text")).drop("text")


def op3_html_extraction(spark, folder):
    return main_text.extract(_table(spark, folder, "pages"))


def op4_byte_bpe(spark, folder):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.round_trip(_table(spark, folder, "documents"), path, public_tokenizers.PATTERN)


def op5_benchmark_decontamination(spark, folder):
    docs = _table(spark, folder, "documents")
    return decontaminate.find_leaks(docs, _table(spark, folder, "benchmark"))


def op6_document_fingerprints(spark, folder):
    return fingerprint.edit_probe(_table(spark, folder, "documents"))


def op7_ngram_jaccard_join(spark, folder):
    return ngram_join.jaccard_components(_table(spark, folder, "documents"))


def op8_sharding(spark, folder):
    return sharding.shard_documents(_table(spark, folder, "documents"))


def op9_url_filters(spark, folder):
    pages = _table(spark, folder, "pages")
    return url_filter.judge(pages, url_filter.train(url_filter.rule_labels(pages)))


def op10_secret_scans(spark, folder):
    docs = _table(spark, folder, "documents")
    return secret_scan.find_secrets(docs, secret_scan.train(docs))


def op11_suffix_array_dedup(spark, folder):
    return repeats.removal_digest(repeats.remove_repeats(_table(spark, folder, "documents")))


def op12_cross_tokenizer_alignment(spark, folder):
    paths = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return align.alignment_audit(_table(spark, folder, "documents"), *paths)


def op13_filter_audit(spark, folder):
    docs = _table(spark, folder, "documents")
    return filter_audit.audit(docs, _table(spark, folder, "labels"))


def pipeline(spark, folder):
    return corpus_pipeline.run(spark, folder)


QUERIES = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_html_extraction": op3_html_extraction,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_document_fingerprints": op6_document_fingerprints,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_sharding": op8_sharding,
    "op9_url_filters": op9_url_filters,
    "op10_secret_scans": op10_secret_scans,
    "op11_suffix_array_dedup": op11_suffix_array_dedup,
    "op12_cross_tokenizer_alignment": op12_cross_tokenizer_alignment,
    "op13_filter_audit": op13_filter_audit,
    "pipeline": pipeline,
}
