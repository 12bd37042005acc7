"""One query for each operator of this subpackage, over its whole table, and its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import (ann, byte_bpe, conversation_repair, hamming, jaccard_join, licenses, packing, period_runs, secret_scan,
               source_mixing, token_counts, toxicity, url_filter)
from .common import table

# The filter entries (verdict, host, path).
URL_RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
]


def _tokenizers():
    import public_tokenizers
    return public_tokenizers


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"), licenses.known_licenses(spark))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), str(_tokenizers().path("piece_bpe_32k.model")))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_digests(table(spark, sf_dir, "documents"))


def op4_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming.hamming_topk(hamming.sign_codes(table(spark, sf_dir, "embeddings")))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tokenizers()
    return byte_bpe.byte_bpe_frame(table(spark, sf_dir, "documents"), str(t.path("byte_bpe_50k.tiktoken")), t.PATTERN)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_inner_product_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.inner_product_topk(table(spark, sf_dir, "embeddings"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_tokens(table(spark, sf_dir, "documents"), str(_tokenizers().path("piece_bpe_32k.model")))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), shingle=3, num=9, den=10)


def op11_period_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return period_runs.run_digests(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.damage_and_repair(table(spark, sf_dir, "conversations"))


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.mix_sources(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_license_scan, op2_token_counts, op3_secret_scan, op4_hamming_topk, op5_byte_bpe, op6_toxicity,
    op7_inner_product_topk, op8_url_filter, op9_best_fit_packing, op10_jaccard_join,
    op11_period_runs, op12_conversation_repair, op13_source_mixing)}

SQL = {
    "op1_license_scan": licenses.oracle(),
    "op3_secret_scan": secret_scan.oracle(),
    "op4_hamming_topk": hamming.oracle(),
    "op8_url_filter": url_filter.oracle(URL_RULES),
}
