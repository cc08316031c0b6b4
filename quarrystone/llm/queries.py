"""The queries of this subpackage: each applies one operator to its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import block_dedup, boosted_trees, co_bucket, mixing, packing, periodic_runs, pfp_dedup, quality, simhash, token_files, topk, toxicity, url_filter
from .common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op4_pfp_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfp_dedup.marked(table(spark, sf_dir, "documents"))


def op5_line_labelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), every=20)


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("repeats")


def op10_block_anchor_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_dedup.marked(table(spark, sf_dir, "documents"))


def op11_boosted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boosted_trees.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_co_bucketed_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = co_bucket.bucket(F.col("sale_id"))
    sales = co_bucket.Side("sales", table(spark, sf_dir, "sales"), F.when(own % 4 == 1, own - 1).otherwise(own))
    item = F.crc32(F.col("item_id").cast("string").cast("binary")) % co_bucket.BUCKETS
    lines = co_bucket.Side("sale_lines", table(spark, sf_dir, "sale_lines"), F.coalesce(item, F.lit(0)))
    return co_bucket.co_bucket(sales, lines, "sale_id")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(periodic_runs.detect(table(spark, sf_dir, "documents"), periodic_runs.planted_period))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_url_filter": op2_url_filter,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_pfp_substring_dedup": op4_pfp_substring_dedup,
    "op5_line_labelling": op5_line_labelling,
    "op6_token_files": op6_token_files,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_exact_top_k": op8_exact_top_k,
    "op9_source_mixing": op9_source_mixing,
    "op10_block_anchor_dedup": op10_block_anchor_dedup,
    "op11_boosted_trees": op11_boosted_trees,
    "op12_co_bucketed_pair": op12_co_bucketed_pair,
    "op13_periodic_runs": op13_periodic_runs,
}
