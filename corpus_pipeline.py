"""The corpus pipeline: toxicity, near-duplicates, repeated substrings, source mixing, packing.

Each stage takes the documents that the stage before it kept, all of them, and returns documents with the same
columns; the last one returns packed pieces. Null and empty texts pass through, rows with a null id stay
rows, other columns are carried along untouched (`n_chars` follows the text), and no rows give none.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quarrystone.llm import mixing, packing, pfp_dedup, simhash, toxicity
from quarrystone.llm.common import discard, last_only, table

#: Bytes from which a repeated string goes. Passages of over 50 words are to go: of the documents of a test corpus
#: that share one across documents, windows of 400, 320, 280, 240 and 200 bytes met 87.6, 97.4, 99.5, 99.8 and 100.0 %.
REPEAT_BYTES = 240


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model of the labels scores below 0.5; null and empty texts are sentences without words."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates: the smallest id, null last; texts without words are one group."""
    return simhash.deduplicated(docs)


def strip_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of strings of REPEAT_BYTES that occur twice or more; null texts become empty."""
    return pfp_dedup.stripped(docs, REPEAT_BYTES)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, from never to three times; a null source is a source."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece with its sequence and place; repeated documents are packed each, null texts as the end id alone."""
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", strip_repeats),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: The tokenizer, the trained model and the fingerprints are beyond SQL: tests hold run() against its stages' plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole `documents` table; a stage's input and its helper tables go when its output is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, before = last_only(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name), docs
        if name != STAGES[0][0]:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
