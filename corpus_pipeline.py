"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and gives back a table; all but the last give the columns of
documents. `run` writes each stage's rows as Parquet in the shared folder and reads them as the next
one's documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from townbill.llm import common, jaccard_join, language_id, mixing, packing, suffix_dedup
from townbill.session import delete, pin_session

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOKENIZER = "word_bpe_49k.json"
WEIGHTS = [5, 2, 1]
#: a passage of more than 50 words of three letters on average, and a space each, has over 200 bytes
REPEAT_BYTES = 200
#: shorter strings need more samples, so a task takes smaller blocks of texts
BLOCK_BYTES = 2 << 20
ORACLE_SQL = None  # language vectors, components and packing have no SQL; tests/llm hold brute-force versions


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised, with that language; the labelled ones teach it."""
    common.ship(spark)
    told = language_id.identify(docs, language_id.fit(docs), keep=("text", "source", "n_chars"))
    return told.where(~F.col("rejected")).select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by word 5-gram sets with a Jaccard similarity of 0.8 or more."""
    common.ship(spark)
    return jaccard_join.keep_one(docs, n=5, percent=80).select(COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes covered by a string of REPEAT_BYTES that also starts elsewhere; documents stay."""
    common.ship(spark)
    left = suffix_dedup.suffix_dedup(docs, length=REPEAT_BYTES, block_bytes=BLOCK_BYTES, carry=("lang", "source"), as_text=True)
    return left.select("doc_id", F.col("kept").alias("text"), "row.lang", "row.source", F.length("kept").cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    common.ship(spark)
    with common.scratch(spark):
        plan = common.stored(mixing.plan(mixing.sizes_of(docs), WEIGHTS), "plan", leaves=True)
    return mixing.take(docs.select(COLUMNS), plan)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of the documents' pieces in sequences of 2048 tokens."""
    common.ship(spark)
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; a stage's table goes once the next one's is written, the one before the last stays."""
    docs, read = pin_session(spark).read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        rows = stage(spark, docs, sf_dir)
        path = common.new_path(spark, name)
        rows.write.parquet(path)
        docs = spark.read.schema(rows.schema).parquet(path)
        if read:
            delete(spark, read)
        read = path
    return STAGES[-1][1](spark, docs, sf_dir)
