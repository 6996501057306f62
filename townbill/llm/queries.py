"""The registered queries of this subpackage, over whole tables and whole texts."""

from __future__ import annotations

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from townbill.llm import common, decontaminate, jaccard_join, language_id, mixing, packing, quality_rules, spelling, substring_dedup, suffix_dedup, token_counts, token_files, vector_dedup, whitening
from townbill.session import pin_session

TOKENIZER = "word_bpe_49k.json"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    common.ship(spark)
    return pin_session(spark).read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


@query()
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out())
    model = language_id.fit(docs.where(~F.col("held_out")))
    return language_id.identify(docs, model, keep=("held_out",))


@query()
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    trusted = labels.where((F.col("quality") == 1) & (F.col("toxic") == 0))
    return quality_rules.judge(docs, quality_rules.weights(docs, trusted))


@query()
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


@query()
def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.new_path(spark, "token-files")
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path(TOKENIZER))
    rows = token_files.read_tokens(spark, path)
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query()
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = mixing.sizes_of(table(spark, sf_dir, "documents"))
    rows = mixing.mix(sizes, mixing.plan(sizes, [5, 2, 1]))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


@query()
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query()
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), F.size("spans").alias("n_spans"))


@query()
def op3_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.vector_dedup(table(spark, sf_dir, "embeddings"))


@query()
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


WORDS_11 = """regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""
CONTAMINATION = f"""
WITH docs AS (SELECT doc_id, coalesce({WORDS_11}, []) AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item_id, w, least(10, len(w)) AS k
          FROM (SELECT item_id, coalesce({WORDS_11}, []) AS w FROM benchmark) WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, k, array_to_string(w[j : j + k - 1], ' ') AS words
            FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS j FROM items)),
places AS (SELECT doc_id, k, j, array_to_string(w[j : j + k - 1], ' ') AS words
           FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS j FROM docs, (SELECT DISTINCT k FROM windows))),
hits AS (SELECT doc_id, item_id, p.k, j FROM places p JOIN windows i ON p.k = i.k AND p.words = i.words),
covered AS (SELECT doc_id, count(DISTINCT place) AS n_hit
            FROM (SELECT doc_id, unnest(range(j, j + k)) AS place FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
          FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs d LEFT JOIN covered c ON d.doc_id = c.doc_id LEFT JOIN named n ON d.doc_id = n.doc_id
"""


@query(CONTAMINATION)
def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    n_items = F.size("items").cast("long")
    return rows.select("row.doc_id", "n_words", n_hit.alias("n_hit"), n_items.alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


@query()
def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model = whitening.whiten(table(spark, sf_dir, "embeddings"))
    each = rows.select("row.vec_id", "n", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    share = F.element_at(F.lit(np.array(model.explained or [0.0])), F.col("at") + 1)
    return each.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", "whitened", share.alias("explained"), F.lit(model.identity_error).alias("identity_error"))


@query()
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spelling.runs(table(spark, sf_dir, "documents"))
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run"))
    words = found.select("run", F.crc32(name.cast("binary")).alias("h"))
    dropped = spelling.without(F.col("run"), F.pmod(F.col("h"), F.length("run")).cast("int"))
    return spelling.variants(words.select(F.when(F.col("h") % 31 == 0, dropped).otherwise(F.col("run")).alias("word")))


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
