import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    ]
)


@pytest.fixture
def make(spark):
    """Documents from (doc_id, text, ...) with columns of clashing names beside them."""
    from townbill.llm import common

    common.ship(spark)

    def build(rows, lang="en", source="s"):
        full = [(d, t, *(rest or [lang, source]), len(t) if t is not None else None) for d, t, *rest in rows]
        df = spark.createDataFrame(full, SCHEMA)
        for name in ("block", "row", "size", "key", "hash", "cls", "gram", "n", "words", "kept", "score", "piece", "bucket", "shard", "ids"):
            df = df.withColumn(name, df["doc_id"].cast("string"))
        return df

    return build


@pytest.fixture(scope="session")
def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
