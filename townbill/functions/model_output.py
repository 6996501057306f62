"""Checks on the text a classifier returns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from townbill import fixed
from townbill.functions.text import let, trim

FENCE = rf"(?s)```(?:json)?\s*(.*?)```"
BRACES = r"(?s)(\{.*\})"


def json_text(answer: Column) -> Column:
    """The JSON part of an answer: a fenced block, else the outermost braces."""
    return (
        F.when(answer.rlike(FENCE), trim(F.regexp_extract(answer, FENCE, 1)))
        .when(answer.rlike(BRACES), F.regexp_extract(answer, BRACES, 1))
        .otherwise(trim(answer))
    )


def _typed(doc: Column, key: str, kind: str, spark_type: str) -> Column:
    """A field of exactly the given JSON type; another type counts as missing."""
    field = F.try_variant_get(doc, f"$.{key}", "variant")
    return F.when(F.schema_of_variant(field) == kind, F.try_variant_get(doc, f"$.{key}", spark_type))


def parse_answer(answer: Column) -> Column:
    """Struct of checked fields, or null when relevance or confidence is missing or invalid."""

    def build(doc: Column) -> Column:
        relevant = _typed(doc, "kid_relevant", "BOOLEAN", "boolean")
        confidence = _typed(doc, "confidence", "STRING", "string")
        reasoning = F.coalesce(_typed(doc, "reasoning", "STRING", "string"), F.lit(""))
        items = F.coalesce(
            F.try_variant_get(doc, "$.age_buckets", "array<variant>"), F.array().cast("array<variant>")
        )
        words = F.transform(
            items, lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
        )
        buckets = F.filter(words, lambda b: F.coalesce(b.isin(*fixed.AGE_BUCKETS), F.lit(False)))
        stated = _typed(doc, "price", "STRING", "string")
        price = F.when(stated.isin(*fixed.PRICE_CLASSES), stated).otherwise("unknown")
        sure = _typed(doc, "price_confidence", "STRING", "string")
        price_confidence = (
            F.when(sure.isin(*fixed.PRICE_CONFIDENCES), sure).when(price == "free", "inferred").otherwise("confirmed")
        )
        return F.when(
            relevant.isNotNull() & confidence.isin(*fixed.AGE_CONFIDENCES),
            F.struct(
                relevant.alias("kid_relevant"),
                F.when(relevant, buckets).otherwise(F.array().cast("array<string>")).alias("age_buckets"),
                confidence.alias("age_confidence"),
                reasoning.alias("age_reasoning"),
                price.alias("price"),
                price_confidence.alias("price_confidence"),
                reasoning.alias("price_reasoning"),
            ),
        )

    return let(F.try_parse_json(json_text(answer)), build)
