"""Classification queries: documents with their labels as the stored classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from townbill.bindings.registry import query, table
from townbill.bindings.views import document_listings
from townbill.operators import classify
from townbill.functions import prices

CLASS_COLUMNS = (
    "CAST(NULL AS BOOLEAN) AS kid_relevant, CAST(NULL AS VARCHAR) AS age_confidence, CAST(NULL AS VARCHAR) AS age_reasoning"
)
# relevance comes from quality; toxic rows were stored without an answer
PRIOR = """
batch AS (SELECT doc_id, 'd' || doc_id AS id, split_part(text, '.', 1) AS title, text AS description,
                 doc_id % 3 = 0 AS registration_required, lang FROM documents),
prior AS (SELECT 'd' || doc_id AS id, quality = 1 AS kid_relevant,
                 CASE WHEN doc_id % 4 = 0 THEN 'low' ELSE 'high' END AS age_confidence,
                 CASE WHEN doc_id % 2 = 0 THEN 'free' ELSE 'paid' END AS price_class
          FROM labels WHERE toxic = 0),
carried AS (
  SELECT b.*, p.id IS NOT NULL AS carried, p.kid_relevant, p.age_confidence,
         CASE WHEN p.id IS NOT NULL THEN p.price_class ELSE 'unknown' END AS price_class,
         CASE WHEN p.id IS NOT NULL THEN p.price_class = 'free' END AS is_free
  FROM batch b LEFT JOIN prior p ON p.id = b.id)
"""
CAP = 120
CAPPED = f"""
{PRIOR},
ranked AS (SELECT *, SUM(CASE WHEN carried THEN 0 ELSE 1 END) OVER (ORDER BY doc_id) AS spent FROM carried),
capped AS (SELECT *, NOT carried AND spent > {CAP} AS budget_skipped FROM ranked)
"""


def batch(spark, sf):
    none = lambda kind: F.lit(None).cast(kind)
    return document_listings(spark, sf).withColumns(
        {
            "kid_relevant": none("boolean"), "age_buckets": none("array<string>"), "age_confidence": none("string"),
            "age_reasoning": none("string"), "price_class": F.lit("unknown"), "price_confidence": F.lit("inferred"),
            "price_reasoning": none("string"), "is_free": none("boolean"), "price_text": none("string"),
            "price_locked": F.col("seq") % 10 == 0,
        }
    )


def prior(spark, sf):
    k = F.col("doc_id")
    price = F.when(k % 2 == 0, "free").otherwise("paid")
    return table(spark, sf, "labels").select(
        F.concat(F.lit("d"), k.cast("string")).alias("id"),
        F.when(F.col("toxic") == 0, F.col("quality") == 1).alias("kid_relevant"),
        F.array(F.lit("kids")).alias("age_buckets"),
        F.when(k % 4 == 0, "low").otherwise("high").alias("age_confidence"),
        F.lit("stored").alias("age_reasoning"),
        prices.is_free_of(price).alias("is_free"),
        prices.price_text_of(price).alias("price_text"),
        price.alias("price_class"),
        F.lit("confirmed").alias("price_confidence"),
        F.lit("stored").alias("price_reasoning"),
    )


@query(f"WITH {PRIOR} SELECT id, carried, kid_relevant, age_confidence, price_class, is_free FROM carried")
def carry_forward(spark, sf):
    rows = classify.carry_forward(batch(spark, sf), prior(spark, sf))
    return rows.select("id", "carried", "kid_relevant", "age_confidence", "price_class", "is_free")


@query(f"WITH {CAPPED} SELECT id, carried, budget_skipped FROM capped")
def capped_pending(spark, sf):
    rows = classify.with_spend_cap(classify.carry_forward(batch(spark, sf), prior(spark, sf)), CAP)
    return rows.select("id", "carried", "budget_skipped")


@query(f"WITH {PRIOR} SELECT id, title, description FROM carried WHERE NOT carried")
def due_for_classifier(spark, sf):
    return classify.to_classify(classify.with_spend_cap(classify.carry_forward(batch(spark, sf), prior(spark, sf)), None))


def answers(spark, sf):
    """Classifier answers as text, one per document, some fenced, some unusable, some for unknown ids."""
    d = table(spark, sf, "documents")
    k = F.col("doc_id")
    body = F.concat(
        F.lit('{"kid_relevant": '), F.when(k % 2 == 0, "true").otherwise("false"),
        F.lit(', "age_buckets": ["kids", "adults", 7, "teen"], "confidence": "'),
        F.when(k % 7 == 0, "certain").when(k % 7 == 1, "low").otherwise("high"),
        F.lit('", "price": "'), F.when(k % 3 == 0, "free").when(k % 3 == 1, "paid").otherwise("cheap"),
        F.lit('", "reasoning": "because"}'),
    )
    answer = (
        F.when(k % 5 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(k % 5 == 1, F.concat(F.lit("Answer: "), body, F.lit(" done")))
        .when(k % 11 == 0, "no idea").otherwise(body)
    )
    prefix = F.when(k % 13 == 0, "x").otherwise("d")
    return d.select(F.concat(prefix, k.cast("string")).alias("id"), answer.alias("answer"))


READABLE = "(doc_id % 7 <> 0 AND NOT (doc_id % 5 > 1 AND doc_id % 11 = 0))"
USABLE = f"({READABLE} AND doc_id % 13 <> 0)"


@query(
    f"""WITH parsed AS (SELECT *, {READABLE} AS ok FROM documents)
    SELECT CASE WHEN doc_id % 13 = 0 THEN 'x' ELSE 'd' END || doc_id AS id, CASE WHEN ok THEN doc_id % 2 = 0 END AS kid_relevant,
           CASE WHEN ok THEN CASE WHEN doc_id % 2 = 0 THEN ['kids', 'teen'] ELSE CAST([] AS VARCHAR[]) END END AS age_buckets,
           CASE WHEN ok THEN CASE WHEN doc_id % 7 = 1 THEN 'low' ELSE 'high' END END AS age_confidence,
           CASE WHEN ok THEN CASE doc_id % 3 WHEN 0 THEN 'free' WHEN 1 THEN 'paid' ELSE 'unknown' END END AS price,
           CASE WHEN ok THEN CASE WHEN doc_id % 3 = 0 THEN 'inferred' ELSE 'confirmed' END END AS price_confidence
    FROM parsed"""
)
def parsed_answers(spark, sf):
    from townbill.functions.model_output import parse_answer

    found = answers(spark, sf).select("id", parse_answer(F.col("answer")).alias("a"))
    return found.select("id", "a.kid_relevant", "a.age_buckets", "a.age_confidence", "a.price", "a.price_confidence")


@query(
    f"""WITH {PRIOR}, due AS (
      SELECT *, NOT carried AS asked, NOT carried AND {USABLE} AS ok,
             regexp_matches(lower(title || ' ' || description), '\\b(camp|class|clinic|workshop|lessons|league|academy|tournament|per child|per person|materials fee|deposit)\\b')
               OR registration_required AS doubtful FROM carried),
    answered AS (
      SELECT id, CASE WHEN ok THEN doc_id % 2 = 0 WHEN asked THEN false ELSE kid_relevant END AS kid_relevant,
           CASE WHEN ok THEN CASE WHEN doc_id % 2 = 0 THEN ['kids', 'teen'] ELSE CAST([] AS VARCHAR[]) END
                WHEN NOT asked THEN ['kids'] END AS age_buckets,
           CASE WHEN ok THEN CASE WHEN doc_id % 7 = 1 THEN 'low' ELSE 'high' END WHEN NOT asked THEN age_confidence END AS age_confidence,
           CASE WHEN ok THEN 'because' WHEN asked THEN 'classification unavailable (hidden)' ELSE 'stored' END AS age_reasoning,
           ok AND doc_id % 10 <> 0 AS priced, is_free AS was_free,
           CASE WHEN ok AND doc_id % 10 <> 0 THEN
             CASE doc_id % 3 WHEN 0 THEN CASE WHEN doubtful THEN 'unknown' ELSE 'free' END WHEN 1 THEN 'paid' ELSE 'unknown' END
             ELSE price_class END AS price_class
      FROM due)
    SELECT id, kid_relevant, age_buckets, age_confidence, age_reasoning, price_class,
           CASE WHEN priced THEN CASE price_class WHEN 'free' THEN true WHEN 'paid' THEN false END ELSE was_free END AS is_free
    FROM answered"""
)
def apply_answers(spark, sf):
    uncapped = classify.with_spend_cap(classify.carry_forward(batch(spark, sf), prior(spark, sf)))
    # every answer came twice, the earlier one unusable
    twice = answers(spark, sf).withColumn("answered_at", F.lit(2))
    twice = twice.unionByName(twice.select("id", F.lit("?").alias("answer"), F.lit(1).alias("answered_at")))
    return classify.apply_answers(uncapped, twice).select(
        "id", "kid_relevant", "age_buckets", "age_confidence", "age_reasoning", "price_class", "is_free"
    )


# an English word list that occurs in the texts stands in for the adult phrases
@query(
    f"""WITH {PRIOR} SELECT id, CASE WHEN age_confidence = 'low'
      OR regexp_matches(lower(title || ' ' || description), '\\bwith the\\b|\\bquality\\s+only') THEN false ELSE kid_relevant END AS kid_relevant
    FROM carried"""
)
def adult_override(spark, sf):
    rows = classify.carry_forward(batch(spark, sf), prior(spark, sf))
    return classify.hide_adult(rows, [("with the", r"\bwith the\b"), ("quality", r"\bquality\s+only")]).select("id", "kid_relevant")


@query(
    """WITH cases AS (SELECT CASE WHEN l.quality = 1 THEN 'free' ELSE 'paid' END AS expected,
        CASE WHEN contains(lower(text), 'free') THEN 'free' WHEN contains(lower(text), 'sing') THEN 'paid' ELSE 'unknown' END AS got
        FROM labels l JOIN documents d ON d.doc_id = l.doc_id)
    SELECT expected, got, COUNT(*) AS cases, COUNT(*) FILTER (expected = got) AS passed FROM cases GROUP BY expected, got"""
)
def calibration_matrix(spark, sf):
    text = F.lower("text")
    got = F.when(F.contains(text, F.lit("free")), "free").when(F.contains(text, F.lit("sing")), "paid").otherwise("unknown")
    cases = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", got.alias("got")), "doc_id")
    return classify.calibration_matrix(
        cases.select(F.when(F.col("quality") == 1, "free").otherwise("paid").alias("expected"), "got")
    )
