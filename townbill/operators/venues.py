"""Venue positions from a table of name fragments of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from townbill import fixed

POINT = "struct<lat:double,lng:double>"


def _grams(text: Column, n: Column) -> Column:
    """The distinct substrings of n characters; the empty one for n = 0."""
    last = F.length(text) - n + 1
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, n)))).otherwise(
        F.array().cast("array<string>")
    )


def locate(
    rows: DataFrame, fragments: DataFrame, location: str = "location_name", into: str = "point", default=fixed.DEFAULT_COORDS, gram: int = 5
) -> DataFrame:
    """`rows` with struct(lat, lng) of the first fragment, by `priority`, that occurs in the lower-cased location.

    `fragments` has (fragment, priority, lat, lng); fragments are compared as they are, null ones never
    match, an empty one matches every location. Equal priorities go by the fragment's text, then by the
    smaller position. Rows with a null location or without a match get `default`; repeated rows stay, and
    a column named like `into` is replaced.

    Each fragment is indexed under that one of its substrings of `gram` characters (the whole fragment if
    it is shorter) that the fewest distinct names hold, and only names with that substring are compared
    with it. Names travel as digests, once a substring; their texts meet only the candidates.
    """
    key = F.lower(F.col(location))
    listed = fragments.where("fragment IS NOT NULL").select(
        F.col("fragment").cast("string").alias("fragment"),
        F.struct("priority", "fragment", F.struct(F.col("lat").cast("double").alias("lat"), F.col("lng").cast("double").alias("lng")).alias("point")).alias("entry"),
    )
    listed = listed.groupBy("fragment").agg(F.min("entry").alias("entry"))
    names = rows.select(key.alias("name")).where("name IS NOT NULL").distinct().withColumn("digest", F.sha2(F.col("name"), 256))

    size = F.least(F.length("fragment"), F.lit(gram))
    sizes = [r[0] for r in listed.select(size).distinct().collect()]  # at most gram + 1 numbers
    if not sizes:
        sizes = [gram]
    held = names.select("digest", F.explode(F.flatten(F.array(*[_grams(F.col("name"), F.lit(n)) for n in sorted(sizes)]))).alias("gram"))
    counts = held.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    parts = listed.select("fragment", F.explode(_grams(F.col("fragment"), size)).alias("gram"))
    # a fragment with a substring that no name holds is indexed there and meets nothing
    rarest = (
        parts.join(counts, "gram", "left")
        .groupBy("fragment")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("least"))
        .where("least.n > 0")
        .select("fragment", F.col("least.gram").alias("gram"))
    )
    candidates = held.join(rarest, "gram").select("digest", "fragment")
    found = (
        candidates.join(names, "digest")
        .where(F.contains("name", "fragment"))
        .select("digest", "fragment")
        .join(listed, "fragment")
        .groupBy("digest")
        .agg(F.min("entry").alias("entry"))
        .select("digest", F.col("entry.point").alias("found"))
    )
    kept = [c for c in rows.columns if c.lower() != into.lower()]
    held_rows = rows.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.sha2(key, 256).alias("digest"))
    otherwise = F.struct(F.lit(default[0]).alias("lat"), F.lit(default[1]).alias("lng")).cast(POINT)
    return held_rows.join(found, "digest", "left").select("row.*", F.coalesce("found", otherwise).alias(into))
