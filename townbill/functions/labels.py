"""Category, registration, venue, supervision and disclosure expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from townbill import fixed
from townbill.functions.text import contains_any, holds_any, joined, let


def guess_category(title: Column, description: Column, words=fixed.CATEGORY_WORDS) -> Column:
    """The first category any of whose words occurs, as part of a word or whole."""
    return let(
        F.lower(joined(title, description)),
        lambda t: F.coalesce(
            *[F.when(holds_any(t, stems), category) for category, stems in words], F.lit(fixed.DEFAULT_CATEGORY)
        ),
    )


def needs_registration(title: Column, description: Column, words=fixed.REGISTRATION_KEYWORDS) -> Column:
    return contains_any(joined(title, description), words)


def is_admin_item(title: Column, words=fixed.ADMIN_KEYWORDS) -> Column:
    return contains_any(title, words)


def venue_coordinates(location: Column, venues=fixed.VENUE_COORDS, default=fixed.DEFAULT_COORDS) -> Column:
    """Struct(lat, lng) of the first listed venue whose name occurs in the location."""
    point = lambda lat, lng: F.struct(F.lit(lat).alias("lat"), F.lit(lng).alias("lng"))
    return let(
        F.lower(location),
        lambda name: F.coalesce(
            *[F.when(F.contains(name, F.lit(v)), point(lat, lng)) for v, lat, lng in venues], point(*default)
        ),
    )


def city_of(source: Column, dim: dict = fixed.SOURCE_DIM) -> Column:
    plano = [s for s, (_, _, _, city) in dim.items() if city == "plano"]
    return F.when(source.isin(*plano), "plano").otherwise("frisco")


# ---- fixed values: supervision texts ----
LIBRARY_TEEN = "Can kids be dropped off? Yes — teens 13+ may attend alone"
LIBRARY_YOUNG = "Can kids be dropped off? No — adult must stay with child"
LIBRARY_MIXED = "Can kids be dropped off? Only if child is 10 or older (Frisco Library policy)"
LIBRARY_UNKNOWN = "Can kids be dropped off? Check with Frisco Library"
STAY = "Can kids be dropped off? Plan to stay"
STAY_NOTE = (
    "No formal Plano Library policy — staff generally prefer a parent stay with younger kids, or remain in the library."
)
VENUE = "Can kids be dropped off? Check with venue"
VENUE_NOTE = "Check with venue before dropping off."


def supervision(source: Column, age_min: Column, age_max: Column) -> Column:
    """Struct(label, note) of the drop-off rule; null for a source without one."""
    rule = lambda label, note=None: F.struct(F.lit(label).alias("label"), F.lit(note).cast("string").alias("note"))
    library = (
        F.when(age_min >= 13, rule(LIBRARY_TEEN))
        .when(age_max <= 9, rule(LIBRARY_YOUNG))
        .when(age_min.isNotNull() & age_max.isNotNull(), rule(LIBRARY_MIXED))
        .otherwise(rule(LIBRARY_UNKNOWN))
    )
    return (
        F.when(source == "frisco-library", library)
        .when(source == "plano-library", rule(STAY, STAY_NOTE))
        .when(source.isin("play-frisco", "kaleidoscope-park"), rule(VENUE, VENUE_NOTE))
    )


def inference_disclosure(age_badge: Column, price_badge: Column) -> Column:
    """One line naming what was estimated, null when nothing was."""
    age = F.when(
        age_badge["inferred"],
        F.when(age_badge["kind"] == "inferred-family", "Family suitability").otherwise("Age suitability"),
    )
    price = F.when(price_badge["inferred"], F.concat(F.lit("'"), price_badge["label"], F.lit("' admission status")))
    subject = F.concat_ws(" and ", age, price)
    return F.when(subject != "", F.concat(subject, F.lit(" estimated from event description")))
