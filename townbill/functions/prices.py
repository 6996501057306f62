"""Price signals, price classes and price badges."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from townbill import fixed
from townbill.functions.text import holds_any, joined, let, matches_any, trim, whole_word_any


def price_signal(
    text: Column,
    paid_phrases=fixed.PAID_PHRASES,
    paid_patterns=fixed.PAID_PATTERNS,
    free_phrases=fixed.FREE_PHRASES,
    free_patterns=fixed.FREE_PATTERNS,
    ambiguous_phrases=fixed.AMBIGUOUS_PHRASES,
) -> Column:
    """'paid', 'free', 'ambiguous' or 'none'; an explicit paid signal always wins."""

    def signal(t: Column) -> Column:
        return (
            F.when(holds_any(t, paid_phrases) | matches_any(t, paid_patterns), "paid")
            .when(holds_any(t, free_phrases) | matches_any(t, free_patterns), "free")
            .when(holds_any(t, ambiguous_phrases), "ambiguous")
            .otherwise("none")
        )

    return let(F.lower(text), signal)


def _priced(price_class: Column, confidence: Column) -> Column:
    return F.struct(price_class.alias("price_class"), confidence.alias("price_confidence"))


def raw_price(signal: Column) -> Column:
    """Class and confidence that a keyword signal stands for, before any downgrade."""
    price_class = F.when(signal == "paid", "paid").when(signal == "ambiguous", "unknown").otherwise("free")
    confidence = F.when(signal.isin("paid", "free"), "confirmed").otherwise("inferred")
    return _priced(price_class, confidence)


def resolve_price(
    price_class: Column,
    confidence: Column,
    text: Column,
    registration_required: Column,
    paid_words=fixed.STRUCTURALLY_PAID,
) -> Column:
    """Free that was only assumed becomes unknown where the text suggests a paid programme."""
    assumed_free = (price_class == "free") & (confidence == "inferred")
    doubtful = F.coalesce(registration_required, F.lit(False)) | whole_word_any(text, paid_words)
    return let(
        assumed_free & doubtful,
        lambda downgraded: _priced(
            F.when(downgraded, "unknown").otherwise(price_class), F.when(downgraded, "inferred").otherwise(confidence)
        ),
    )


def fallback_price(title: Column, description: Column, registration_required: Column) -> Column:
    """Price class without any model: keyword signal, then the downgrade."""
    return let(
        let(price_signal(joined(title, description, "\n")), raw_price),
        lambda raw: resolve_price(
            raw["price_class"], raw["price_confidence"], joined(title, description), registration_required
        ),
    )


def cost_field_class(raw: Column) -> Column:
    """A stated cost field: free beats paid, anything else is not a price."""

    def stated(s: Column) -> Column:
        paid = s.rlike(r"\$\s*\d") | F.contains(s, F.lit("paid")) | matches_any(s, [("fee", r"\bfees?\b")])
        return F.when(F.contains(s, F.lit("free")), "free").when(paid, "paid")

    return let(trim(F.lower(raw)), stated)


def is_free_of(price_class: Column) -> Column:
    return F.when(price_class == "free", True).when(price_class == "paid", False)


def price_text_of(price_class: Column) -> Column:
    return F.when(price_class == "free", "Free").when(price_class == "paid", "Paid")


def price_badge(
    source: Column,
    price_class: Column,
    confidence: Column,
    is_free: Column,
    inferred_sources=fixed.INFERRED_SOURCES,
) -> Column:
    """Struct(kind, label, inferred); a null struct means no badge."""
    estimated_source = source.isin(*inferred_sources)
    label = F.when(estimated_source, price_text_of(price_class)).otherwise(
        F.when(is_free, "Free").when(~is_free, "Paid")
    )
    inferred = estimated_source & ~confidence.eqNullSafe("confirmed")
    kind = F.concat(F.lower(label), F.when(inferred, "-inferred").otherwise("-confirmed"))
    return F.when(label.isNotNull(), F.struct(kind.alias("kind"), label.alias("label"), inferred.alias("inferred")))


def card_price_text(badge: Column) -> Column:
    return F.when(badge["inferred"], F.concat(badge["label"], F.lit(" ✦"))).otherwise(badge["label"])


def detail_price_text(badge: Column) -> Column:
    return F.when(badge["kind"] == "free-confirmed", "Free admission").otherwise(card_price_text(badge))
