"""Age ranges, age badges and age filters."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, functions as F

from townbill import fixed
from townbill.functions.text import SPACE, blank_to_null, holds_any, let


SECTION_END = r"(?i)<h[1-6][\s>]|</(?:section|article|main|body)>"


def _range(lo: Column | int | None, hi: Column | int | None, label: Column | str | None) -> Column:
    as_col = lambda v, t: v.cast(t) if isinstance(v, Column) else F.lit(v).cast(t)
    return F.struct(
        as_col(lo, "int").alias("age_min"), as_col(hi, "int").alias("age_max"), as_col(label, "string").alias("age_label")
    )


def ranges_overlap(a_lo: Column, a_hi: Column, b_lo, b_hi) -> Column:
    return (a_lo <= b_hi) & (a_hi >= b_lo)


def parse_age_text(c: Column) -> Column:
    """'6–12' or '5+' to a range; the text itself is the label."""
    text = blank_to_null(c)
    pair = rf"(\d+){SPACE}*[-–]{SPACE}*(\d+)"
    plus = r"(\d+)\+"
    is_pair = text.rlike(pair)
    lo = F.when(is_pair, F.regexp_extract(text, pair, 1)).when(text.rlike(plus), F.regexp_extract(text, plus, 1))
    hi = F.when(is_pair, F.regexp_extract(text, pair, 2))
    return _range(lo.try_cast("int"), hi.try_cast("int"), text)


# group flag -> (lowest age, highest age, fallback label)
CHILD_GROUPS = {
    "young": (0, 5, "Children (0–5)"),
    "middle": (6, 12, "Children (6–12)"),
    "tween": (10, 13, "Tweens (10–13)"),
    "teen": (13, 17, "Teens"),
    "everyone": (0, 17, None),
}


def range_from_flags(flags: dict[str, Column], label: Column | None = None) -> Column:
    """Age range from audience flags `adult`, `young`, `middle`, `tween`, `teen`, `everyone`.

    Adults together with young children (or everyone) mean 0–17, with teens only 13–17, alone
    18–99. Otherwise the range spans the child groups present; none present gives nulls.
    """
    flags = {"everyone": F.lit(False), **flags}
    young_kid = flags["young"] | flags["middle"] | flags["tween"] | flags["everyone"]
    present = [(flags[g], lo, hi) for g, (lo, hi, _) in CHILD_GROUPS.items()]
    lows = F.least(*[F.when(f, lo) for f, lo, _ in present])
    highs = F.greatest(*[F.when(f, hi) for f, _, hi in present])
    kid_label = F.lit(None) if label is None else label
    return (
        F.when(flags["adult"] & young_kid, _range(0, 17, None))
        .when(flags["adult"] & flags["teen"], _range(13, 17, None))
        .when(flags["adult"], _range(18, 99, None))
        .otherwise(_range(lows, highs, F.when(lows.isNotNull(), kid_label)))
    )


def audience_flags(name: Column) -> dict[str, Column]:
    """Which audience groups one lower-cased taxonomy name stands for."""
    has = lambda *words: F.coalesce(holds_any(name, words), F.lit(False))
    return {
        "adult": has("adult", "senior"),
        "everyone": has("all ages", "famil"),
        "young": has("children (0", "0-5", "preschool", "toddler", "baby", "babies"),
        "middle": has("children (6", "6-12") | (has("kids") & ~has("all")),
        "tween": has("tween"),
        "teen": has("teen"),
    }


def _block(html: Column, mark: str, window: int | None) -> Column:
    """The page from the mark to its next heading or section end, or no more than a stated width."""
    at = F.instr(html, mark)
    rest = F.substring(html, at, F.lit(window if window is not None else 2**31 - 1))
    return F.split(rest, SECTION_END, 2)[0]


def suitable_for_range(html: Column, window: int | None = None) -> Column:
    """Range from the 'Suitable for' block of an older detail page."""
    groups = ("young", "middle", "tween", "teen")

    def read(block: Column) -> Column:
        words = {"young": "children (0", "middle": "children (6", "tween": "tween", "teen": "teen"}
        flags = {g: F.contains(block, F.lit(words[g])) for g in groups}
        flags["adult"] = holds_any(block, ("adult", "senior"))
        count = reduce(add, [flags[g].cast("int") for g in groups])
        only = F.coalesce(*[F.when(flags[g], F.lit(CHILD_GROUPS[g][2])) for g in groups])
        return range_from_flags(flags, F.when(count == 1, only))

    at = F.instr(html, "Suitable for")
    block = F.lower(_block(html, "Suitable for", window))
    return F.when(at > 0, let(block, read)).otherwise(_range(None, None, None))


def audience_links(html: Column, window: int | None = None) -> Column:
    """Decoded audience values linked from the AGE GROUP block; null when there is no block."""
    at = F.instr(html, "AGE GROUP")
    raw = F.regexp_extract_all(_block(html, "AGE GROUP", window), F.lit('href="/events\\?a=([^"]+)"'), F.lit(1))
    # '+' stays itself: it is escaped before the form decoder could read it as a space
    decoded = F.transform(raw, lambda v: F.coalesce(F.try_url_decode(F.replace(v, F.lit("+"), F.lit("%2B"))), v))
    return F.when(at > 0, decoded)


def audience_link_range(html: Column, table: dict = fixed.AUDIENCE_LINKS, window: int | None = None) -> Column:
    """Range, label and family flag from the audience links; child audiences decide if any."""
    lookup = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), _range(*v))])

    def summary(links: Column) -> Column:
        known = F.filter(F.transform(links, lambda v: F.try_element_at(lookup, v)), lambda r: r.isNotNull())
        return F.struct(known.alias("known"), F.array_contains(links, fixed.FAMILY_AUDIENCE).alias("is_family"))

    def result(found: Column) -> Column:
        known = found["known"]
        kids = F.filter(known, lambda r: r["age_min"] < fixed.ADULT_AGE)
        used = F.when(F.size(kids) > 0, kids).otherwise(known)
        return F.struct(
            F.array_min(F.transform(used, lambda r: r["age_min"])).alias("age_min"),
            F.array_max(F.transform(used, lambda r: r["age_max"])).alias("age_max"),
            F.when(F.size(known) == 1, known[0]["age_label"]).alias("age_label"),
            found["is_family"].alias("is_family"),
        )

    links = F.coalesce(audience_links(html, window), F.array().cast("array<string>"))
    return let(let(links, summary), result)


def _bucket_bounds(buckets: Column, table: dict) -> tuple[Column, Column]:
    lows = F.create_map(*[x for k, (lo, _) in table.items() for x in (F.lit(k), F.lit(lo))])
    highs = F.create_map(*[x for k, (_, hi) in table.items() for x in (F.lit(k), F.lit(hi))])
    return (
        F.array_min(F.transform(buckets, lambda b: F.try_element_at(lows, b))),
        F.array_max(F.transform(buckets, lambda b: F.try_element_at(highs, b))),
    )


def typical_age_range(age_min: Column, age_max: Column, buckets: Column, table: dict = fixed.BUCKET_RANGE) -> Column:
    lo, hi = _bucket_bounds(buckets, table)
    dash = lambda a, b: F.concat(a.cast("string"), F.lit("-"), b.cast("string"))
    return F.coalesce(dash(age_min, age_max), dash(lo, hi))


def passes_age_filter(
    ranges,
    source: Column,
    kid_relevant: Column,
    confidence: Column,
    buckets: Column,
    age_min: Column,
    age_max: Column,
    inferred_sources=fixed.INFERRED_SOURCES,
    table: dict = fixed.BUCKET_RANGE,
) -> Column:
    """Does the row overlap any of the selected (low, high) ranges?

    Inferred sources match by bucket, others by their stated range. Which buckets overlap the
    selection is known before the job runs, so the row test is a set overlap.
    """
    hit = [b for b, (lo, hi) in table.items() if any(lo <= r_hi and hi >= r_lo for r_lo, r_hi in ranges)]
    any_bucket = F.arrays_overlap(buckets, F.array(*[F.lit(b) for b in hit])) if hit else F.lit(False)
    inferred = kid_relevant & confidence.isin("high", "medium") & any_bucket
    stated = F.lit(False)
    for r_lo, r_hi in ranges:
        stated = stated | ranges_overlap(age_min, age_max, r_lo, r_hi)
    stated = stated & age_min.isNotNull() & age_max.isNotNull()
    return F.coalesce(F.when(source.isin(*inferred_sources), inferred).otherwise(stated), F.lit(False))


def age_badge(
    source: Column,
    kid_relevant: Column,
    confidence: Column,
    buckets: Column,
    age_min: Column,
    age_max: Column,
    inferred_sources=fixed.INFERRED_SOURCES,
    table: dict = fixed.BUCKET_RANGE,
) -> Column:
    """Struct(kind, label, inferred); a null struct means no badge."""
    badge = lambda kind, label, inferred: F.struct(
        F.lit(kind).alias("kind"), (label if isinstance(label, Column) else F.lit(label)).alias("label"),
        F.lit(inferred).alias("inferred"),
    )
    ages = lambda lo, hi: F.concat(F.lit("Ages "), lo.cast("string"), F.lit("–"), hi.cast("string"))
    family = F.coalesce(F.array_contains(buckets, "family"), F.lit(False))
    lo, hi = _bucket_bounds(buckets, table)
    shown = F.coalesce(kid_relevant & confidence.isin("high", "medium"), F.lit(False))
    inferred = (
        F.when(shown & family, badge("inferred-family", "Family", True))
        .when(shown & lo.isNotNull(), badge("inferred-specific", ages(lo, hi), True))
    )
    touched = [ranges_overlap(age_min, age_max, g_lo, g_hi) for g_lo, g_hi in fixed.AGE_GROUPS]
    groups = sum((F.coalesce(t.cast("int"), F.lit(0)) for t in touched), F.lit(0))
    single = (
        F.when(touched[0], "Ages 0–5").when(touched[1], "Ages 6–12")
        .when(source == "frisco-library", "Teens").otherwise("Ages 13–17")
    )
    stated = (
        F.when(family, badge("confirmed-family", "Family", False))
        .when(groups > 1, badge("structured-multi", ages(age_min, age_max), False))
        .when(groups == 1, badge("structured-specific", single, False))
    )
    return F.when(source.isin(*inferred_sources), inferred).otherwise(stated)


def card_age_text(badge: Column) -> Column:
    """What a list card shows: families, and a bare mark for an estimated range."""
    return (
        F.when(badge["kind"] == "confirmed-family", "Family")
        .when(badge["kind"] == "inferred-family", "~ Family ✦")
        .when(badge["kind"] == "inferred-specific", "✦")
    )


def detail_age_text(badge: Column) -> Column:
    return F.when(badge["inferred"], F.concat(F.lit("~ "), badge["label"], F.lit(" ✦"))).otherwise(badge["label"])
