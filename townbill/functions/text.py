"""Text clean-up expressions."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from townbill import fixed

# ---- fixed values: white space as browsers count it, the ASCII set plus the Unicode spaces ----
SPACE_CHARS = (
    " \t\n\x0B\f\r\u00A0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200A"
    "\u2028\u2029\u202F\u205F\u3000\uFEFF"
)
SPACES = r"\s\x0B\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
SPACE = f"[{SPACES}]"
# a run of white space other than one plain blank
UNEVEN_SPACE = rf"(?: {SPACE}+|[{SPACES}&&[^ ]]{SPACE}*)"
# ASCII word edges; Java's own \b also counts accented letters as word characters
EDGE_BEFORE = r"(?<![A-Za-z0-9_])"
EDGE_AFTER = r"(?![A-Za-z0-9_])"
EDGE = rf"(?:{EDGE_BEFORE}(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_]){EDGE_AFTER})"

HEX_RUN = r"(?:&#x[0-9a-fA-F]+;)+"
DEC_RUN = r"(?:&#\d+;)+"


def ascii_edges(pattern: str) -> str:
    """Rewrite \\b in a pattern to an ASCII word edge; one that opens a word needs only look back."""
    pattern = re.sub(r"\\b(?=[A-Za-z0-9])", lambda _: EDGE_BEFORE, pattern)
    return pattern.replace(r"\b", EDGE)


def words_array(words) -> Column:
    """A constant array of strings."""
    return F.split(F.lit("\u0001".join(words)), "\u0001", -1)


def replace_all(c: Column, pairs) -> Column:
    """Replace each first string by its second, one pair after the other."""
    olds, news = (words_array(side) for side in zip(*pairs))
    return F.reduce(F.arrays_zip(olds, news), c, lambda text, pair: F.replace(text, pair["0"], pair["1"]))


def let(c: Column, body) -> Column:
    """Evaluate c once and hand it to body as a variable."""
    return F.transform(F.array(c), body)[0]


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE_CHARS))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, UNEVEN_SPACE, " "))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def strip_tags(c: Column, filler: str = "") -> Column:
    return F.regexp_replace(c, "<[^>]+>", filler)


def plain_text(c: Column) -> Column:
    return collapse(F.regexp_replace(c, "<[^>]*>", " "))


def element_body(rest: Column, tag: str) -> Column:
    """What is inside an element whose opening tag `rest` begins in; all of `rest` if it is never closed.

    The text is cut before every opening and closing tag of that name; the running depth over the pieces
    says which closing tag is the element's own.
    """
    pieces = F.split(rest, rf"(?i)(?=<{tag}[\s>/])|(?=</{tag}\s*>)")
    start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("seen"), F.lit(0).alias("inside"))

    def step(at: Column, piece: Column) -> Column:
        opens, closes = piece.rlike(rf"(?i)^<{tag}[\s>/]"), piece.rlike(rf"(?i)^</{tag}\s*>")
        depth = at["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        ended = (at["inside"] == 0) & (depth == 0)
        return F.struct(depth.alias("depth"), (at["seen"] + 1).alias("seen"), F.when(ended, at["seen"]).otherwise(at["inside"]).alias("inside"))

    inside = F.aggregate(pieces, start, step)["inside"]
    return F.array_join(F.slice(pieces, F.lit(1), F.when(inside > 0, inside).otherwise(F.size(pieces))), "")


def normalise_title(c: Column) -> Column:
    return collapse(F.lower(c))


def compute_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add costly columns through a generator step.

    The optimizer copies an ordinary projected expression into the filters and projections
    that use it, and would then run a page's regular expressions once per use.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _decode_runs(c: Column, run: str, unit: str, to_hex) -> Column:
    """Replace each run of numeric entities by the UTF-16 text its code units spell."""
    decoded = F.transform(
        F.regexp_extract_all(c, F.lit(run), F.lit(0)),
        lambda r: F.decode(
            F.unhex(F.array_join(F.transform(F.regexp_extract_all(r, F.lit(unit), F.lit(1)), to_hex), "")),
            "UTF-16BE",
        ),
    )
    pieces = F.zip_with(
        F.split(c, run, -1), decoded, lambda p, d: F.concat(F.coalesce(p, F.lit("")), F.coalesce(d, F.lit("")))
    )
    return F.when(F.contains(c, F.lit("&#")), F.array_join(pieces, "")).otherwise(c)


def decode_entities(c: Column) -> Column:
    """Named entities in their fixed order, then numeric ones, then white space."""

    hex_unit = lambda h: F.right(F.concat(F.lit("000"), h), F.lit(4))
    dec_unit = lambda d: hex_unit(F.hex((F.coalesce(d.try_cast("decimal(38,0)"), F.lit(0)) % 65536).cast("bigint")))

    def decoded(t: Column) -> Column:
        out = let(replace_all(t, fixed.ENTITIES), lambda u: _decode_runs(u, HEX_RUN, r"&#x([0-9a-fA-F]+);", hex_unit))
        out = let(out, lambda u: _decode_runs(u, DEC_RUN, r"&#(\d+);", dec_unit))
        return F.when(F.contains(t, F.lit("&")), out).otherwise(t)

    return collapse(let(c, decoded))


def holds_any(lowered: Column, words) -> Column:
    """Does the text, lower-cased already, hold any of the words, anywhere?"""
    if len(words) < 3:
        return reduce(or_, [F.contains(lowered, F.lit(w)) for w in words])
    return F.exists(words_array(words), lambda w: F.contains(lowered, w))


def contains_any(c: Column, words) -> Column:
    return let(F.lower(c), lambda t: holds_any(t, words))


def matches_any(lowered: Column, patterns) -> Column:
    """Does any (letters, pattern) pair match? The search for the letters spares most rows the pattern."""
    return reduce(or_, [F.contains(lowered, F.lit(part)) & lowered.rlike(ascii_edges(p)) for part, p in patterns])


def whole_words(lowered: Column, words) -> Column:
    """The cheap search for the letters decides most rows; the pattern then checks the edges."""
    alternatives = "|".join(re.escape(w) for w in words)
    return holds_any(lowered, words) & lowered.rlike(f"{EDGE_BEFORE}(?:{alternatives}){EDGE_AFTER}")


def whole_word_any(c: Column, words) -> Column:
    return let(F.lower(c), lambda t: whole_words(t, words))


def joined(a: Column, b: Column, glue: str = " ") -> Column:
    """Title and description as one text; a missing part counts as empty."""
    return F.concat(F.coalesce(a, F.lit("")), F.lit(glue), F.coalesce(b, F.lit("")))


# ---- fixed values: feed text clutter ----
LEADING_DATE = (
    r"(?i)^[A-Za-z]+,?\s+[A-Za-z]+\s+\d{1,2}\s+\d{4}\s+\d{1,2}:\d{2}[ap]m\s*-\s*\d{1,2}:\d{2}[ap]m\s*"
)
TRAILING_READ_ON = r"(?i)\s*Read on\s*$"


def clean_feed_description(c: Column) -> Column:
    c = F.regexp_replace(strip_tags(F.coalesce(c, F.lit(""))), LEADING_DATE, "")
    return blank_to_null(trim(F.regexp_replace(c, TRAILING_READ_ON, "")))


# Characters a whole-URI encoder leaves alone but the form encoder escapes.
KEPT_IN_URI = ";,/?:@&=+$!~'()#"


def encode_uri(c: Column) -> Column:
    return replace_all(F.url_encode(c), [("+", "%20"), *((f"%{ord(ch):02X}", ch) for ch in KEPT_IN_URI)])


def short_venue(location: Column, city_label: Column) -> Column:
    """Venue name cut before its street number, followed by the city."""
    name = trim(F.split(location, rf"{SPACE}*[-–]{SPACE}*\d", 2)[0])
    return F.when(name == "", city_label).otherwise(F.concat(name, F.lit(", "), city_label))


def meta_description(
    description: Column, location: Column, is_free: Column, city_label: Column, site_name: str = "this site"
) -> Column:
    made = F.concat(
        F.when(is_free, "Free ").otherwise(""),
        F.lit("kids event"),
        F.when(F.coalesce(location, F.lit("")) != "", F.concat(F.lit(" at "), location)).otherwise(""),
        F.lit(" in "),
        city_label,
        F.lit(f", TX — details, date, time, and directions on {site_name}."),
    )
    cut = lambda raw: F.concat(F.regexp_replace(F.substring(raw, 1, 152), rf"{SPACE}+[^{SPACES}]*$", ""), F.lit("…"))
    return let(
        plain_text(description),
        lambda raw: F.when(F.length(raw) > 155, cut(raw)).when(F.length(raw) > 40, raw).otherwise(made),
    )


def page_title(title: Column, location: Column, organisation: Column, is_free: Column) -> Column:
    return F.concat(
        title, F.lit(" — "), F.coalesce(location, organisation), F.when(is_free, " — Free").otherwise("")
    )


def slug_filename(title: Column, suffix: str = ".ics") -> Column:
    slug = F.regexp_replace(F.substring(title, 1, 40), "[^A-Za-z0-9]+", "-")
    slug = F.regexp_replace(slug, "^-|-$", "")
    return F.concat(F.when(slug == "", "event").otherwise(slug), F.lit(suffix))


def item_url(site: str, item_id: Column) -> Column:
    return F.concat(F.lit(site.rstrip("/") + "/events/"), item_id)


def city_url(site: str, city: Column) -> Column:
    return F.concat(F.lit(site.rstrip("/") + "/"), city)
