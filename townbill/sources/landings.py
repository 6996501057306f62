"""Landed pages, feeds and payloads to listings.

Each extractor explodes and parses inside the row's own task; the only shuffle is the
first-occurrence step, which carries parsed fields, not page bodies.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from townbill import fixed
from townbill.functions import ages, labels, prices, text, wallclock
from townbill.functions.maths import safe_ratio
from townbill.operators.series import first_by, newest
from townbill.sources.tables import as_listings

# ---- fixed values: listing cards ----
CARD_DELIMITER = '<li><div class="cp-events-search-item">'
CARD_LINK = r'href="(https://friscolibrary\.bibliocommons\.com/events/([a-zA-Z0-9]+))"'
CARD_TITLE = r'(?s)data-key="event-link">(.*?)</a>'
CARD_MONTH = r'class="date-stamp__month"[^>]*>([^<]+)<'
CARD_DAY = r'class="date-stamp__day"[^>]*>([^<]+)<'
CARD_YEAR = r"on [A-Za-z]+ \d+, (\d{4})"
CARD_TIME = r'class="event-time"[^>]*>([^<]+)'
CARD_LOCATION = r'class="cp-event-location[^"]*"[^>]*>([^<]+)<'
CARD_TEASER = r'(?s)class="cp-event-description[^"]*"[^>]*>(.*?)</'
CARD_IMAGE = r'(?i)src="(https://friscolibrary\.bibliocommons\.com/events/uploads/images/[^"]+)"'
CARD_SERIES_MARK = "View all dates"

# ---- fixed values: calendar detail pages ----
CALENDAR_ID = r"(?i)EID=(\d+)"
PAGE_TITLE = r"(?is)<title[^>]*>(.*?)</title>"
TITLE_PREFIX = r"(?i)^Calendar\s*[•·]\s*"
START_ITEM = r'(?i)itemprop="startDate"[^>]*>([^<]+)</'
END_ITEM = r'(?i)itemprop="endDate"[^>]*>([^<]+)</'
DETAIL_HEADER = r"(?i)specificDetailHeader"
TIME_HEADER = r"(?is)specificDetailHeader[^>]*>\s*Time:(.*)"
DETAIL_ITEM = r"(?is)specificDetailItem[^>]*>(.*?)</div>"
END_CLOCK = r"(?i)[-–]\s*(\d{1,2}):(\d{2})\s*([AP]M)"
LOCATION_HEADER = r"(?is)specificDetailHeader[^>]*>\s*Location:(.*)"
LOCATION_ITEM = r'(?is)itemprop="location".*?itemprop="name"[^>]*>(.*?)</'
DESCRIPTION_MARK = 'itemprop="description" class="fr-view"'
PARAGRAPH = r"(?s)<p[^>]*>(.*?)</p>"
PRICE_ITEM = r'(?is)itemprop="price"[^>]*>(.*?)</div>'
IMAGE_META = r'(?i)<meta[^>]+property="og:image"[^>]+content="([^"]+)"'
REAL_IMAGE = r"(?i)ImageRepository/Document"

FEED_SCHEMA = """
channel STRUCT<item: ARRAY<STRUCT<
  title: STRING, link: STRING, guid: STRING, pubDate: STRING, `dc:date`: STRING,
  description: STRING, enclosure: STRUCT<_url: STRING>>>>
"""


def _found(c: Column, pattern: str, group: int = 1) -> Column:
    """First match of the group, null when the pattern does not occur."""
    return text.blank_to_null(F.regexp_extract(c, pattern, group))


def _detail(body: Column, header: str) -> Column:
    """The item under a header, looked for no further than the next header."""
    own = F.split(F.regexp_extract(body, header, 1), DETAIL_HEADER, 2)[0]
    return F.regexp_extract(own, DETAIL_ITEM, 1)


def _landed(at: str = "fetched_at") -> Column:
    """Sorts the latest landing of a page first, so that it wins over earlier ones."""
    return -F.unix_micros(at)


# ---- listing cards ----------------------------------------------------------------------


def extract_cards(pages: DataFrame) -> DataFrame:
    """Listing pages (page_no, fetched_at, body) to one row per card, first occurrence per id.

    Of several landings of a page the latest comes first.
    """
    chunks = F.split("body", r"\Q" + CARD_DELIMITER + r"\E")
    card = F.col("card")
    cards = pages.select(
        "page_no", "fetched_at", F.posexplode(F.slice(chunks, F.lit(2), F.size(chunks))).alias("pos", "card")
    )
    fields = text.compute_once(cards, event_id=_found(card, CARD_LINK, 2)).filter(F.col("event_id").isNotNull()).select(
        "page_no",
        "pos",
        "event_id",
        _found(card, CARD_LINK, 1).alias("event_url"),
        text.decode_entities(text.trim(text.strip_tags(_found(card, CARD_TITLE)))).alias("title"),
        text.trim(F.regexp_extract(card, CARD_MONTH, 1)).alias("month"),
        text.trim(F.regexp_extract(card, CARD_DAY, 1)).alias("day"),
        F.coalesce(_found(card, CARD_YEAR), F.year(wallclock.utc_date(F.col("fetched_at"))).cast("string")).alias("year"),
        text.trim(F.split(F.regexp_extract(card, CARD_TIME, 1), "–")[0]).alias("clock"),
        F.coalesce(text.blank_to_null(text.trim(_found(card, CARD_LOCATION))), F.lit(fixed.CARD_DEFAULT_LOCATION)).alias(
            "location_name"
        ),
        text.trim(text.strip_tags(F.regexp_extract(card, CARD_TEASER, 1))).alias("teaser"),
        text.encode_uri(text.decode_entities(_found(card, CARD_IMAGE))).alias("thumbnail_url"),
        F.contains(card, F.lit(CARD_SERIES_MARK)).alias("is_recurring"),
        F.col("fetched_at").alias("ingested_at"),
    )
    clock = F.regexp_replace(F.col("clock"), r"(?i)(\d+:\d+)am", "$1 AM")
    clock = F.regexp_replace(clock, r"(?i)(\d+:\d+)pm", "$1 PM")
    when_text = F.trim(F.concat(F.col("month"), F.lit(" "), F.col("day"), F.lit(", "), F.col("year"), F.lit(" "), clock))
    fields = fields.withColumn("landed", _landed("ingested_at"))
    firsts = first_by(fields, ["event_id"], ["page_no", "landed", "pos"]).withColumn("when_text", when_text)
    return (
        text.compute_once(firsts, start_datetime=wallclock.parse_wall_time(F.col("when_text")))
        .filter(F.col("title").isNotNull() & F.col("start_datetime").isNotNull())
        .drop("month", "day", "year", "clock")
    )


def resolve_audiences(pairs: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """(event_id, audience_id) pairs to one age range per event through the taxonomy (id, name).

    The flags are combined by aggregation, so no list of names is ever gathered per event.
    """
    named = pairs.join(taxonomy.select(F.col("id").alias("audience_id"), "name"), "audience_id", "left")
    flags = ages.audience_flags(F.lower(F.col("name")))
    grouped = named.groupBy("event_id").agg(
        *[F.bool_or(flag).alias(f"has_{k}") for k, flag in flags.items()],
        F.count_if(F.coalesce(F.col("name"), F.lit("")) != "").alias("known"),
        F.count("*").alias("ids"),
        F.min("name").alias("only_name"),
    )
    found = ages.range_from_flags(
        {k: F.col(f"has_{k}") for k in flags}, F.when(F.col("ids") == 1, F.col("only_name"))
    )
    return grouped.filter(F.col("known") > 0).select("event_id", found.alias("age")).select("event_id", "age.*")


def library_listings(pages: DataFrame, details: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Cards joined with their landed JSON details (event_id, body[, fetched_at]) and audience ages.

    Of several details of an event the latest counts.
    An unresolved audience falls back to 0–17; `age_resolved` tells the two apart.
    """
    doc = F.try_parse_json("body")
    get = lambda path, kind: F.try_variant_get(F.col("doc"), f"$.event.definition.{path}", kind)
    parsed = newest(details, "event_id", "fetched_at", "body").select("event_id", doc.alias("doc")).select(
        "event_id",
        get("audience_ids", "array<string>").alias("audience_ids"),
        text.blank_to_null(text.trim(get("description", "string"))).alias("detail_text"),
        get("featured_image_id", "string").alias("featured_image_id"),
    )
    ranges = resolve_audiences(
        parsed.select("event_id", F.explode("audience_ids").alias("audience_id")), taxonomy
    )
    detail = F.when(
        F.col("detail_text").isNotNull(), text.decode_entities(text.strip_tags(F.col("detail_text"), " "))
    ).otherwise(F.col("teaser"))
    resolved = F.col("age_min").isNotNull()
    joined = (
        extract_cards(pages)
        .join(parsed.drop("audience_ids"), "event_id", "left")
        .join(ranges, "event_id", "left")
        .withColumn("description", detail)
        .withColumn("age_resolved", resolved)
        .withColumn("age_max", F.when(resolved, F.col("age_max")).otherwise(17))
        .withColumn("age_min", F.when(resolved, F.col("age_min")).otherwise(0))
    )
    point = labels.venue_coordinates(F.col("location_name"))
    rows = (
        joined.withColumn("raw_json", F.to_json(F.struct(
            F.col("event_id").alias("eventId"), "title", F.col("when_text").alias("dateStr"),
            F.col("location_name").alias("location"), "featured_image_id",
        )))
        .withColumn("source", F.lit("frisco-library"))
        .withColumn("id", F.concat(F.lit("frisco-library-"), F.col("event_id")))
        .withColumn("is_free", F.lit(True))
        .withColumn("price_text", F.lit("Free"))
        .withColumn("recurrence_label", F.when(F.col("is_recurring"), "Recurring"))
        .withColumn("location_lat", point["lat"])
        .withColumn("location_lng", point["lng"])
    )
    return with_text_labels(rows).withColumn("seq", _sequence("page_no", "landed", "pos")).drop("landed")


def _sequence(*columns: str) -> Column:
    """Batch order from positions, as one sortable value."""
    return F.struct(*[F.col(c).cast("bigint").alias(c) for c in columns])


def with_text_labels(rows: DataFrame) -> DataFrame:
    title, description = F.col("title"), F.col("description")
    return rows.withColumn("category", labels.guess_category(title, description)).withColumn(
        "registration_required", labels.needs_registration(title, description)
    )


def audience_fallback(listings: DataFrame) -> DataFrame:
    """One row: how many listings fell back to all ages, and whether that warrants a warning."""
    counts = listings.agg(
        F.count("*").alias("total"), F.count_if(~F.col("age_resolved")).alias("fallback")
    )
    return fallback_verdict(counts)


def fallback_verdict(counts: DataFrame) -> DataFrame:
    share = safe_ratio(F.col("fallback"), F.col("total"))
    warn = (F.col("total") >= fixed.FALLBACK_MIN_TOTAL) & (share > fixed.FALLBACK_MAX_SHARE)
    return counts.withColumn("share", share).withColumn("warn", warn)


# ---- feeds ------------------------------------------------------------------------------


def extract_feed_items(feeds: DataFrame) -> DataFrame:
    """Landed feeds (branch, page_no, fetched_at, body) to one row per item, first branch wins.

    Of several landings of a page the latest comes first.
    """
    branch_order = F.array_position(F.array(*[F.lit(b[0]) for b in fixed.BRANCHES]), F.col("branch"))
    link = F.coalesce(
        text.blank_to_null(F.col("item.link")), text.blank_to_null(F.col("item.guid")), F.lit(fixed.FEED_DEFAULT_LINK)
    )
    slug = F.regexp_replace(F.element_at(F.split("link", "/"), -1), "[^a-zA-Z0-9]", "")
    by_title = F.regexp_replace(F.base64(F.encode("title", "UTF-8")), r"\s", "")
    items = (
        feeds.select("branch", "page_no", "fetched_at", F.from_xml("body", FEED_SCHEMA).alias("feed"))
        .select(
            "branch", "page_no", F.col("fetched_at").alias("ingested_at"), branch_order.alias("branch_no"),
            F.posexplode("feed.channel.item").alias("pos", "item"),
        )
        .withColumn(
            "published", F.coalesce(text.blank_to_null(F.col("item.pubDate")), text.blank_to_null(F.col("item.`dc:date`")))
        )
        .filter(F.col("published").isNotNull())
        .withColumn("link", link)
    )
    items = text.compute_once(items, title=text.decode_entities(F.coalesce(F.col("item.title"), F.lit(""))))
    items = items.withColumn("event_id", F.coalesce(text.blank_to_null(slug), by_title))
    items = items.withColumn("landed", _landed("ingested_at"))
    firsts = first_by(items, ["event_id"], ["branch_no", "page_no", "landed", "pos"])
    return text.compute_once(firsts, start_datetime=wallclock.parse_wall_time(F.col("published"))).filter(
        F.col("start_datetime").isNotNull()
    )


def branch_listings(feeds: DataFrame, detail_pages: DataFrame) -> DataFrame:
    """Feed items joined with their landed detail pages (url, body[, fetched_at]) for the age group.

    Of several landings of a detail page the latest counts. Items without a link of their own have no
    detail page.
    """
    spark = feeds.sparkSession
    branches = spark.createDataFrame(
        [(n, a, lat, lng) for n, _, a, lat, lng in fixed.BRANCHES],
        "branch STRING, location_address STRING, location_lat DOUBLE, location_lng DOUBLE",
    )
    found = ages.audience_link_range(F.col("body"))
    pages = newest(detail_pages, "url", "fetched_at", "body")
    details = pages.select("url", found.alias("age")).select("url", "age.*")
    own_link = F.nullif(F.col("link"), F.lit(fixed.FEED_DEFAULT_LINK))
    rows = (
        extract_feed_items(feeds)
        .join(F.broadcast(branches), "branch", "left")
        .join(details, own_link == F.col("url"), "left")
        .select(
            F.concat(F.lit("plano-library-"), F.col("event_id")).alias("id"),
            F.lit("plano-library").alias("source"),
            "title",
            text.clean_feed_description(F.col("item.description")).alias("description"),
            "start_datetime",
            F.col("branch").alias("location_name"),
            "location_address", "location_lat", "location_lng",
            F.lit(True).alias("is_free"), F.lit("Free").alias("price_text"),
            "age_min", "age_max", "age_label",
            F.when(F.col("is_family"), F.array(F.lit("family"))).alias("age_buckets"),
            F.lit(False).alias("is_recurring"),
            F.col("item.enclosure._url").alias("thumbnail_url"),
            F.col("link").alias("event_url"),
            F.col("item.description").alias("raw_description"),
            F.to_json("item").alias("raw_json"),
            "ingested_at",
            _sequence("branch_no", "page_no", "landed", "pos").alias("seq"),
        )
    )
    # the labels look at the feed's own text, before the clean-up
    title, raw = F.col("title"), F.col("raw_description")
    return (
        rows.withColumn("category", labels.guess_category(title, raw))
        .withColumn("registration_required", labels.needs_registration(title, raw))
        .drop("raw_description")
    )


# ---- calendar detail pages --------------------------------------------------------------


def calendar_ids(pages: DataFrame, pattern: str = CALENDAR_ID) -> DataFrame:
    """Distinct detail ids linked from calendar pages."""
    return pages.select(F.explode(F.regexp_extract_all("body", F.lit(pattern), F.lit(1))).alias("eid")).distinct()


def horizon_end(now, months: int = fixed.HORIZON_MONTHS) -> dt.datetime:
    """now plus calendar months; a day past the month's end runs on into the next."""
    now = wallclock.as_utc(now)
    index = now.year * 12 + now.month - 1 + months
    return now.replace(year=index // 12, month=index % 12 + 1, day=1) + dt.timedelta(days=now.day - 1)


def _description(body: Column) -> Column:
    """Paragraphs from the mark to the end of its element, within the elements that it holds too."""
    rest = F.substring(body, F.instr(body, DESCRIPTION_MARK), F.length(body))
    block = text.element_body(rest, "div")
    paragraphs = F.transform(
        F.regexp_extract_all(block, F.lit(PARAGRAPH), F.lit(1)), lambda p: text.decode_entities(text.strip_tags(p))
    )
    kept = F.filter(paragraphs, lambda p: (F.length(p) > 10) & ~F.startswith(p, F.lit("http")))
    return F.when(F.instr(body, DESCRIPTION_MARK) > 0, F.array_join(kept, "\n\n")).otherwise("")


def calendar_listings(pages: DataFrame, now, base_url: str = "https://www.friscotexas.gov") -> DataFrame:
    """Landed detail pages (eid, fetched_at, body) to listings with a first price class."""
    body = F.col("body")
    title = F.regexp_replace(text.decode_entities(F.regexp_extract(body, PAGE_TITLE, 1)), TITLE_PREFIX, "")
    titled = text.compute_once(pages, title=text.trim(F.split(title, r"\s*\|\s*", 2)[0])).filter(
        (F.col("title") != "") & ~labels.is_admin_item(F.col("title"))
    )
    dated = text.compute_once(titled, start_wall=text.trim(_found(body, START_ITEM)))
    dated = text.compute_once(dated, start_datetime=wallclock.parse_wall_time(F.col("start_wall"))).filter(
        F.col("start_datetime") <= wallclock.instant(horizon_end(now))
    )
    time_text = text.strip_tags(
        F.replace(F.replace(_detail(body, TIME_HEADER), F.lit("&thinsp;"), F.lit(" ")), F.lit("&nbsp;"), F.lit(" "))
    )
    clock = lambda group: F.regexp_extract("time_text", END_CLOCK, group)
    hour = clock(1).try_cast("int")
    is_pm = F.upper(clock(3)) == "PM"
    hour24 = F.when(is_pm & (hour != 12), hour + 12).when(~is_pm & (hour == 12), 0).otherwise(hour)
    end_wall = F.concat(
        F.substring("start_wall", 1, 10), F.lit(" "), F.lpad(hour24.cast("string"), 2, "0"), F.lit(":"),
        clock(2), F.lit(":00"),
    )
    place = F.regexp_replace(_detail(body, LOCATION_HEADER), r"(?is)<a[^>]*>.*?</a>", "")
    location = F.coalesce(
        text.blank_to_null(text.decode_entities(text.strip_tags(place))),
        text.blank_to_null(text.decode_entities(text.strip_tags(F.regexp_extract(body, LOCATION_ITEM, 1)))),
        F.lit(fixed.CALENDAR_DEFAULT_LOCATION),
    )
    image = _found(body, IMAGE_META)
    dated = text.compute_once(
        dated, time_text=time_text, description=_description(body), location_name=location,
        raw_cost=text.decode_entities(text.strip_tags(_found(body, PRICE_ITEM))), image=image,
    )
    parsed = dated.select(
        F.concat(F.lit("play-frisco-"), F.col("eid")).alias("id"),
        F.lit("play-frisco").alias("source"),
        "title",
        "description",
        "start_datetime",
        F.coalesce(
            wallclock.parse_wall_time(_found(body, END_ITEM)), wallclock.parse_wall_time(end_wall)
        ).alias("end_datetime"),
        "location_name",
        "raw_cost",
        F.when(F.col("image").rlike(REAL_IMAGE), F.col("image")).alias("thumbnail_url"),
        F.concat(F.lit(f"{base_url}/Calendar.aspx?EID="), F.col("eid"), F.lit("&view=detail")).alias("event_url"),
        F.col("fetched_at").alias("ingested_at"),
        F.struct(F.col("eid").cast("bigint").alias("eid"), _landed().alias("landed")).alias("seq"),
        "eid",
        "start_wall",
    )
    point = labels.venue_coordinates(F.col("location_name"))
    priced = with_cost_price(with_text_labels(parsed))
    return (
        priced.withColumn("description", text.blank_to_null(F.col("description")))
        .withColumn("location_lat", point["lat"])
        .withColumn("location_lng", point["lng"])
        .withColumn("is_recurring", F.lit(False))
        .withColumn("raw_json", F.to_json(F.struct(
            "eid", "title", F.col("start_wall").alias("start"), F.col("location_name").alias("location")
        )))
        .drop("eid", "start_wall")
    )


def with_cost_price(rows: DataFrame) -> DataFrame:
    """Price from the cost field where it states one (`price_locked`), else from the text."""
    stated = prices.cost_field_class(F.col("raw_cost"))
    fallback = prices.fallback_price(F.col("title"), F.col("description"), F.col("registration_required"))
    locked = F.col("price_locked")
    return (
        text.compute_once(rows, stated=stated, fallback=fallback)
        .withColumn("price_locked", F.col("stated").isNotNull())
        .withColumn("price_class", F.coalesce(F.col("stated"), F.col("fallback.price_class")))
        .withColumn("price_confidence", F.when(locked, "confirmed").otherwise(F.col("fallback.price_confidence")))
        .withColumn("price_reasoning", F.when(locked, F.concat(F.lit('Cost field: "'), F.col("raw_cost"), F.lit('"'))))
        .withColumn("is_free", prices.is_free_of(F.col("price_class")))
        .withColumn("price_text", prices.price_text_of(F.col("price_class")))
        .drop("stated", "fallback", "raw_cost")
    )


# ---- paged payloads ---------------------------------------------------------------------


def park_listings(pages: DataFrame) -> DataFrame:
    """Landed payload pages (page_no, fetched_at, body) to listings.

    Every landed page counts, whatever it says of the number of pages; of several landings of a page
    the latest comes first. Fields are read as variants, because the source writes `false` or `[]` where a nested
    object is missing. The local wall time counts, never the payload's own UTC field.
    """
    event = lambda path, kind="string": F.try_variant_get(F.col("event"), f"$.{path}", kind)
    given = lambda path: text.blank_to_null(event(path))
    docs = pages.select("page_no", "fetched_at", F.try_parse_json("body").alias("doc"))
    events = docs.select(
        "page_no", "fetched_at", _landed().alias("landed"),
        F.posexplode(F.try_variant_get("doc", "$.events", "array<variant>")).alias("pos", "event"),
    )
    events = text.compute_once(
        events,
        start_datetime=wallclock.iso_wall_time(event("start_date")),
        title=text.decode_entities(F.coalesce(event("title"), F.lit(""))),
    ).filter(F.col("start_datetime").isNotNull() & (F.col("title") != ""))
    number = lambda path, default: F.coalesce(F.nullif(event(path, "double"), F.lit(0.0)), F.lit(default))
    cost = F.when(F.schema_of_variant(event("cost", "variant")) == "STRING", text.trim(event("cost")))
    parsed = events.select(
        F.concat(F.lit("kaleidoscope-park-"), event("id")).alias("id"),
        F.lit("kaleidoscope-park").alias("source"),
        "title",
        text.decode_entities(text.strip_tags(given("description"), " ")).alias("description"),
        "start_datetime",
        wallclock.iso_wall_time(event("end_date")).alias("end_datetime"),
        F.coalesce(text.decode_entities(given("venue.venue")), F.lit(fixed.PARK_VENUE)).alias("location_name"),
        F.coalesce(text.decode_entities(given("venue.address")), F.lit(fixed.PARK_ADDRESS)).alias("location_address"),
        number("venue.geo_lat", fixed.PARK_COORDS[0]).alias("location_lat"),
        number("venue.geo_lng", fixed.PARK_COORDS[1]).alias("location_lng"),
        F.coalesce(cost, F.lit("")).alias("raw_cost"),
        text.encode_uri(text.decode_entities(given("image.url"))).alias("thumbnail_url"),
        F.coalesce(given("url"), F.lit(fixed.PARK_URL)).alias("event_url"),
        F.lit(False).alias("is_recurring"),
        F.to_json(F.struct(event("id").alias("id"), event("venue.venue").alias("venue"))).alias("raw_json"),
        F.col("fetched_at").alias("ingested_at"),
        _sequence("page_no", "landed", "pos").alias("seq"),
    )
    return with_cost_price(with_text_labels(parsed))


__all__ = [
    "extract_cards", "resolve_audiences", "library_listings", "audience_fallback", "fallback_verdict",
    "extract_feed_items", "branch_listings", "calendar_ids", "calendar_listings", "horizon_end",
    "park_listings", "with_cost_price", "with_text_labels", "as_listings",
]
