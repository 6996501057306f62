"""Feed exports: sitemap, structured data, calendar entries, item lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from townbill import fixed
from townbill.functions import text
from townbill.functions.ages import typical_age_range
from townbill.functions.wallclock import utc_text
from townbill.operators.catalog import for_city, indexable, upcoming, with_source_dim

DEFAULT_SITE = "https://listings.example.org"

# ---- fixed values: sitemap priorities ----
HOME_PRIORITY, CITY_PRIORITY, ITEM_PRIORITY = 1.0, 0.9, 0.7


def sitemap(indexed: DataFrame, site: str = DEFAULT_SITE, cities=tuple(fixed.CITY_SOURCES)) -> DataFrame:
    """Fixed routes and one row per indexable listing."""
    routes = [(site, "daily", HOME_PRIORITY)] + [(f"{site}/{c}", "daily", CITY_PRIORITY) for c in cities]
    static = indexed.sparkSession.createDataFrame(routes, "url STRING, change_frequency STRING, priority DOUBLE")
    items = indexed.select(
        text.item_url(site, F.col("id")).alias("url"),
        F.coalesce("ingested_at", "created_at").alias("last_modified"),
        F.lit("weekly").alias("change_frequency"),
        F.lit(ITEM_PRIORITY).alias("priority"),
    )
    return static.withColumn("last_modified", F.lit(None).cast("timestamp")).select(*items.columns).unionByName(items)


def iso_instant(ts: Column) -> Column:
    return utc_text(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def structured_feed(listings: DataFrame, site: str = DEFAULT_SITE) -> DataFrame:
    """(id, json): one schema.org event document per listing, absent values left out."""
    url = text.item_url(site, F.col("id"))
    kind = lambda name: F.lit(name).alias("@type")
    present = lambda c: text.blank_to_null(F.col(c))
    description = text.blank_to_null(text.plain_text(F.col("description")))
    geo = F.when(
        F.col("location_lat").isNotNull() & F.col("location_lng").isNotNull(),
        F.struct(kind("GeoCoordinates"), F.col("location_lat").alias("latitude"), F.col("location_lng").alias("longitude")),
    )
    place = F.when(
        present("location_name").isNotNull(),
        F.struct(
            kind("Place"), F.col("location_name").alias("name"),
            F.coalesce("location_address", "location_name").alias("address"), geo.alias("geo"),
        ),
    )
    offer = F.when(
        F.col("is_free"),
        F.struct(
            kind("Offer"), F.lit("0").alias("price"), F.lit("USD").alias("priceCurrency"),
            F.lit("https://schema.org/InStock").alias("availability"), url.alias("url"),
        ),
    )
    document = F.struct(
        F.lit("https://schema.org").alias("@context"),
        kind("Event"),
        F.col("title").alias("name"),
        iso_instant(F.col("start_datetime")).alias("startDate"),
        F.lit("https://schema.org/OfflineEventAttendanceMode").alias("eventAttendanceMode"),
        F.lit("https://schema.org/EventScheduled").alias("eventStatus"),
        url.alias("url"),
        F.struct(kind("Organization"), F.col("org_name").alias("name"), F.col("org_url").alias("url")).alias("organizer"),
        iso_instant(F.col("end_datetime")).alias("endDate"),
        description.alias("description"),
        F.when(present("thumbnail_url").isNotNull(), F.array("thumbnail_url")).alias("image"),
        place.alias("location"),
        F.col("is_free").alias("isAccessibleForFree"),
        offer.alias("offers"),
        typical_age_range(F.col("age_min"), F.col("age_max"), F.col("age_buckets")).alias("typicalAgeRange"),
    )
    return with_source_dim(listings).select("id", F.to_json(document).alias("json"))


def calendar_stamp(ts: Column) -> Column:
    return utc_text(ts, "yyyyMMdd'T'HHmmss'Z'")


def escape_calendar_text(c: Column) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    c = F.replace(F.replace(c, F.lit(";"), F.lit("\\;")), F.lit(","), F.lit("\\,"))
    return F.regexp_replace(c, "\r?\n", r"\\n")


def calendar_feed(
    listings: DataFrame, stamp: Column, product: str = "-//Town listings//EN", uid_domain: str = "listings.example.org"
) -> DataFrame:
    """(id, filename, ics): one calendar document per listing."""
    line = lambda key, value: F.concat(F.lit(key), value)
    filled = lambda c: text.blank_to_null(F.col(c))
    location = text.blank_to_null(F.concat_ws(", ", filled("location_name"), filled("location_address")))
    details = text.blank_to_null(F.concat_ws("\n\nMore info: ", filled("description"), filled("event_url")))
    start = calendar_stamp(F.col("start_datetime"))
    lines = F.array(
        F.lit("BEGIN:VCALENDAR"), F.lit("VERSION:2.0"), F.lit(f"PRODID:{product}"), F.lit("CALSCALE:GREGORIAN"),
        F.lit("METHOD:PUBLISH"), F.lit("BEGIN:VEVENT"),
        F.concat(F.lit("UID:"), F.col("id"), F.lit(f"@{uid_domain}")),
        line("DTSTAMP:", calendar_stamp(stamp)),
        line("DTSTART:", start),
        line("DTEND:", F.coalesce(calendar_stamp(F.col("end_datetime")), start)),
        line("SUMMARY:", escape_calendar_text(F.col("title"))),
        line("DESCRIPTION:", escape_calendar_text(details)),
        line("LOCATION:", escape_calendar_text(location)),
        line("URL:", filled("event_url")),
        F.lit("END:VEVENT"), F.lit("END:VCALENDAR"),
    )
    ics = F.array_join(F.array_compact(lines), "\r\n")
    return listings.select("id", text.slug_filename(F.col("title")).alias("filename"), ics.alias("ics"))


def item_positions(rows: DataFrame, keys: list[str], n: int = 50) -> DataFrame:
    """The first n rows per key by start, with their 1-based position.

    The rank filter reaches below the shuffle as a per-task top-n, so a key's rows do not all travel.
    """
    order = Window.partitionBy(*keys).orderBy("start_datetime", "id")
    return rows.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= n)


def item_lists(
    listings: DataFrame, now, site: str = DEFAULT_SITE, n: int = 50, city_sources: dict = fixed.CITY_SOURCES
) -> DataFrame:
    """(city, json): per city a document of its first n items and the number of all of them."""
    rows = listings.filter(upcoming(now) & indexable(now))
    in_city = F.coalesce(*[F.when(F.col("source").isin(*s), c) for c, s in city_sources.items()])
    placed = rows.select("id", "title", "start_datetime", in_city.alias("city")).filter(F.col("city").isNotNull())
    totals = placed.groupBy("city").agg(F.count("*").alias("total"))
    element = F.struct(
        F.col("position"),
        F.struct(
            F.lit("ListItem").alias("@type"), "position", text.item_url(site, F.col("id")).alias("url"),
            F.col("title").alias("name"),
        ).alias("item"),
    )
    firsts = item_positions(placed, ["city"], n).groupBy("city").agg(F.collect_list(element).alias("elements"))
    label = F.coalesce(*[F.when(F.col("city") == c, F.lit(fixed.CITY_LABEL.get(c, c))) for c in city_sources])
    document = F.struct(
        F.lit("https://schema.org").alias("@context"),
        F.lit("ItemList").alias("@type"),
        F.concat(F.lit("Free kids events in "), label, F.lit(", TX")).alias("name"),
        text.city_url(site, F.col("city")).alias("url"),
        F.col("total").alias("numberOfItems"),
        F.transform(F.sort_array("elements"), lambda e: e["item"]).alias("itemListElement"),
    )
    return totals.join(firsts, "city").select("city", F.to_json(document).alias("json"))


def city_items(listings: DataFrame, city: str, now) -> DataFrame:
    return for_city(listings, city).filter(upcoming(now) & indexable(now))


def write_text_feed(feed: DataFrame, path: str, column: str) -> None:
    """One document per line; calendar documents keep their own line ends in parquet instead."""
    if column == "json":
        feed.select(F.col(column).alias("value")).write.mode("overwrite").text(path)
    else:
        feed.write.mode("overwrite").parquet(path)


def write_sitemap(rows: DataFrame, path: str, fmt: str = "xml") -> None:
    writer = rows.write.mode("overwrite")
    if fmt == "xml":
        writer.format("xml").option("rowTag", "url").option("rootTag", "urlset").save(path)
    else:
        writer.option("header", True).csv(path)
