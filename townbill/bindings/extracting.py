"""Extraction queries: landed pages built by Spark from whole tables, parsed back to listings."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from townbill.bindings.enriching import AUDIENCES, audience_taxonomy
from townbill.bindings.registry import query, table
from townbill.bindings.views import pick, sql_stamp, stamp
from townbill.operators import guard, publish
from townbill.plans.ingest import prepare
from townbill.session import materialise
from townbill.sources import landings
from townbill.sources.tables import as_batch, as_listings

TWO_PASS = "g + (g - ((g AT TIME ZONE 'UTC') AT TIME ZONE 'America/Chicago'))"


def cat(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def text_of(c) -> Column:
    return c.cast("string")


def pages_of(rows, size: int, glue: str):
    """Rows (k, part) glued into pages of `size` consecutive keys."""
    return (
        rows.groupBy(F.floor(F.col("k") / size).cast("int").alias("page_no"))
        .agg(F.min("fetched_at").alias("fetched_at"), F.sort_array(F.collect_list(F.struct("k", "part"))).alias("parts"))
        .select("page_no", "fetched_at", F.array_join(F.transform("parts", lambda p: p["part"]), glue).alias("body"))
    )


# ---- listing cards ----------------------------------------------------------------------

MARK = '<li><div class="cp-events-search-item">'
LIBRARY = "https://friscolibrary.bibliocommons.com/events/"


def card_pages(spark, sf):
    """Twenty cards a page; neighbouring orders share an id, some cards lack a title or a date."""
    k = F.col("o_orderkey")
    day = F.col("o_orderdate").cast("timestamp")
    card = cat(
        MARK, '<a href="', LIBRARY, "e", text_of(k - k % 2), '" ',
        F.when(k % 14 == 0, "no title").otherwise(cat('data-key="event-link"><b>Story &amp; Play ', text_of(k), "</b></a>")),
        F.when(k % 22 == 0, "").otherwise(cat('<i class="date-stamp__month" x>', F.date_format(day, "MMM"), "</i>")),
        '<i class="date-stamp__day">', F.date_format(day, "d"), "</i> on ", F.date_format(day, "MMMM d, yyyy"),
        ' <i class="event-time">', F.when(k % 3 == 0, "10:30am–11:30am").otherwise("2:00pm – 3:00pm"), "</i>",
        F.when(k % 4 == 0, '<i class="cp-event-location x">Frisco Square, hall</i>').otherwise(""),
        '<p class="cp-event-description x">Some <u>music</u></p>',
        F.when(k % 6 == 0, cat('<img src="', LIBRARY, 'uploads/images/Arts &amp; Culture.jpg">')).otherwise(""),
        F.when(k % 10 == 0, "View all dates").otherwise(""),
    )
    rows = table(spark, sf, "orders").select(k.alias("k"), day.alias("fetched_at"), card.alias("part"))
    return pages_of(rows, 20, "").withColumn("body", cat("<ul>", F.col("body"), "</ul>"))


CARDS = f"""
cards AS (
  SELECT o_orderkey AS k, 'e' || o_orderkey AS event_id, 'Story & Play ' || o_orderkey AS title,
         o_orderdate + CASE WHEN o_orderkey % 3 = 0 THEN INTERVAL 630 MINUTE ELSE INTERVAL 840 MINUTE END AS g
  FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 14 <> 0 AND o_orderkey % 22 <> 0)
"""


@query(
    f"""WITH {CARDS} SELECT event_id, title, {sql_stamp(TWO_PASS)} AS start_text,
      CASE WHEN k % 4 = 0 THEN 'Frisco Square, hall' ELSE 'Frisco Public Library' END AS location_name, 'Some music' AS teaser, k % 10 = 0 AS is_recurring,
      CASE WHEN k % 6 = 0 THEN 'https://friscolibrary.bibliocommons.com/events/uploads/images/Arts%20&%20Culture.jpg' END AS thumbnail_url FROM cards"""
)
def listing_cards(spark, sf):
    rows = landings.extract_cards(card_pages(spark, sf))
    return rows.select(
        "event_id", "title", stamp("start_datetime").alias("start_text"), "location_name",
        "teaser", "is_recurring", "thumbnail_url",
    )


def card_details(spark, sf):
    """Detail documents, a third for ids no card has, some without known audiences or description."""
    k = F.col("o_orderkey")
    audience = lambda n: cat('"a', text_of(n), '"')
    body = cat(
        '{"event":{"definition":{"audience_ids":[', audience(k % 30), F.when(k % 5 == 0, cat(",", audience(k % 7))).otherwise(""),
        '],"description":', F.when(k % 4 == 0, '"  "').otherwise(cat('"<p>Register for <b>art &amp; craft</b></p> no ', text_of(k), '"')),
        ',"featured_image_id":"i', text_of(k), '"}}}',
    )
    prefix = F.when((k % 2 == 0) & (k % 3 != 1), "e").otherwise("x")
    rows = table(spark, sf, "orders").select(cat(prefix, text_of(k)).alias("event_id"), body.alias("body"), F.lit(2).alias("fetched_at"))
    # an earlier landing with nothing in it
    return rows.unionByName(rows.select("event_id", F.lit('{"event":{}}').alias("body"), F.lit(1).alias("fetched_at")))


def library(spark, sf):
    return landings.library_listings(card_pages(spark, sf), card_details(spark, sf), audience_taxonomy(spark, sf))


NAMES = "[" + ", ".join(f"'{a}'" for a in AUDIENCES) + "]"
LIBRARY_ROWS = f"""
{CARDS},
ids AS (SELECT event_id, UNNEST(CASE WHEN k % 5 = 0 THEN [k % 30, k % 7] ELSE [k % 30] END) AS a FROM cards WHERE k % 3 <> 1),
named AS (SELECT event_id, CASE WHEN a < 25 THEN {NAMES}[a % 12 + 1] END AS label, lower(label) AS n FROM ids),
f AS (SELECT event_id, COUNT(*) AS ids, COUNT(n) AS known, MIN(label) AS label,
      BOOL_OR(regexp_matches(n, 'adult|senior')) AS adult, BOOL_OR(regexp_matches(n, 'all ages|famil')) AS everyone,
      BOOL_OR(regexp_matches(n, 'children \\(0|0-5|preschool|toddler|baby|babies')) AS young,
      BOOL_OR(regexp_matches(n, 'children \\(6|6-12') OR (contains(n, 'kids') AND NOT contains(n, 'all'))) AS middle,
      BOOL_OR(contains(n, 'tween')) AS tween, BOOL_OR(contains(n, 'teen')) AS teen FROM named GROUP BY event_id),
r AS (SELECT *, list_min(list_filter([CASE WHEN young OR everyone THEN 0 END, CASE WHEN middle THEN 6 END, CASE WHEN tween THEN 10 END, CASE WHEN teen THEN 13 END], lambda x: x IS NOT NULL)) AS low,
      list_max(list_filter([CASE WHEN young THEN 5 END, CASE WHEN middle THEN 12 END, CASE WHEN tween THEN 13 END, CASE WHEN teen OR everyone THEN 17 END], lambda x: x IS NOT NULL)) AS high
    FROM f WHERE known > 0),
aged AS (SELECT event_id,
    CASE WHEN adult THEN CASE WHEN young OR middle OR tween OR everyone THEN 0 WHEN teen THEN 13 ELSE 18 END ELSE low END AS lo,
    CASE WHEN adult THEN CASE WHEN young OR middle OR tween OR everyone THEN 17 WHEN teen THEN 17 ELSE 99 END ELSE high END AS hi,
    CASE WHEN NOT adult AND ids = 1 AND low IS NOT NULL THEN label END AS label FROM r),
library AS (
  SELECT c.*, lo IS NOT NULL AS age_resolved, COALESCE(lo, 0) AS age_min, CASE WHEN lo IS NULL THEN 17 ELSE hi END AS age_max, label AS age_label,
         CASE WHEN k % 3 <> 1 AND k % 4 <> 0 THEN 'Register for art & craft no ' || k ELSE 'Some music' END AS description
  FROM cards c LEFT JOIN aged USING (event_id))
"""


@query(
    f"""WITH {LIBRARY_ROWS} SELECT 'frisco-library-' || event_id AS id, title, description, CAST(age_min AS INT) AS age_min, CAST(age_max AS INT) AS age_max,
      age_label, age_resolved, contains(lower(description), 'register') AS registration_required,
      'library' AS category,
      CASE WHEN k % 4 = 0 THEN 33.1429 ELSE 33.1429 END::DOUBLE AS location_lat FROM library"""
)
def library_listings(spark, sf):
    return library(spark, sf).select(
        "id", "title", "description", "age_min", "age_max", "age_label", "age_resolved", "registration_required", "category", "location_lat"
    )


@query(
    f"""WITH {LIBRARY_ROWS}, c AS (SELECT COUNT(*) AS total, COUNT(*) FILTER (NOT age_resolved) AS fallback FROM library)
    SELECT *, CAST(fallback AS DOUBLE) / total AS share, total >= 20 AND CAST(fallback AS DOUBLE) / total > 0.5 AS warn FROM c"""
)
def audience_fallback(spark, sf):
    return landings.audience_fallback(library(spark, sf))


# ---- feeds ------------------------------------------------------------------------------

BRANCH_NAMES = ("Davis Library", "Haggard Library", "Harrington Library", "Parr Library", "Schimelpfenig Library", "Virtual")
AGE_BLOCKS = ('AGE GROUP <a href="/events?a=Kids">', 'AGE GROUP <a href="/events?a=Families+%28All+Ages%29">', "none")


def feed_pages(spark, sf):
    """Twenty items a page, every page once per two branches, so that the earlier branch wins."""
    k = F.col("o_orderkey")
    day = F.col("o_orderdate").cast("timestamp")
    item = cat(
        "<item><title>Robot &amp;amp; maker lab ", text_of(k), "</title>",
        F.when(k % 9 == 0, cat("<guid>https://plano.example.org/event/", text_of(k), "?x=1</guid>"))
        .otherwise(cat("<link>https://plano.example.org/event/", text_of(k), "</link>")),
        F.when(k % 8 == 0, "").when(k % 8 == 1, cat("<dc:date>", F.date_format(day, "yyyy-MM-dd"), " 09:30:00</dc:date>"))
        .otherwise(cat("<pubDate>", F.date_format(day, "EEE, dd MMM yyyy"), " 09:30:00 +0000</pubDate>")),
        "<description>&lt;p&gt;Monday, August 14 2026 9:30am - 10:15am Swim ", text_of(k), "&lt;/p&gt; Read on</description>",
        F.when(k % 4 == 0, cat('<enclosure url="https://img.example.org/', text_of(k), '.png"/>')).otherwise(""),
        "</item>",
    )
    rows = table(spark, sf, "orders").select(k.alias("k"), day.alias("fetched_at"), item.alias("part"))
    xml = cat('<rss xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>feed</title>', F.col("body"), "</channel></rss>")
    pages = pages_of(rows, 20, "").withColumn("body", xml)
    n = F.col("page_no") % 6
    both = F.array(pick(n, BRANCH_NAMES), pick((n + 2) % 6, BRANCH_NAMES))
    return pages.select("page_no", "fetched_at", "body", F.explode(both).alias("branch"))


def feed_details(spark, sf):
    k = F.col("o_orderkey")
    path = F.when(k % 5 == 0, "other").otherwise("event")
    return table(spark, sf, "orders").select(
        cat("https://plano.example.org/", path, "/", text_of(k)).alias("url"), pick(k % 3, AGE_BLOCKS).alias("body"),
        F.explode(F.array(F.lit(2), F.lit(1))).alias("fetched_at"),
    ).withColumn("body", F.when(F.col("fetched_at") == 2, F.col("body")).otherwise("AGE GROUP"))


FEED_ROWS = f"""
feed AS (
  SELECT o_orderkey AS k, o_orderdate + INTERVAL 570 MINUTE AS g, least((o_orderkey // 20) % 6, ((o_orderkey // 20) % 6 + 2) % 6) AS b
  FROM orders WHERE o_orderkey % 8 <> 0)
"""


@query(
    f"""WITH {FEED_ROWS} SELECT 'plano-library-' || k || CASE WHEN k % 9 = 0 THEN 'x1' ELSE '' END AS id, 'Robot & maker lab ' || k AS title, 'Swim ' || k AS description,
      {sql_stamp(TWO_PASS)} AS start_text, ['Davis Library', 'Haggard Library', 'Harrington Library', 'Parr Library', 'Schimelpfenig Library', 'Virtual'][b + 1] AS location_name,
      CAST(CASE WHEN k % 5 > 0 AND k % 9 > 0 THEN [6, 0, NULL][k % 3 + 1] END AS INT) AS age_min, CAST(CASE WHEN k % 5 > 0 AND k % 9 > 0 THEN [12, 17, NULL][k % 3 + 1] END AS INT) AS age_max,
      CASE WHEN k % 5 > 0 AND k % 9 > 0 AND k % 3 = 1 THEN ['family'] END AS age_buckets,
      CASE WHEN k % 4 = 0 THEN 'https://img.example.org/' || k || '.png' END AS thumbnail_url, 'library' AS category FROM feed"""
)
def branch_listings(spark, sf):
    rows = landings.branch_listings(feed_pages(spark, sf), feed_details(spark, sf))
    return rows.select(
        "id", "title", "description", stamp("start_datetime").alias("start_text"), "location_name", "age_min", "age_max",
        "age_buckets", "thumbnail_url", "category",
    )


# ---- calendar detail pages --------------------------------------------------------------

CALENDAR_NOW = "1997-12-31T10:00:00Z"


def calendar_pages(spark, sf):
    """One detail page per order."""
    k = F.col("o_orderkey")
    day = F.col("o_orderdate").cast("timestamp")
    title = F.when(k % 15 == 0, "City Council").when(k % 16 == 0, "").otherwise(cat("Painting &amp; drawing ", text_of(k)))
    body = cat(
        "<html><title>Calendar • ", title, " | City</title>",
        F.when(k % 10 == 3, "").otherwise(
            cat('<div itemprop="startDate" class="h">', F.date_format(day, "yyyy-MM-dd"), "T18:30:00</div>")
        ),
        F.when(k % 4 == 0, cat('<div itemprop="endDate">', F.date_format(day, "yyyy-MM-dd"), "T20:00:00</div>"))
        .when(k % 4 == 1, '<div class="specificDetailHeader">Time:</div><div class="specificDetailItem">6:30 PM&thinsp;-&thinsp;9:15&nbsp;PM</div>')
        .otherwise(""),
        F.when(k % 3 == 0, '<div class="specificDetailHeader">Location:</div><div class="specificDetailItem">Toyota Stadium <a href="#">map</a></div>')
        .when(k % 3 == 1, '<span itemprop="location"><b itemprop="name">Hall &amp; Park</b></span>').otherwise(""),
        '<div itemprop="description" class="fr-view">', F.when(k % 7 == 0, '<div class="a"><DIV>').otherwise(""),
        '<p>short</p><p class="x">Come and <b>dance</b> with us ', text_of(k), "</p>",
        F.when(k % 7 == 0, "</div><divider></div ><div>No paragraph at all</div>").otherwise(""),
        "<p>http://example.org/long/link</p><p>All supplies &ndash; included.</p></div><p>Not in the element</p>",
        F.when(k % 6 == 0, '<div itemprop="price">Free</div>').when(k % 6 == 1, '<div itemprop="price"><b>$35</b></div>').otherwise(""),
        F.when(k % 2 == 0, '<meta name="a" property="og:image" content="https://img.example.org/ImageRepository/Document?id=1">').otherwise(
            '<meta name="a" property="og:image" content="https://img.example.org/icon.png">'
        ),
        "</html>",
    )
    return table(spark, sf, "orders").select(text_of(k).alias("eid"), day.alias("fetched_at"), body.alias("body"))


@query(
    f"""WITH c AS (SELECT o_orderkey AS k, o_orderdate + INTERVAL 1110 MINUTE AS g FROM orders),
    s AS (SELECT k, {TWO_PASS} AS st, g FROM c WHERE k % 15 <> 0 AND k % 16 <> 0 AND k % 10 <> 3),
    e AS (SELECT k, st, date_trunc('day', s.g) + CASE k % 4 WHEN 0 THEN INTERVAL 1200 MINUTE WHEN 1 THEN INTERVAL 1275 MINUTE END AS g FROM s)
    SELECT 'play-frisco-' || k AS id, 'Painting & drawing ' || k AS title,
      'Come and dance with us ' || k || chr(10) || chr(10) || 'All supplies – included.' AS description,
      {sql_stamp('st')} AS start_text, {sql_stamp(TWO_PASS)} AS end_text,
      CASE k % 3 WHEN 0 THEN 'Toyota Stadium' WHEN 1 THEN 'Hall & Park' ELSE 'Frisco Parks & Recreation' END AS location_name,
      CASE k % 6 WHEN 0 THEN 'free' WHEN 1 THEN 'paid' ELSE 'free' END AS price_class,
      CASE WHEN k % 6 < 2 THEN 'confirmed' ELSE 'inferred' END AS price_confidence, k % 6 < 2 AS price_locked, 'arts' AS category,
      CASE WHEN k % 2 = 0 THEN 'https://img.example.org/ImageRepository/Document?id=1' END AS thumbnail_url
    FROM e WHERE st <= TIMESTAMP '1998-07-01 10:00:00'"""
)
def calendar_listings(spark, sf):
    rows = landings.calendar_listings(calendar_pages(spark, sf), CALENDAR_NOW)
    return rows.select(
        "id", "title", "description", stamp("start_datetime").alias("start_text"), stamp("end_datetime").alias("end_text"),
        "location_name", "price_class", "price_confidence", "price_locked", "category", "thumbnail_url",
    )


@query("SELECT CAST(o_orderkey AS VARCHAR) AS eid FROM orders")
def calendar_ids(spark, sf):
    k = F.col("o_orderkey")
    link = cat('<a href="Calendar.aspx?EID=', text_of(k), '">x</a><a href="?eid=', text_of(k), '">y</a>')
    rows = table(spark, sf, "orders").select(k.alias("k"), F.col("o_orderdate").alias("fetched_at"), link.alias("part"))
    return landings.calendar_ids(pages_of(rows, 30, ""))


# ---- paged payloads ---------------------------------------------------------------------


def payload_pages(spark, sf):
    """Fifty entries a page; missing images and venues come as `false` and `[]`."""
    k = F.col("o_orderkey")
    day = F.col("o_orderdate").cast("timestamp")
    entry = cat(
        '{"id":', text_of(k), ',"title":"', F.when(k % 17 == 0, "").otherwise(cat("Park &#8211; trail ", text_of(k))), '",',
        '"start_date":"', F.when(k % 19 == 0, "soon").otherwise(cat(F.date_format(day, "yyyy-MM-dd"), " 09:00:00")), '",',
        F.when(k % 3 == 0, cat('"end_date":"', F.date_format(day, "yyyy-MM-dd"), ' 11:00:00",')).otherwise('"end_date":null,'),
        '"description":', F.when(k % 4 == 0, "null").otherwise('"<p>Bring a <i>friend</i></p>"'), ",",
        '"image":', F.when(k % 2 == 0, "false").otherwise('{"url":"https://img.example.org/a b.png"}'), ",",
        '"venue":', F.when(k % 3 == 1, "[]").otherwise(cat('{"venue":"North &amp; Lawn","address":"1 Way","geo_lat":', text_of(33 + k % 5), ',"geo_lng":"-96.5"}')), ",",
        '"cost":', F.when(k % 5 == 0, '" Free "').when(k % 5 == 1, '"$12"').when(k % 5 == 2, "12").otherwise('""'), ",",
        '"url":', F.when(k % 6 == 0, '""').otherwise(cat('"https://park.example.org/', text_of(k), '"')), "}",
    )
    rows = table(spark, sf, "orders").select(k.alias("k"), day.alias("fetched_at"), entry.alias("part"))
    # pages that do not say how many there are count as well
    head = F.when(F.col("page_no") % 2 == 0, '{"total_pages":3,"events":[').otherwise('{"events":[')
    return pages_of(rows, 50, ",").withColumn("body", cat(head, F.col("body"), "]}"))


@query(
    f"""WITH s AS (SELECT k, {TWO_PASS} AS st, CASE WHEN k % 3 = 0 THEN g + INTERVAL 2 HOUR END AS g
      FROM (SELECT o_orderkey AS k, o_orderdate + INTERVAL 9 HOUR AS g FROM orders) WHERE k % 17 <> 0 AND k % 19 <> 0)
    SELECT 'kaleidoscope-park-' || k AS id, 'Park – trail ' || k AS title, CASE WHEN k % 4 <> 0 THEN 'Bring a friend' END AS description,
      {sql_stamp('st')} AS start_text, {sql_stamp(TWO_PASS)} AS end_text,
      CASE WHEN k % 3 = 1 THEN 'Kaleidoscope Park' ELSE 'North & Lawn' END AS location_name,
      CASE WHEN k % 3 = 1 THEN '6635 Warren Parkway, Frisco, TX' ELSE '1 Way' END AS location_address,
      CASE WHEN k % 3 = 1 THEN 33.0978 ELSE 33 + k % 5 END::DOUBLE AS location_lat, CASE WHEN k % 3 = 1 THEN -96.8230 ELSE -96.5 END::DOUBLE AS location_lng,
      CASE k % 5 WHEN 1 THEN 'paid' ELSE 'free' END AS price_class, k % 5 < 2 AS price_locked,
      CASE WHEN k % 2 = 1 THEN 'https://img.example.org/a%20b.png' END AS thumbnail_url,
      CASE WHEN k % 6 = 0 THEN 'https://kaleidoscopepark.org/events/' ELSE 'https://park.example.org/' || k END AS event_url FROM s"""
)
def park_listings(spark, sf):
    rows = landings.park_listings(payload_pages(spark, sf))
    return rows.select(
        "id", "title", "description", stamp("start_datetime").alias("start_text"), stamp("end_datetime").alias("end_text"),
        "location_name", "location_address", "location_lat", "location_lng", "price_class", "price_locked", "thumbnail_url", "event_url",
    )


# ---- a whole night ----------------------------------------------------------------------


@query(
    f"""WITH s AS (SELECT k, {TWO_PASS} AS st FROM (SELECT o_orderkey AS k, o_orderdate + INTERVAL 9 HOUR AS g FROM orders) WHERE k % 17 <> 0 AND k % 19 <> 0)
    SELECT 'kaleidoscope-park-' || k AS id, {sql_stamp('st')} AS start_text, 'Park – trail ' || k AS title, false AS is_recurring,
      CASE k % 5 WHEN 1 THEN 'paid' ELSE 'free' END AS price_class FROM s"""
)
def nightly_snapshot(spark, sf):
    """Payload pages to listings, merged, screened against the stored rows, upserted and purged.

    As in a run of a source, the parsed and the merged batch are staged: pages are parsed once, not once a use.
    """
    scraped = materialise(as_batch(landings.park_listings(payload_pages(spark, sf))))
    batch = materialise(prepare(scraped))
    k = F.regexp_extract("id", r"(\d+)$", 1).cast("bigint")
    # of the stored rows a third is under ids that are no longer published
    stored_id = F.when(k % 3 < 2, F.col("id")).otherwise(F.concat("id", F.lit("-gone")))
    stored = as_listings(
        scraped.withColumn("title", F.lit("stored")).withColumn("price_class", F.lit("unknown")).withColumn("id", stored_id)
    )
    write = as_listings(guard.write_set(batch, materialise(guard.guard_verdict(batch, stored))))
    snapshot = publish.next_snapshot(stored, write, scraped, purge=True)
    return snapshot.select("id", stamp("start_datetime").alias("start_text"), "title", "is_recurring", "price_class")
