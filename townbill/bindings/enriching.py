"""Text, price, age and clock queries over documents, pages and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from townbill.bindings.registry import query, table
from townbill.bindings.views import DOCUMENTS, LISTINGS, document_listings, order_listings, pick, sql_stamp, stamp
from townbill.functions import ages, labels, prices, text, wallclock
from townbill.operators import venues
from townbill.sources import landings

SPACES = r"[\s\x0B\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def sql_collapse(c: str) -> str:
    inner = f"regexp_replace({c}, '{SPACES}+', ' ', 'g')"
    return f"regexp_replace({inner}, '^{SPACES}+|{SPACES}+$', '', 'g')"


# ---- word lists over documents ----------------------------------------------------------


@query(
    f"""WITH {DOCUMENTS}, t AS (SELECT id, lower(title || ' ' || description) AS t FROM document_listings)
    SELECT id, CASE WHEN regexp_matches(t, 'story|read|book|librar') THEN 'library' WHEN regexp_matches(t, 'art|craft|paint|draw|creat') THEN 'arts'
      WHEN regexp_matches(t, 'stem|science|tech|robot|code|maker') THEN 'stem' WHEN regexp_matches(t, 'sport|soccer|basket|swim|run|athlet') THEN 'sports'
      WHEN regexp_matches(t, 'music|sing|danc|choir') THEN 'music' WHEN regexp_matches(t, 'park|nature|outdoor|garden|trail') THEN 'parks-rec'
      ELSE 'library' END AS category FROM t"""
)
def category_guess(spark, sf):
    return document_listings(spark, sf).select(
        "id", labels.guess_category(F.col("title"), F.col("description")).alias("category")
    )


@query(
    f"""WITH {DOCUMENTS}, t AS (SELECT id, lower(title) AS title, lower(title || ' ' || description) AS t FROM document_listings)
    SELECT id, regexp_matches(t, 'register|registration|sign up|sign-up|signup|reserve your spot|reserve a spot|limited space|limited seats|limited enrollment|space is limited|seats are limited|rsvp|enroll|enrollment|ticket|pre-register') AS registration,
      regexp_matches(title, 'city council|council meeting|commission meeting|board meeting|board of|work session|advisory board|advisory committee|planning commission|coffee with the mayor|coffee with mayor') AS admin,
      regexp_matches(t, 'ing|ation') AS any_word FROM t"""
)
def keyword_flags(spark, sf):
    return document_listings(spark, sf).select(
        "id",
        labels.needs_registration(F.col("title"), F.col("description")).alias("registration"),
        labels.is_admin_item(F.col("title")).alias("admin"),
        text.contains_any(text.joined(F.col("title"), F.col("description")), ["ing", "ation"]).alias("any_word"),
    )


@query(f"WITH {LISTINGS} SELECT id, title FROM order_listings WHERE NOT regexp_matches(lower(title), 'city council')")
def admin_prefilter(spark, sf):
    return order_listings(spark, sf).filter(~labels.is_admin_item(F.col("title"))).select("id", "title")


# words that the invented prose holds stand in for the price phrases
@query(
    f"""WITH {DOCUMENTS}, t AS (SELECT id, lower(title || chr(10) || description) AS t FROM document_listings)
    SELECT id, CASE WHEN regexp_matches(t, 'free') OR regexp_matches(t, '\\$[\\d,.]+|\\bthe and\\b') THEN 'paid'
      WHEN regexp_matches(t, 'sing') OR regexp_matches(t, '\\bfor the\\b') THEN 'free' WHEN regexp_matches(t, 'tech|run') THEN 'ambiguous' ELSE 'none' END AS signal
    FROM t"""
)
def price_signal(spark, sf):
    signal = prices.price_signal(
        text.joined(F.col("title"), F.col("description"), "\n"),
        ["free"], [("$", r"\$[\d,.]+"), ("the and", r"\bthe and\b")], ["sing"], [("for the", r"\bfor the\b")], ["tech", "run"],
    )
    return document_listings(spark, sf).select("id", signal.alias("signal"))


PAID = (
    "buy tickets|buy ticket|purchased ticket|purchase a ticket|purchase tickets|tickets on sale|ticket required|tickets required|no refund"
    r"|cost[:\s]+\$?\d[\d,.]*|\$[\d,.]+|\bfees?\b|\bregister for \$?\d|\bper (child|person|participant|family)\b|\bmaterials fee\b|\badmission[:\s]+\$?\d"
)
FREE = r"free admission|free to attend|free of charge|no cost to attend|admission is free|\bfree event\b|\bno cost\b"
AMBIGUOUS = "at the gate|members only|member only|reservation required|reservations required|donations welcome|suggested donation"
STRUCTURAL = r"\b(camp|class|clinic|workshop|lessons|league|academy|tournament|per child|per person|materials fee|deposit)\b"


# the price phrases themselves, planted into order texts
PRICE_TEXTS = (
    "Tickets are $12 a seat, members enter free", "Everyone gets FREE ADMISSION on Sunday", "a creative class for all",
    "drop in, feeling great", "Reservations required", "Fees apply", "no cost to attend", "Classic costume night",
    "register for 5 sessions", "éclass of its own",
)


def priced_orders(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("id"), F.col("o_orderpriority").alias("title"), pick(k % 10, PRICE_TEXTS).alias("description"),
        (k % 4 == 0).alias("registration_required"),
    )


def sql_texts(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


@query(
    f"""WITH p AS (SELECT o_orderkey AS id, o_orderpriority AS title, {sql_texts(PRICE_TEXTS)}[o_orderkey % 10 + 1] AS description, o_orderkey % 4 = 0 AS reg FROM orders),
    s AS (SELECT *, CASE WHEN regexp_matches(lower(title || chr(10) || description), '{PAID}') THEN 'paid'
      WHEN regexp_matches(lower(title || chr(10) || description), '{FREE}') THEN 'free'
      WHEN regexp_matches(lower(title || chr(10) || description), '{AMBIGUOUS}') THEN 'ambiguous' ELSE 'none' END AS signal FROM p)
    SELECT id, signal, CASE signal WHEN 'paid' THEN 'paid' WHEN 'free' THEN 'free' WHEN 'ambiguous' THEN 'unknown'
      ELSE CASE WHEN reg OR regexp_matches(lower(title || ' ' || description), '{STRUCTURAL}') THEN 'unknown' ELSE 'free' END END AS price_class,
      CASE WHEN signal IN ('paid', 'free') THEN 'confirmed' ELSE 'inferred' END AS price_confidence FROM s"""
)
def fallback_price(spark, sf):
    title, description = F.col("title"), F.col("description")
    return priced_orders(spark, sf).select(
        "id",
        prices.price_signal(text.joined(title, description, "\n")).alias("signal"),
        prices.fallback_price(title, description, F.col("registration_required")).alias("p"),
    ).select("id", "signal", "p.*")


@query(
    f"""WITH {DOCUMENTS} SELECT id, regexp_matches(lower(description), '{STRUCTURAL}') AS structural,
      regexp_matches(lower(description), '\\b(the|en|und)\\b') AS words FROM document_listings"""
)
def whole_words(spark, sf):
    from townbill import fixed

    return document_listings(spark, sf).select(
        "id",
        text.whole_word_any(F.col("description"), fixed.STRUCTURALLY_PAID).alias("structural"),
        text.whole_word_any(F.col("description"), ["the", "en", "und"]).alias("words"),
    )


COSTS = ("Free ($0)", "$ 35", " Paid ", "", "Fees apply", "call us", "coffee")


@query(
    f"""WITH c AS (SELECT o_orderkey AS id, {sql_texts(COSTS)}[o_orderkey % 7 + 1] AS cost FROM orders),
    p AS (SELECT id, CASE WHEN contains(lower(cost), 'free') THEN 'free' WHEN regexp_matches(lower(cost), '\\$\\s*\\d|paid|\\bfees?\\b') THEN 'paid' END AS price_class FROM c)
    SELECT *, CASE price_class WHEN 'free' THEN true WHEN 'paid' THEN false END AS is_free,
      CASE price_class WHEN 'free' THEN 'Free' WHEN 'paid' THEN 'Paid' END AS price_text FROM p"""
)
def cost_fields(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), prices.cost_field_class(pick(F.col("o_orderkey") % 7, COSTS)).alias("price_class")
    )
    c = F.col("price_class")
    return o.withColumn("is_free", prices.is_free_of(c)).withColumn("price_text", prices.price_text_of(c))


VENUES = ("Toyota Stadium, gate 2", "Frisco Athletic Center", "the frisco public library at Frisco Square", "Somewhere else")


@query(
    f"""WITH v AS (SELECT o_orderkey AS id, lower({sql_texts(VENUES)}[o_orderkey % 4 + 1]) AS v FROM orders)
    SELECT id, CASE WHEN contains(v, 'frisco athletic center') THEN 33.1461 WHEN contains(v, 'frisco public library') THEN 33.1429
      WHEN contains(v, 'toyota stadium') THEN 33.1548 ELSE 33.1506 END::DOUBLE AS lat,
      CASE WHEN contains(v, 'frisco athletic center') THEN -96.8097 WHEN contains(v, 'frisco public library') THEN -96.8259
      WHEN contains(v, 'toyota stadium') THEN -96.8354 ELSE -96.8236 END::DOUBLE AS lng FROM v"""
)
def venue_points(spark, sf):
    point = labels.venue_coordinates(pick(F.col("o_orderkey") % 4, VENUES))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), point.alias("p")).select("id", "p.lat", "p.lng")


@query(
    f"""WITH named AS (SELECT l_orderkey AS id, l_linenumber AS line, 'Hall ' || l_suppkey || ' Annex ' || l_partkey % 7 AS v FROM lineitem),
    listed AS (SELECT CASE s_suppkey % 3 WHEN 0 THEN 'annex ' || s_suppkey % 5 ELSE 'hall ' || s_suppkey END AS f,
      (s_suppkey * 37) % 101 AS p, s_suppkey / 1000.0 AS lat, s_nationkey / -10.0 AS lng FROM supplier),
    best AS (SELECT v, min_by(lat, (p, f, lat, lng)) AS lat, min_by(lng, (p, f, lat, lng)) AS lng
      FROM (SELECT DISTINCT v FROM named) JOIN listed ON contains(lower(v), f) GROUP BY v)
    SELECT id, line, v AS venue, coalesce(best.lat, 33.1506)::DOUBLE AS lat, coalesce(best.lng, -96.8236)::DOUBLE AS lng
    FROM named LEFT JOIN best USING (v)"""
)
def venue_table_points(spark, sf):
    """Positions of line items' halls by a table of fragments that grows with the suppliers."""
    number = lambda name: F.col(name).cast("string")
    rows = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("id"),
        F.col("l_linenumber").alias("line"),
        F.concat(F.lit("Hall "), number("l_suppkey"), F.lit(" Annex "), (F.col("l_partkey") % 7).cast("string")).alias("venue"),
    )
    k = F.col("s_suppkey")
    fragments = table(spark, sf, "supplier").select(
        F.when(k % 3 == 0, F.concat(F.lit("annex "), (k % 5).cast("string"))).otherwise(F.concat(F.lit("hall "), number("s_suppkey"))).alias("fragment"),
        ((k * 37) % 101).alias("priority"),
        (k / 1000.0).alias("lat"),
        (F.col("s_nationkey") / -10.0).alias("lng"),
    )
    return venues.locate(rows, fragments, "venue").select("id", "line", "venue", "point.lat", "point.lng")


# ---- ages -------------------------------------------------------------------------------

AUDIENCES = (
    "Children (0-5)", "Kids (6-12)", "Tweens", "Teens", "Adults", "Seniors", "All Ages", "Families",
    "Preschoolers", "All kids", "Staff", "Teens and tweens",
)


def audience_pairs(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("event_id"),
        F.concat(F.lit("a"), (F.col("l_suppkey") % 30).cast("string")).alias("audience_id"),
    )


def audience_taxonomy(spark, sf):
    k = F.col("n_nationkey")
    return table(spark, sf, "nation").select(
        F.concat(F.lit("a"), k.cast("string")).alias("id"), pick(k % 12, AUDIENCES).alias("name")
    )


@query(
    f"""WITH named AS (
      SELECT CAST(l_orderkey AS VARCHAR) AS event_id, {sql_texts(AUDIENCES)}[n_nationkey % 12 + 1] AS label, lower(label) AS n
      FROM lineitem LEFT JOIN nation ON n_nationkey = l_suppkey % 30),
    f AS (SELECT event_id, COUNT(*) AS ids, COUNT(n) AS known, MIN(label) AS label,
        BOOL_OR(regexp_matches(n, 'adult|senior')) AS adult, BOOL_OR(regexp_matches(n, 'all ages|famil')) AS everyone,
        BOOL_OR(regexp_matches(n, 'children \\(0|0-5|preschool|toddler|baby|babies')) AS young,
        BOOL_OR(regexp_matches(n, 'children \\(6|6-12') OR (contains(n, 'kids') AND NOT contains(n, 'all'))) AS middle,
        BOOL_OR(contains(n, 'tween')) AS tween, BOOL_OR(contains(n, 'teen')) AS teen FROM named GROUP BY event_id),
    r AS (SELECT *, list_filter([CASE WHEN young OR everyone THEN 0 END, CASE WHEN middle THEN 6 END, CASE WHEN tween THEN 10 END, CASE WHEN teen THEN 13 END], lambda x: x IS NOT NULL) AS lows,
        list_filter([CASE WHEN young THEN 5 END, CASE WHEN middle THEN 12 END, CASE WHEN tween THEN 13 END, CASE WHEN teen OR everyone THEN 17 END], lambda x: x IS NOT NULL) AS highs
      FROM f WHERE known > 0)
    SELECT event_id,
      CAST(CASE WHEN adult THEN CASE WHEN young OR middle OR tween OR everyone THEN 0 WHEN teen THEN 13 ELSE 18 END ELSE list_min(lows) END AS INT) AS age_min,
      CAST(CASE WHEN adult THEN CASE WHEN young OR middle OR tween OR everyone THEN 17 WHEN teen THEN 17 ELSE 99 END ELSE list_max(highs) END AS INT) AS age_max,
      CASE WHEN NOT adult AND ids = 1 AND len(lows) > 0 THEN label END AS age_label FROM r"""
)
def audience_ranges(spark, sf):
    return landings.resolve_audiences(audience_pairs(spark, sf), audience_taxonomy(spark, sf))


LINK_BLOCKS = (
    'AGE GROUP: <a href="/events?a=Kids">Kids</a>',
    'AGE GROUP: <a href="/events?a=Teens">T</a> <a href="/events?a=Adults">A</a>',
    'AGE GROUP: <a href="/events?a=Families+%28All+Ages%29">F</a>',
    'AGE GROUP: <a href="/events?a=Adults">A</a><a href="/events?a=Older+Adults">O</a>',
    'AGE GROUP: <a href="/events?a=Robots">R</a>',
    'no group <a href="/events?a=Kids">Kids</a>',
)


@query(
    """SELECT o_orderkey AS id, CAST([6, 13, 0, 18, NULL, NULL][o_orderkey % 6 + 1] AS INT) AS age_min,
    CAST([12, 17, 17, 99, NULL, NULL][o_orderkey % 6 + 1] AS INT) AS age_max,
    ['Kids (6–12)', NULL, 'All Ages', NULL, NULL, NULL][o_orderkey % 6 + 1] AS age_label, o_orderkey % 6 = 2 AS is_family FROM orders"""
)
def audience_links(spark, sf):
    k = F.col("o_orderkey")
    html = F.concat(F.lit("<p>"), F.col("o_orderpriority"), F.lit("</p>"), pick(k % 6, LINK_BLOCKS))
    return table(spark, sf, "orders").select(k.alias("id"), ages.audience_link_range(html).alias("r")).select("id", "r.*")


SUITABLE = (
    "Suitable for: Children (0–5)", "Suitable for: Teens, Adults", "Suitable for: Seniors",
    "Suitable for: Children (6–12) and Tweens", "Suitable for: anyone", "nothing here, Adults",
    "Suitable for: Adults, Children (0–5)", "Suitable for: Tweens",
)


@query(
    """SELECT o_orderkey AS id, CAST([0, 13, 18, 6, NULL, NULL, 0, 10][o_orderkey % 8 + 1] AS INT) AS age_min,
    CAST([5, 17, 99, 13, NULL, NULL, 17, 13][o_orderkey % 8 + 1] AS INT) AS age_max,
    ['Children (0–5)', NULL, NULL, NULL, NULL, NULL, NULL, 'Tweens (10–13)'][o_orderkey % 8 + 1] AS age_label FROM orders"""
)
def suitable_for(spark, sf):
    k = F.col("o_orderkey")
    html = F.concat(F.lit("<div>"), F.col("o_orderpriority"), F.lit("</div>"), pick(k % 8, SUITABLE))
    return table(spark, sf, "orders").select(k.alias("id"), ages.suitable_for_range(html).alias("r")).select("id", "r.*")


@query(
    """SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN p_size - 3 WHEN 1 THEN p_size END AS age_min,
    CASE p_size % 3 WHEN 0 THEN p_size END AS age_max,
    CASE p_size % 3 WHEN 0 THEN 'Ages ' || (p_size - 3) || ' – ' || p_size WHEN 1 THEN p_size || '+' ELSE 'everyone' END AS age_label FROM part"""
)
def age_texts(spark, sf):
    size = F.col("p_size")
    s = lambda c: c.cast("string")
    said = (
        F.when(size % 3 == 0, F.concat(F.lit("Ages "), s(size - 3), F.lit(" – "), s(size)))
        .when(size % 3 == 1, F.concat(s(size), F.lit("+"))).otherwise("everyone")
    )
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), ages.parse_age_text(said).alias("r")).select("id", "r.*")


# ---- page and document text -------------------------------------------------------------


@query(
    "SELECT page_id, " + sql_collapse(
        "replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&nbsp;', ' '), "
        "'&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', '''')"
    ) + " AS title FROM pages"
)
def page_titles(spark, sf):
    title = text.decode_entities(F.regexp_extract("html", landings.PAGE_TITLE, 1))
    return table(spark, sf, "pages").select("page_id", title.alias("title"))


@query("SELECT DISTINCT UNNEST(regexp_extract_all(html, 'href=\"/([^\"]+)\"', 1)) AS eid FROM pages")
def page_links(spark, sf):
    pages = table(spark, sf, "pages").select(F.col("html").alias("body"))
    return landings.calendar_ids(pages, r'href="/([^"]+)"')


@query("SELECT page_id, " + sql_collapse("regexp_replace(html, '<[^>]*>', ' ', 'g')") + " AS plain, "
       "regexp_replace(html, '<[^>]+>', '', 'g') AS stripped FROM pages")
def page_text(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", text.plain_text(F.col("html")).alias("plain"), text.strip_tags(F.col("html")).alias("stripped")
    )


def sql_entities(c: str) -> str:
    for name, char in (
        ("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&rsquo;", "’"),
        ("&lsquo;", "‘"), ("&rdquo;", "”"), ("&ldquo;", "“"), ("&apos;", "''"), ("&mdash;", "—"), ("&ndash;", "–"), ("&hellip;", "…"),
    ):
        c = f"replace({c}, '{name}', '{char}')"
    return sql_collapse(c)


@query(f"SELECT page_id, {sql_entities('html')} AS decoded FROM pages")
def decode_entities(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.decode_entities(F.col("html")).alias("decoded"))


@query(f"SELECT doc_id, {sql_collapse('lower(text)')} AS norm FROM documents")
def normalise_titles(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.normalise_title(F.col("text")).alias("norm"))


CLUTTER = ("<p>Monday, August 14 2026 9:30am - 10:15am Songs &amp; rhymes</p> Read on", "Plain words", " Read on ", "Read on the bus")


@query(f"SELECT o_orderkey AS id, ['Songs &amp; rhymes', 'Plain words', NULL, 'Read on the bus'][o_orderkey % 4 + 1] AS description FROM orders")
def feed_descriptions(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(k.alias("id"), text.clean_feed_description(pick(k % 4, CLUTTER)).alias("description"))


def sql_uri(c: str) -> str:
    c = f"url_encode({c})"
    for ch in ";,/?:@&=+$!~''()#*":
        if ch == "'":
            continue
        c = f"replace({c}, '%{ord(ch):02X}', '{ch}')"
    return f"replace({c}, '%27', '''')"


@query(f"SELECT page_id, {sql_uri(chr(117) + 'rl')} AS encoded, {sql_uri('html')} AS encoded_html FROM pages")
def encoded_urls(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", text.encode_uri(F.col("url")).alias("encoded"), text.encode_uri(F.col("html")).alias("encoded_html")
    )


@query(
    f"""WITH {LISTINGS} SELECT id, CASE WHEN location_name IS NULL THEN NULL ELSE
      regexp_replace(location_name, ' - 12 Main St$', '') || CASE WHEN source = 'plano-library' THEN ', Plano' ELSE ', Frisco' END END AS venue,
      title || ' — ' || COALESCE(location_name, 'Frisco Public Library') || CASE WHEN is_free THEN ' — Free' ELSE '' END AS page_title,
      'https://listings.example.org/events/' || id AS url FROM order_listings"""
)
def venue_and_titles(spark, sf):
    city = F.initcap(labels.city_of(F.col("source")))
    return order_listings(spark, sf).select(
        "id",
        text.short_venue(F.col("location_name"), city).alias("venue"),
        text.page_title(F.col("title"), F.col("location_name"), F.lit("Frisco Public Library"), F.col("is_free")).alias("page_title"),
        text.item_url("https://listings.example.org/", F.col("id")).alias("url"),
    )


@query(
    "WITH d AS (SELECT doc_id, " + sql_collapse("regexp_replace(text, '<[^>]*>', ' ', 'g')") + f""" AS raw FROM documents)
    SELECT doc_id, CASE WHEN length(raw) > 155 THEN regexp_replace(raw[1:152], '{SPACES}+{SPACES.replace('[', '[^', 1)}*$', '') || '…'
      WHEN length(raw) > 40 THEN raw ELSE 'Free kids event at Hall in Plano, TX — details, date, time, and directions on this site.' END AS meta FROM d"""
)
def meta_descriptions(spark, sf):
    meta = text.meta_description(F.col("text"), F.lit("Hall"), F.lit(True), F.lit("Plano"))
    return table(spark, sf, "documents").select("doc_id", meta.alias("meta"))


# ---- clocks -----------------------------------------------------------------------------

TWO_PASS = "g + (g - ((g AT TIME ZONE 'UTC') AT TIME ZONE 'America/Chicago'))"


@query(
    f"""WITH w AS (SELECT o_orderkey AS id, o_orderdate + to_minutes(CASE WHEN o_orderkey % 5 = 3 THEN 0 ELSE (o_orderkey % 48) * 30 END) AS g FROM orders)
    SELECT id, CASE WHEN id % 5 < 4 THEN {sql_stamp(TWO_PASS)} END AS utc FROM w"""
)
def wall_time_utc(spark, sf):
    k = F.col("o_orderkey")
    at = F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(mins=((k % 48) * 30).cast("int"))
    said = (
        F.when(k % 5 == 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"))
        .when(k % 5 == 1, F.date_format(at, "EEE, d MMM yyyy HH:mm:ss '+0000'"))
        .when(k % 5 == 2, F.date_format(at, "MMMM d, yyyy h:mm a"))
        .when(k % 5 == 3, F.date_format(at, "yyyy-MM-dd"))
        .otherwise("to be announced")
    )
    return table(spark, sf, "orders").select(k.alias("id"), stamp(wallclock.parse_wall_time(said)).alias("utc"))


@query(
    f"""SELECT o_orderkey AS id, {sql_stamp("((o_orderdate + INTERVAL 13 HOUR) AT TIME ZONE 'America/Chicago') AT TIME ZONE 'UTC'")} AS utc FROM orders"""
)
def wall_time_exact(spark, sf):
    said = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" 13:00"))
    utc = wallclock.parse_wall_time(said, exact=True)
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), stamp(utc).alias("utc"))


# months, days and hours past their range run on
@query(
    """WITH g AS (SELECT o_orderkey AS id, make_date(2020, 1, 1) + to_months(CAST(o_orderkey % 20 AS INT)) + to_days(CAST(o_orderkey % 45 AS INT))
      + to_hours(o_orderkey % 30) AS g FROM orders)
    SELECT id, strftime(g + (g - ((g AT TIME ZONE 'UTC') AT TIME ZONE 'America/Chicago')), '%Y-%m-%d %H:%M:%S') AS utc FROM g"""
)
def overflowing_fields(spark, sf):
    k = F.col("o_orderkey").cast("int")
    zero = F.lit(0)
    utc = wallclock.wall_to_utc(F.lit(2020), k % 20 + 1, k % 45 + 1, k % 30, zero, zero)
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), stamp(utc).alias("utc"))


LOCAL_START = "((start_datetime AT TIME ZONE 'UTC') AT TIME ZONE 'America/Chicago')"
LOCAL_END = "((end_datetime AT TIME ZONE 'UTC') AT TIME ZONE 'America/Chicago')"


@query(
    f"""WITH {LISTINGS} SELECT id, strftime({LOCAL_START}, '%a, %b %-d · %-I:%M %p') AS short_text,
      COALESCE(CAST({LOCAL_START} AS DATE) <> CAST({LOCAL_END} AS DATE), false) AS multi_day,
      CASE WHEN COALESCE(CAST({LOCAL_START} AS DATE) <> CAST({LOCAL_END} AS DATE), false)
        THEN strftime({LOCAL_START}, '%B %-d, %Y') || ' – ' || strftime({LOCAL_END}, '%B %-d, %Y') || ' · All day'
        ELSE strftime({LOCAL_START}, '%A, %B %-d, %Y at %-I:%M %p') || COALESCE(' – ' || strftime({LOCAL_END}, '%-I:%M %p'), '') END AS long_text
    FROM order_listings"""
)
def display_times(spark, sf):
    start, end = F.col("start_datetime"), F.col("end_datetime")
    return order_listings(spark, sf).select(
        "id", wallclock.short_when(start).alias("short_text"), wallclock.spans_days(start, end).alias("multi_day"),
        wallclock.long_when(start, end).alias("long_text"),
    )
