import datetime as dt

import pytest
from pyspark.sql import functions as F

from helpers import dicts, listings, one, table, utc
from townbill.functions import ages, labels, prices, text, wallclock
from townbill.functions.model_output import parse_answer
from townbill.sources.landings import resolve_audiences


def apply(spark, values, expr, kind="STRING"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i INT, v {kind}")
    return [r["x"] for r in rows.select("i", expr(F.col("v")).alias("x")).orderBy("i").collect()]


def same(spark, cases: dict, expr):
    assert dict(zip(cases, apply(spark, list(cases), expr))) == cases


def test_decode_entities(spark):
    same(spark, {
        "a&nbsp;b &amp; c": "a b & c",
        "&amp;lt;b&amp;gt;": "<b>",  # ampersand first, so double encoding resolves
        "&#39;&apos;&quot;": "''\"",
        "it&rsquo;s &ldquo;so&rdquo; &hellip;": "it’s “so” …",
        "&#8211; &#x2014;&#x41;": "– —A",
        "&#x1F600;": "",  # one UTF-16 unit per entity
        "&#55357;&#56832;": "😀",
        "&#xD83D;&#xDE00;!": "😀!",
        "  a \t\n b  c ": "a b c",
        "": "",
        None: None,
    }, text.decode_entities)


def test_spaces_and_tags(spark):
    same(spark, {"﻿ A   B ": "a b", "ÉCOLE  x": "école x"}, text.normalise_title)
    same(spark, {"a<b>c</b><>": "ac<>"}, text.strip_tags)
    same(spark, {"a<br>b<>c": "a b c"}, text.plain_text)


def test_feed_description(spark):
    same(spark, {
        "<p>Monday, August 14 2026 9:30am - 10:15am Songs</p> Read on": "Songs",
        "Read on": None, "": None, None: None, "Read on the bus": "Read on the bus",
    }, text.clean_feed_description)


def test_encode_uri(spark):
    same(spark, {
        "https://a.org/b c/é?x=1&y=(z)#f": "https://a.org/b%20c/%C3%A9?x=1&y=(z)#f",
        "100%+*~!'": "100%25+*~!'", "a%2Fb": "a%252Fb",
    }, text.encode_uri)


def test_short_venue(spark):
    same(spark, {
        "Parr Library - 6200 Windhaven": "Parr Library, Plano", "Parr – 12": "Parr, Plano", "Hall": "Hall, Plano", " - 12 St": "Plano",
        "Wi-Fi room": "Wi-Fi room, Plano",
    }, lambda c: text.short_venue(c, F.lit("Plano")))


def test_meta_description(spark):
    long = "word " * 60
    meta = lambda c: text.meta_description(c, F.lit("Hall"), F.lit(True), F.lit("Plano"), "Site")
    got = apply(spark, [long, "short", None, "x" * 41], meta)
    assert got[0].endswith("word…") and len(got[0]) <= 153
    assert got[1] == got[2] == "Free kids event at Hall in Plano, TX — details, date, time, and directions on Site."
    assert got[3] == "x" * 41


def test_slug(spark):
    same(spark, {"Story Time: 2 & up!": "Story-Time-2-up.ics", "***": "event.ics", "a" * 50: "a" * 40 + ".ics"}, text.slug_filename)


WALL = {
    "August 14, 2026 10:00 AM": "2026-08-14T15:00:00Z", "Aug 14, 2026": "2026-08-14T05:00:00Z", "Aug 14 2026 12:15 am": "2026-08-14T05:15:00Z",
    "Aug 14, 2026 12:15 p.m.": "2026-08-14T17:15:00Z", "Mon, 17 Aug 2026 09:30:00 +0000": "2026-08-17T14:30:00Z", "17 Aug 2026": "2026-08-17T05:00:00Z",
    "2026-08-15T08:00:00": "2026-08-15T13:00:00Z", "2026-08-15 08:00": "2026-08-15T13:00:00Z", "2026-08-15T08:00:00+09:00": "2026-08-15T13:00:00Z",
    "December 5, 2026 10:00 AM": "2026-12-05T16:00:00Z", "2026-08-14": "2026-08-14T05:00:00Z", " 2026-08-14 ": "2026-08-14T05:00:00Z",
    "TBD": None, "": None, None: None, "Foo 14, 2026": None, "undefined 5, 2026": None, "14 Foo 2026": None,
    # an hour off on the days the clocks change
    "2026-03-08 07:30": "2026-03-08T13:30:00Z", "2026-11-01 06:30": "2026-11-01T11:30:00Z",
    # fields past their range run on
    "2026-01-40 25:00": "2026-02-10T07:00:00Z", "2026-13-01": "2027-01-01T06:00:00Z",
}


@pytest.mark.parametrize("zone", ["UTC", "Asia/Tokyo"])
def test_wall_times_in_two_session_zones(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = apply(spark, list(WALL), lambda c: F.unix_seconds(wallclock.parse_wall_time(c)))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    want = [v and int(utc(v).timestamp()) for v in WALL.values()]
    assert dict(zip(WALL, got)) == dict(zip(WALL, want))


def test_exact_wall_time(spark):
    got = apply(spark, ["2026-03-08 07:30", "2026-11-01 06:30"], lambda c: F.unix_seconds(wallclock.parse_wall_time(c, exact=True)))
    assert got == [int(utc(t).timestamp()) for t in ("2026-03-08T12:30:00Z", "2026-11-01T12:30:00Z")]


def test_iso_only(spark):
    got = apply(spark, ["August 14, 2026", "2026-08-14", "2026-08-14 09:00:30"], lambda c: F.unix_seconds(wallclock.iso_wall_time(c)))
    assert got == [None, None, int(utc("2026-08-14T14:00:30Z").timestamp())]


def test_day_boundaries():
    assert wallclock.today_cutoff("2026-07-25T04:59:59Z") == utc("2026-07-24T05:00:00Z")
    assert wallclock.today_cutoff("2026-07-25T05:00:00Z") == utc("2026-07-25T05:00:00Z")
    assert wallclock.today_cutoff("2026-01-01T03:00:00Z") == utc("2025-12-31T05:00:00Z")
    assert wallclock.day_start("2026-07-25", plus_days=1) == utc("2026-07-26T05:00:00Z")


def test_display(spark):
    when = lambda a, b: table(spark, "s TIMESTAMP, e TIMESTAMP", [dict(s=utc(a), e=b and utc(b))]).select(
        wallclock.short_when(F.col("s")).alias("short"), wallclock.long_when(F.col("s"), F.col("e")).alias("long")).first()
    r = when("2026-08-14T15:00:00Z", None)
    assert (r["short"], r["long"]) == ("Fri, Aug 14 · 10:00 AM", "Friday, August 14, 2026 at 10:00 AM")
    assert when("2026-08-14T15:00:00Z", "2026-08-14T16:30:00Z")["long"].endswith("at 10:00 AM – 11:30 AM")
    # local days count, not UTC days
    assert when("2026-08-14T23:00:00Z", "2026-08-15T02:00:00Z")["long"].endswith("6:00 PM – 9:00 PM")
    assert when("2026-08-14T15:00:00Z", "2026-08-16T15:00:00Z")["long"] == "August 14, 2026 – August 16, 2026 · All day"


# ---- prices -----------------------------------------------------------------------------

PRICED = [
    ("A", "Old games day", "Drop in for games. Feeling competitive is fine, costumes welcome.", False, "free", "inferred"),
    ("B", "Float night", "COST: free to members. Others - $7 youth", False, "paid", "confirmed"),
    ("C", "Weekly walk", "Families can drop by every week this summer.", False, "free", "inferred"),
    ("D", "Cookie evening", "In this class each guest must have a purchased ticket. No refunds.", True, "paid", "confirmed"),
    ("E", "Museum night", "Today it is FREE ADMISSION everywhere, even for a class.", False, "free", "confirmed"),
    ("F", "Party", "Each person must purchase a ticket. BUY TICKETS HERE.", False, "paid", "confirmed"),
    ("G", "Last splash", "Cost: free for members. Event pass: $7 youth, $9 adults.", False, "paid", "confirmed"),
    # known gaps keep their present result
    ("gap1", "Fishing", "This beginner workshop is a class held indoors.", True, "unknown", "inferred"),
    ("gap2", "Quiet swim", "Early opening for few guests. Ticket available now!", False, "free", "inferred"),
    ("H", "Members", "Members only, at the gate", False, "unknown", "inferred"),
    ("I", "Classic", "A classic in the classroom, campers", False, "free", "inferred"),
    ("J", "Walk", "Drop in", True, "unknown", "inferred"),
    ("K", "Walk", "Materials fee applies", False, "paid", "confirmed"),
    ("L", "Walk", "register for 5 dollars", False, "paid", "confirmed"),
    ("M", "Accent", "éclass", False, "unknown", "inferred"),
    ("N", "Deposit", "deposit", False, "unknown", "inferred"),
]


def test_price_calibration(spark):
    rows = spark.createDataFrame([r[:4] for r in PRICED], "id STRING, title STRING, description STRING, reg BOOLEAN")
    got = rows.select("id", prices.fallback_price(F.col("title"), F.col("description"), F.col("reg")).alias("p")).select("id", "p.*")
    assert {r["id"]: (r["price_class"], r["price_confidence"]) for r in dicts(got)} == {r[0]: r[4:] for r in PRICED}


def test_price_without_description(spark):
    rows = table(spark, "title STRING, description STRING", [dict(title="Walk")])
    r = one(rows.select(prices.fallback_price(F.col("title"), F.col("description"), F.lit(None)).alias("p")).select("p.*"))
    assert r == {"price_class": "free", "price_confidence": "inferred"}


def test_cost_field(spark):
    same(spark, {"Free": "free", "Free ($0)": "free", "$35": "paid", "$ 5": "paid", " PAID ": "paid", "Fees vary": "paid", "coffee": None, "": None, "  ": None, None: None},
         prices.cost_field_class)


def test_price_badges(spark):
    rows = listings(spark, [
        dict(id="a", source="play-frisco", price_class="free", price_confidence="inferred"),
        dict(id="b", source="play-frisco", price_class="paid", price_confidence="confirmed"),
        dict(id="c", source="play-frisco", price_class="unknown"), dict(id="d", source="play-frisco", price_class="free"),
        dict(id="e", is_free=True), dict(id="f", is_free=False), dict(id="g", is_free=None),
    ])
    badge = prices.price_badge(F.col("source"), F.col("price_class"), F.col("price_confidence"), F.col("is_free"))
    got = rows.select("id", badge.alias("b")).select("id", "b.kind", prices.card_price_text(F.col("b")).alias("card"), prices.detail_price_text(F.col("b")).alias("detail"))
    assert {r["id"]: (r["kind"], r["card"], r["detail"]) for r in dicts(got)} == {
        "a": ("free-inferred", "Free ✦", "Free ✦"), "b": ("paid-confirmed", "Paid", "Paid"), "c": (None, None, None), "d": ("free-inferred", "Free ✦", "Free ✦"),
        "e": ("free-confirmed", "Free", "Free admission"), "f": ("paid-confirmed", "Paid", "Paid"), "g": (None, None, None),
    }


# ---- ages -------------------------------------------------------------------------------

AGE_ROWS = [
    dict(id="toddler", age_min=0, age_max=5), dict(id="six17", age_min=6, age_max=17), dict(id="none"), dict(id="half", age_min=3),
    dict(id="teen", age_min=13, age_max=17), dict(id="plano-teen", source="plano-library", age_min=13, age_max=17),
    dict(id="adult", age_min=18, age_max=99), dict(id="plano-family", source="plano-library", age_min=0, age_max=17, age_buckets=["family"]),
    dict(id="p-family", source="play-frisco", kid_relevant=True, age_confidence="high", age_buckets=["family"]),
    dict(id="p-kids", source="play-frisco", kid_relevant=True, age_confidence="medium", age_buckets=["kids", "teen"]),
    dict(id="p-low", source="play-frisco", kid_relevant=True, age_confidence="low", age_buckets=["kids"]),
    dict(id="p-null", source="play-frisco", age_confidence="high", age_buckets=["kids"]),
    dict(id="p-off", source="play-frisco", kid_relevant=False, age_confidence="high", age_buckets=["kids"]),
    dict(id="p-empty", source="play-frisco", kid_relevant=True, age_confidence="high", age_buckets=[]),
    dict(id="k-kids", source="kaleidoscope-park", kid_relevant=True, age_confidence="high", age_buckets=["kids"]),
]


def picked(spark, ranges, **kw):
    c = F.col
    passes = ages.passes_age_filter(ranges, c("source"), c("kid_relevant"), c("age_confidence"), c("age_buckets"), c("age_min"), c("age_max"), **kw)
    return {r["id"] for r in listings(spark, AGE_ROWS).filter(passes).select("id").collect()}


def test_age_filter(spark):
    assert picked(spark, [(0, 5)]) == {"toddler", "plano-family", "p-family"}
    assert picked(spark, [(6, 12)]) == {"six17", "plano-family", "p-family", "p-kids"}
    assert picked(spark, [(0, 5), (13, 17)]) == {"toddler", "six17", "teen", "plano-teen", "plano-family", "p-family", "p-kids"}
    assert picked(spark, [(30, 40)]) == {"adult"}
    # the fourth source has buckets only, and matches once it counts as inferred
    assert "k-kids" in picked(spark, [(6, 12)], inferred_sources=("play-frisco", "kaleidoscope-park"))


def test_age_badges(spark):
    c = F.col
    badge = ages.age_badge(c("source"), c("kid_relevant"), c("age_confidence"), c("age_buckets"), c("age_min"), c("age_max"))
    rows = listings(spark, AGE_ROWS).select("id", badge.alias("b"))
    got = {r["id"]: (r["kind"], r["card"], r["detail"]) for r in dicts(rows.select("id", "b.kind", ages.card_age_text(c("b")).alias("card"), ages.detail_age_text(c("b")).alias("detail")))}
    nothing = (None, None, None)
    assert got == {
        "toddler": ("structured-specific", None, "Ages 0–5"), "six17": ("structured-multi", None, "Ages 6–17"), "none": nothing, "half": nothing,
        "teen": ("structured-specific", None, "Teens"), "plano-teen": ("structured-specific", None, "Ages 13–17"), "adult": nothing,
        "plano-family": ("confirmed-family", "Family", "Family"), "p-family": ("inferred-family", "~ Family ✦", "~ Family ✦"),
        "p-kids": ("inferred-specific", "✦", "~ Ages 6–17 ✦"), "p-low": nothing, "p-null": nothing, "p-off": nothing, "p-empty": nothing, "k-kids": nothing,
    }


def test_typical_range(spark):
    rows = listings(spark, AGE_ROWS).select("id", ages.typical_age_range(F.col("age_min"), F.col("age_max"), F.col("age_buckets")).alias("t"))
    got = {r["id"]: r["t"] for r in dicts(rows)}
    assert (got["toddler"], got["half"], got["p-kids"], got["p-empty"], got["plano-family"]) == ("0-5", None, "6-17", None, "0-17")


def test_age_texts(spark):
    got = apply(spark, ["Ages 6–12", "5+", "6 - 8 and 9+", "all", "", None], ages.parse_age_text)
    assert [(r["age_min"], r["age_max"], r["age_label"]) for r in got] == [
        (6, 12, "Ages 6–12"), (5, None, "5+"), (6, 8, "6 - 8 and 9+"), (None, None, "all"), (None, None, None), (None, None, None)]


TAXONOMY = {
    "k05": "Children (0-5)", "k612": "Children (6-12)", "tw": "Tweens", "te": "Teens", "ad": "Adults", "se": "Seniors", "all": "All Ages", "fam": "Families",
    "pre": "Preschool", "kids": "Kids", "allkids": "All kids", "staff": "Staff",
}
AUDIENCES = {
    ("k05",): (0, 5, "Children (0-5)"), ("k05", "k612"): (0, 12, None), ("te",): (13, 17, "Teens"), ("tw", "te"): (10, 17, None), ("ad",): (18, 99, None),
    ("se", "te"): (13, 17, None), ("ad", "k612"): (0, 17, None), ("ad", "all"): (0, 17, None), ("all",): (0, 17, "All Ages"), ("fam", "pre"): (0, 17, None),
    ("kids",): (6, 12, "Kids"), ("allkids",): (None, None, None), ("staff",): (None, None, None), ("?",): None, ("?", "te"): (13, 17, None),
}


def test_audiences(spark):
    pairs = [dict(event_id="+".join(ids), audience_id=i) for ids in AUDIENCES for i in ids]
    found = resolve_audiences(table(spark, "event_id STRING, audience_id STRING", pairs), table(spark, "id STRING, name STRING", [dict(id=k, name=v) for k, v in TAXONOMY.items()]))
    got = {r["event_id"]: (r["age_min"], r["age_max"], r["age_label"]) for r in dicts(found)}
    assert got == {"+".join(k): v for k, v in AUDIENCES.items() if v}


def test_audience_links(spark):
    link = lambda *v: "AGE GROUP" + "".join(f'<a href="/events?a={x}">x</a>' for x in v)
    cases = {
        link("Kids"): (6, 12, "Kids (6–12)", False), link("Babies", "Teens"): (0, 17, None, False), link("Kids", "Adults"): (6, 12, None, False),
        link("Adults"): (18, 99, "Adults", False), link("Families+%28All+Ages%29"): (0, 17, "All Ages", True), link("Families+(All+Ages)"): (0, 17, "All Ages", True),
        link("Older+Adults", "Adults"): (18, 99, None, False), link("Robots"): (None, None, None, False), link("Kids%E0%A4%A"): (None, None, None, False),
        "AGE GROUP" + "x" * 700 + link("Kids")[9:]: (6, 12, "Kids (6–12)", False), "AGE GROUP<h3>Next</h3>" + link("Kids")[9:]: (None, None, None, False), link("Kids")[9:]: (None, None, None, False),
    }
    got = apply(spark, list(cases), ages.audience_link_range)
    assert [(r["age_min"], r["age_max"], r["age_label"], r["is_family"]) for r in got] == list(cases.values())


def test_suitable_for(spark):
    cases = {"Suitable for: Children (0–5)": (0, 5, "Children (0–5)"), "Suitable for: Adults": (18, 99, None), "Suitable for: Adults, Teens": (13, 17, None),
             "Suitable for: Adults, Tweens": (0, 17, None), "Suitable for: Teens": (13, 17, "Teens"), "Suitable for": (None, None, None), "Teens": (None, None, None)}
    got = apply(spark, list(cases), ages.suitable_for_range)
    assert [(r["age_min"], r["age_max"], r["age_label"]) for r in got] == list(cases.values())


# ---- labels -----------------------------------------------------------------------------


def test_category_takes_the_first_match(spark):
    same(spark, {"Story run": "library", "Robot party": "arts", "Robot run": "stem", "Swim and sing": "sports", "Choir": "music", "Trail": "parks-rec", "Xyz": "library"},
         lambda c: labels.guess_category(c, F.lit(None).cast("string")))


def test_registration_and_admin(spark):
    same(spark, {"Please REGISTER": True, "Sign-up sheet": True, "Walk in": False, "Ticketed": True}, lambda c: labels.needs_registration(c, F.lit("")))
    same(spark, {"City Council": True, "Board Game Night": False, "Board of Directors": True}, labels.is_admin_item)


def test_venue_order(spark):
    got = apply(spark, ["FRISCO SQUARE at Toyota Stadium", "Elsewhere"], labels.venue_coordinates)
    assert [(r["lat"], r["lng"]) for r in got] == [(33.1429, -96.8259), (33.1506, -96.8236)]


def test_supervision(spark):
    rows = listings(spark, [
        dict(id="teen", age_min=13, age_max=17), dict(id="young", age_min=0, age_max=5), dict(id="mixed", age_min=6, age_max=12), dict(id="unknown"),
        dict(id="half", age_min=6), dict(id="plano", source="plano-library"), dict(id="park", source="kaleidoscope-park"), dict(id="other", source="x"),
    ])
    got = {r["id"]: r["r"] and r["r"]["label"].removeprefix("Can kids be dropped off? ") for r in dicts(rows.select("id", labels.supervision(F.col("source"), F.col("age_min"), F.col("age_max")).alias("r")))}
    assert got == {
        "teen": "Yes — teens 13+ may attend alone", "young": "No — adult must stay with child", "mixed": "Only if child is 10 or older (Frisco Library policy)",
        "unknown": "Check with Frisco Library", "half": "Check with Frisco Library", "plano": "Plan to stay", "park": "Check with venue", "other": None,
    }


def test_disclosure(spark):
    play = dict(source="play-frisco", kid_relevant=True, age_confidence="high")
    rows = listings(spark, [
        dict(id="a", **play, age_buckets=["kids"], price_class="unknown"), dict(id="f", **play, age_buckets=["family"], price_class="unknown"),
        dict(id="p", **play, price_class="free", price_confidence="inferred"), dict(id="fp", **play, age_buckets=["family"], price_class="paid", price_confidence="inferred"),
        dict(id="c", **play, age_buckets=["kids"], price_class="free", price_confidence="confirmed"), dict(id="lib", age_min=0, age_max=5),
    ])
    c = F.col
    a = ages.age_badge(c("source"), c("kid_relevant"), c("age_confidence"), c("age_buckets"), c("age_min"), c("age_max"))
    p = prices.price_badge(c("source"), c("price_class"), c("price_confidence"), c("is_free"))
    end = " estimated from event description"
    assert {r["id"]: r["d"] for r in dicts(rows.select("id", labels.inference_disclosure(a, p).alias("d")))} == {
        "a": "Age suitability" + end, "f": "Family suitability" + end, "p": "'Free' admission status" + end,
        "fp": "Family suitability and 'Paid' admission status" + end, "c": "Age suitability" + end, "lib": None,
    }


def test_answers(spark):
    good = '{"kid_relevant": true, "age_buckets": ["kids", "old", 3], "confidence": "high", "price": "paid", "price_confidence": "confirmed", "reasoning": "r"}'
    got = apply(spark, [good, f"```json\n{good}\n```", f"```\n{good}```", f"Sure: {good} done", good.replace("true", '"true"'), good.replace("high", "sure"),
                        good.replace("true", "false"), good.replace('"paid"', '"cheap"').replace('"confirmed"', "1"), good.replace('"paid"', '"free"').replace('"confirmed"', '"x"'),
                        "no json", "{broken", "", None, '{"kid_relevant": true, "confidence": "low", "age_buckets": "kids"}'], parse_answer)
    keep = lambda r: r and (r["kid_relevant"], r["age_buckets"], r["age_confidence"], r["price"], r["price_confidence"], r["age_reasoning"])
    full = (True, ["kids"], "high", "paid", "confirmed", "r")
    assert [keep(r) for r in got] == [
        full, full, full, full, None, None, (False, [], "high", "paid", "confirmed", "r"), (True, ["kids"], "high", "unknown", "confirmed", "r"),
        (True, ["kids"], "high", "free", "inferred", "r"), None, None, None, None, (True, [], "low", "unknown", "confirmed", ""),
    ]


def test_element_body(spark):
    cases = {
        'class="x">a<div>b</div>c</div>d</div>e': 'class="x">a<div>b</div>c',
        '><DIV class="y"><div>b</div ></Div>c</DIV>d': '><DIV class="y"><div>b</div ></Div>c',
        ">a<divider></divider>b</div>c": ">a<divider></divider>b",
        ">a<div>b</div>c": ">a<div>b</div>c",
        ">a": ">a",
        "></div>": ">",
        "": "",
        None: None,
        ">" + "<div>x" * 500 + "</div>" * 500 + "end</div>out": ">" + "<div>x" * 500 + "</div>" * 500 + "end",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "c string")
    got = {r["c"]: r["b"] for r in rows.select("c", text.element_body(F.col("c"), "div").alias("b")).collect()}
    assert got == cases
