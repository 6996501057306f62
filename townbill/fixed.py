"""Word lists, lookup tables and thresholds the results depend on.

Operators take every one of these as a parameter and use the value here as the default.
"""

# ---- fixed values: sources -------------------------------------------------------------
SOURCES = ("frisco-library", "plano-library", "play-frisco", "kaleidoscope-park")
COUNTED_SOURCES = ("frisco-library", "plano-library", "play-frisco")
INFERRED_SOURCES = ("play-frisco",)

# source -> (organisation, home page, short label, city)
SOURCE_DIM = {
    "frisco-library": ("Frisco Public Library", "https://www.friscolibrary.com/", "Frisco Library", "frisco"),
    "plano-library": ("Plano Public Library", "https://library.plano.gov/", "Plano Libraries", "plano"),
    "play-frisco": (
        "Play Frisco (Frisco Parks & Recreation)",
        "https://www.friscotexas.gov/291/Parks-Recreation",
        "Play Frisco",
        "frisco",
    ),
    "kaleidoscope-park": ("Kaleidoscope Park", "https://kaleidoscopepark.org/events/", "Kaleidoscope Park", "frisco"),
}

# city -> sources shown on its landing page (the fourth source is not among them)
CITY_SOURCES = {"frisco": ("frisco-library", "play-frisco"), "plano": ("plano-library",)}
CITY_LABEL = {"frisco": "Frisco", "plano": "Plano"}

# branch name, feed location id, address, lat, lng
BRANCHES = (
    ("Davis Library", "3218", "7501 Independence Pkwy, Plano, TX 75025", 33.0871, -96.7499),
    ("Haggard Library", "3219", "2501 Coit Rd, Plano, TX 75075", 33.0198, -96.7234),
    ("Harrington Library", "3220", "1501 18th St, Plano, TX 75074", 33.0157, -96.6989),
    ("Parr Library", "3221", "6200 Windhaven Pkwy, Plano, TX 75093", 33.0551, -96.8235),
    ("Schimelpfenig Library", "3222", "5024 Custer Rd, Plano, TX 75023", 33.0635, -96.7499),
    ("Virtual", "4074", "Online", 33.0198, -96.7234),
)

# venue name fragment -> coordinates; the first fragment found in the venue name wins
VENUE_COORDS = (
    ("frisco athletic center", 33.1461, -96.8097),
    ("frisco heritage center", 33.1503, -96.8276),
    ("frisco discovery center", 33.1534, -96.7855),
    ("frisco commons park", 33.1401, -96.8152),
    ("frisco public library", 33.1429, -96.8259),
    ("frisco square", 33.1429, -96.8259),
    ("george a. purefoy", 33.1429, -96.8259),
    ("toyota stadium", 33.1548, -96.8354),
    ("dr pepper ballpark", 33.1548, -96.8354),
    ("frisco isd", 33.1508, -96.8236),
)
DEFAULT_COORDS = (33.1506, -96.8236)
PARK_COORDS = (33.0978, -96.8230)
PARK_VENUE = "Kaleidoscope Park"
PARK_ADDRESS = "6635 Warren Parkway, Frisco, TX"
PARK_URL = "https://kaleidoscopepark.org/events/"
CARD_DEFAULT_LOCATION = "Frisco Public Library"
CALENDAR_DEFAULT_LOCATION = "Frisco Parks & Recreation"
FEED_DEFAULT_LINK = "https://plano.libnet.info/events"

# ---- fixed values: ages ----------------------------------------------------------------
BUCKET_RANGE = {"toddler": (0, 5), "kids": (6, 12), "teen": (13, 17), "family": (0, 17)}
AGE_GROUPS = ((0, 5), (6, 12), (13, 17))
AGE_BUCKETS = ("toddler", "kids", "teen", "family")
AGE_CONFIDENCES = ("high", "medium", "low")
# audience link value -> (lowest age, highest age, label)
AUDIENCE_LINKS = {
    "Babies": (0, 1, "Babies"),
    "Toddlers": (1, 3, "Toddlers"),
    "Preschoolers": (3, 5, "Preschoolers"),
    "Kids": (6, 12, "Kids (6–12)"),
    "Teens": (13, 17, "Teens"),
    "Families+(All+Ages)": (0, 17, "All Ages"),
    "Adults": (18, 99, "Adults"),
    "Older+Adults": (18, 99, "Older Adults"),
}
FAMILY_AUDIENCE = "Families+(All+Ages)"
ADULT_AGE = 18

# ---- fixed values: prices --------------------------------------------------------------
PRICE_CLASSES = ("free", "paid", "unknown")
PRICE_CONFIDENCES = ("confirmed", "inferred")
PAID_PHRASES = (
    "buy tickets", "buy ticket", "purchased ticket", "purchase a ticket", "purchase tickets",
    "tickets on sale", "ticket required", "tickets required", "no refund",
)
# (letters any match must hold, pattern) over lower-cased text; \b marks an ASCII word edge
PAID_PATTERNS = (
    ("cost", r"cost[:\s]+\$?\d[\d,.]*"),
    ("$", r"\$[\d,.]+"),
    ("fee", r"\bfees?\b"),
    ("register for ", r"\bregister for \$?\d"),
    ("per ", r"\bper (?:child|person|participant|family)\b"),
    ("materials fee", r"\bmaterials fee\b"),
    ("admission", r"\badmission[:\s]+\$?\d"),
)
FREE_PHRASES = (
    "free admission", "free to attend", "free of charge", "no cost to attend", "admission is free",
)
FREE_PATTERNS = (("free event", r"\bfree event\b"), ("no cost", r"\bno cost\b"))
AMBIGUOUS_PHRASES = (
    "at the gate", "members only", "member only", "reservation required",
    "reservations required", "donations welcome", "suggested donation",
)
STRUCTURALLY_PAID = (
    "camp", "class", "clinic", "workshop", "lessons", "league",
    "academy", "tournament", "per child", "per person", "materials fee", "deposit",
)

# ---- fixed values: keyword lists -------------------------------------------------------
ADULT_PROGRAM_KEYWORDS = (
    "book club", "write club", "figure club", "reader's choice",
    "entrepreneur's workshop", "esl book",
)
ADMIN_KEYWORDS = (
    "city council", "council meeting", "commission meeting", "board meeting",
    "board of", "work session", "advisory board", "advisory committee",
    "planning commission", "coffee with the mayor", "coffee with mayor",
)
REGISTRATION_KEYWORDS = (
    "register", "registration", "sign up", "sign-up", "signup",
    "reserve your spot", "reserve a spot", "limited space", "limited seats",
    "limited enrollment", "space is limited", "seats are limited",
    "rsvp", "enroll", "enrollment", "ticket", "pre-register",
)
CATEGORY_WORDS = (
    ("library", ("story", "read", "book", "librar")),
    ("arts", ("art", "craft", "paint", "draw", "creat")),
    ("stem", ("stem", "science", "tech", "robot", "code", "maker")),
    ("sports", ("sport", "soccer", "basket", "swim", "run", "athlet")),
    ("music", ("music", "sing", "danc", "choir")),
    ("parks-rec", ("park", "nature", "outdoor", "garden", "trail")),
)
DEFAULT_CATEGORY = "library"
ADULT_TITLE_PATTERNS = (
    ("for adults", r"\bfor adults\b"),
    ("adult", r"\badult['’]?s?\b"),
    ("senior", r"\bseniors?\b"),
    ("18+", r"\b18\+\b"),
)
ADULT_OVERRIDE_PATTERNS = (
    ("adult", r"\badults?\s*only\b"),
    ("21", r"\b21\s*\+"),
    ("18", r"\b18\s*\+"),
    ("must be 21", r"\bmust be 21\b"),
)
EXCLUDED_BRANCHES = ("Plano Public Library",)

# ---- fixed values: entities, in decoding order -----------------------------------------
ENTITIES = (
    ("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
    ("&rsquo;", "’"), ("&lsquo;", "‘"), ("&rdquo;", "”"), ("&ldquo;", "“"), ("&apos;", "'"),
    ("&mdash;", "—"), ("&ndash;", "–"), ("&hellip;", "…"),
)
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

# ---- fixed values: clocks, thresholds, limits ------------------------------------------
LOCAL_ZONE = "America/Chicago"
DAY_OFFSET_HOURS = 5
EARLIEST_HOUR = 7
MAX_IMPLAUSIBLE_SHARE = 0.1
MIN_OVERLAP = 20
MIN_AGREEMENT = 0.8
MIN_SHIFT_MINUTES = 30
MAX_SHRINK_SHARE = 0.5
MAX_EARLY_SHARE = 0.05
MIN_ROWS = {"frisco-library": 30, "plano-library": 30, "play-frisco": 0, "kaleidoscope-park": 5}
MAX_DOMINANT_SHARE = 0.85
MAX_TODDLER_SHARE = 0.9
TODDLER_RANGE = (0, 5)
FRESHNESS_HOURS = 48
FALLBACK_MIN_TOTAL = 20
FALLBACK_MAX_SHARE = 0.5
PAGE_SIZE = 20
HORIZON_MONTHS = 6
COST_PER_CALL = "0.006"
STATUS_RANK = {"none": 0, "ok": 1, "warn": 2, "err": 3}
ANALYTICS_DAYS = 90

# ---- fixed values: engagement ----------------------------------------------------------
STEP_LEVEL = {
    "session_start": 0, "filter_applied": 1, "event_card_click": 1,
    "detail_view": 2, "directions_tap": 2, "calendar_add": 3, "attending_tap": 3,
}
CONVERSION_EVENTS = ("calendar_add", "attending_tap")
SHARE_EVENT = "share_tap"
FILTER_EVENT = "filter_applied"
# output column -> (event name, least session step for it to count)
SUB_METRICS = {
    "card_click": ("event_card_click", 1),
    "filter_applied": ("filter_applied", 1),
    "detail_view": ("detail_view", 2),
    "directions": ("directions_tap", 2),
    "calendar_add": ("calendar_add", 3),
    "attending": ("attending_tap", 3),
}
ITEM_TALLIES = {
    "attending": "attending_tap", "calendar_adds": "calendar_add",
    "directions": "directions_tap", "shares": "share_tap",
}
