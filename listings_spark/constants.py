"""Word lists, lookup tables, bounds and formats that results depend on."""

from __future__ import annotations

from datetime import datetime

# ---------------------------------------------------------------------------
# Publication policy
# ---------------------------------------------------------------------------
TARGET_CYCLE = 2027
MINIMUM_POSTED_AT = datetime(2026, 5, 1)
CLOSURE_CONFIRMATIONS = 2
PREVIEW_LIMIT = 10
PAGE_SIZE = 25
PAGE_SIZES = (10, 20, 30, 50, 100)

# ---------------------------------------------------------------------------
# Record bounds
# ---------------------------------------------------------------------------
MAX_ID_DIGITS = 30
MAX_COMPANY = 200
MAX_TITLE = 500
MAX_LOCATION = 500
MAX_LOCATIONS = 20
MAX_URL = 2048
MAX_DESCRIPTION = 200_000
MAX_INDUSTRIES = 500
MAX_START_DATE = 100
MAX_PHRASE = 200
MAX_PHRASES_PER_LIST = 500
MAX_PAGES = 10
MAX_RESULTS = 250
MAX_RECHECKS = 250
MAX_COMPANY_NAMES = 50
MAX_NOTES = 500
MAX_ERROR_CODE = 100
MAX_ERROR_MESSAGE = 500

# ---------------------------------------------------------------------------
# enumerations
# ---------------------------------------------------------------------------
EMPLOYMENT_TYPES = ("internship", "new-grad")
LISTING_STATUSES = ("open", "closed")
RUN_STATUSES = ("success", "failed")
DATE_POSTED = ("any", "day", "week", "month", "cycle")
WORKPLACES = ("any", "on-site", "remote", "hybrid")
CATEGORIES = (
    "artificial-intelligence", "cloud-devops-infrastructure", "computer-science",
    "computer-vision", "cybersecurity", "data-engineering", "data-science",
    "devops-site-reliability", "embedded-firmware-robotics", "firmware",
    "hardware-semiconductor", "machine-learning-ai", "natural-language-processing",
    "quantitative-technology", "research-engineering", "robotics", "security-engineering",
    "semiconductor-silicon", "site-reliability", "software-development",
    "software-engineering", "software-technology", "software-testing", "machine-learning",
    "infrastructure", "embedded-systems", "quantitative-development", "other-tech", "unknown",
)

# ---------------------------------------------------------------------------
# Classification phrases, in configured order
# ---------------------------------------------------------------------------
INTERNSHIP_PHRASES = (
    "intern", "internship", "internships", "summer internship", "industrial placement",
    "university placement", "co-op", "coop",
)
NEW_GRAD_PHRASES = (
    "new grad", "new graduate", "graduate", "graduate programme", "graduate program",
    "university graduate", "recent graduate", "early career", "entry level", "entry-level",
)
SENIORITY_PHRASES = (
    "senior", "staff", "principal", "lead", "manager", "director", "head of", "vice president",
)
CATEGORY_PHRASES = {
    "cybersecurity": (
        "application security", "cyber security", "cybersecurity", "information security",
        "security engineer",
    ),
    "quantitative-development": (
        "quant developer", "quantitative developer", "quantitative research",
    ),
    "embedded-systems": (
        "chip design", "electrical engineering", "embedded", "firmware", "hardware engineer",
        "hardware engineering", "robotics", "semiconductor", "silicon engineering",
        "systems programming",
    ),
    "infrastructure": (
        "cloud", "devops", "infrastructure", "kubernetes", "platform engineer",
        "site reliability", "sre",
    ),
    "data-engineering": (
        "analytics engineer", "data engineer", "data engineering", "data platform",
    ),
    "data-science": ("data science", "data scientist"),
    "machine-learning": (
        "artificial intelligence", "computer vision", "deep learning", "machine learning",
        "ml engineer", "natural language processing",
    ),
    "research-engineering": (
        "research engineer", "research intern", "research internship", "research scientist",
    ),
    "software-engineering": (
        "backend", "developer tools", "frontend", "full stack", "full-stack",
        "mobile developer", "qa engineer", "quality assurance", "software",
        "software developer", "software engineer", "software engineering", "software test",
        "test automation", "web developer",
    ),
}
OTHER_TECH_PHRASES = (
    "computer science", "developer", "information technology", "technical engineering",
    "technology intern",
)
# Card-title terms used when a search brings no rules of its own.
PREFILTER_INTERNSHIP_TERMS = (
    "intern", "internship", "internships", "industrial placement", "university placement",
    "co-op", "coop",
)
PREFILTER_NEW_GRAD_TERMS = (
    "new grad", "new graduate", "graduate", "university graduate", "recent graduate",
    "early career", "entry level", "entry-level",
)
TITLE_NOISE_WORDS = (
    "career", "co", "coop", "early", "entry", "grad", "graduate", "intern", "internship",
    "level", "new", "placement", "student", "summer", "university",
)
FALLBACK_TITLE_WORDS = (
    "ai", "computer", "data", "developer", "engineering", "ml", "research", "science",
    "software", "technical", "technology",
)

# ---------------------------------------------------------------------------
# Cycle-year evidence
# ---------------------------------------------------------------------------
YEAR_PATTERN = r"20[2-4]\d"
YEAR_CONTEXT_GAP = 24
CYCLE_CONTEXT_TERMS = (
    "internship", "intern", "summer", "placement", "programme", "program", "cycle",
    "graduate", "new grad", "early career", "entry level",
)
GRADUATE_LEADS = ("must", "should", "will", "to", "expected to", "planning to", "eligible to")

# ---------------------------------------------------------------------------
# Start periods and posting age
# ---------------------------------------------------------------------------
START_PERIODS = (
    "spring", "summer", "autumn", "fall", "winter", "january", "february", "march", "april",
    "may", "june", "july", "august", "september", "october", "november", "december",
)
START_VERBS = (
    "start", "starting", "starts", "begin", "beginning", "begins", "commence", "commences",
    "commencing", "join", "join our", "join the",
)
START_NOUNS = ("start", "intake", "internship", "programme", "program")
START_GAP = 24
AGE_UNIT_SECONDS = {
    "minute": 60,
    "hour": 3_600,
    "day": 86_400,
    "week": 7 * 86_400,
    "month": 31 * 86_400,
    "year": 365 * 86_400,
}
RECENCY_SECONDS = {"day": 86_400, "week": 604_800, "month": 2_592_000}

# ---------------------------------------------------------------------------
# geography
# ---------------------------------------------------------------------------
EUROPEAN_CODES = (
    "AD", "AL", "AT", "BA", "BE", "BG", "CH", "CY", "CZ", "DE", "DK", "EE", "ES", "FI", "FR",
    "GB", "GR", "HR", "HU", "IE", "IS", "IT", "LI", "LT", "LU", "LV", "MC", "MD", "ME", "MK",
    "MT", "NL", "NO", "PL", "PT", "RO", "RS", "SE", "SI", "SK", "SM", "UA", "VA", "XK",
)
COUNTRY_NAMES = {
    "albania": "AL", "andorra": "AD", "austria": "AT", "belgium": "BE", "bosnia": "BA",
    "bosnia and herzegovina": "BA", "bulgaria": "BG", "croatia": "HR", "cyprus": "CY",
    "czech republic": "CZ", "czechia": "CZ", "denmark": "DK", "england": "GB",
    "estonia": "EE", "finland": "FI", "france": "FR", "germany": "DE", "greece": "GR",
    "hungary": "HU", "iceland": "IS", "ireland": "IE", "italy": "IT", "kosovo": "XK",
    "latvia": "LV", "liechtenstein": "LI", "lithuania": "LT", "luxembourg": "LU",
    "malta": "MT", "moldova": "MD", "monaco": "MC", "montenegro": "ME", "netherlands": "NL",
    "north macedonia": "MK", "northern ireland": "GB", "norway": "NO", "poland": "PL",
    "portugal": "PT", "romania": "RO", "san marino": "SM", "scotland": "GB", "serbia": "RS",
    "slovakia": "SK", "slovenia": "SI", "spain": "ES", "sweden": "SE", "switzerland": "CH",
    "uk": "GB", "u k": "GB", "united kingdom": "GB", "ukraine": "UA", "vatican city": "VA",
    "wales": "GB",
}
CITY_NAMES = {
    "amsterdam": "NL", "athens": "GR", "barcelona": "ES", "belgrade": "RS", "berlin": "DE",
    "bratislava": "SK", "brussels": "BE", "bucharest": "RO", "budapest": "HU",
    "copenhagen": "DK", "dublin": "IE", "edinburgh": "GB", "helsinki": "FI", "krakow": "PL",
    "lisbon": "PT", "ljubljana": "SI", "london": "GB", "luxembourg": "LU", "madrid": "ES",
    "manchester": "GB", "milan": "IT", "munich": "DE", "oslo": "NO", "paris": "FR",
    "prague": "CZ", "riga": "LV", "rome": "IT", "sofia": "BG", "stockholm": "SE",
    "tallinn": "EE", "vilnius": "LT", "vienna": "AT", "warsaw": "PL", "zagreb": "HR",
    "zurich": "CH",
}
NON_EUROPEAN_CODES = ("GA", "NH", "OH", "ON", "TX")
NON_EUROPEAN_NAMES = (
    "australia", "austin", "brazil", "canada", "georgia", "india", "new hampshire",
    "new york", "ohio", "ontario", "san francisco", "seattle", "singapore", "texas",
    "united states", "us remote", "usa",
)
EUROPE_SUBSTRINGS = ("europe", "european union", "emea")

# ---------------------------------------------------------------------------
# Addresses and page markup
# ---------------------------------------------------------------------------
TRACKING_PARAMETERS = (
    "fbclid", "gclid", "originalsubdomain", "pagenum", "position", "ref", "referrer", "refid",
    "source", "trackingid", "trk",
)
TRACKING_PREFIX = "utm_"
LISTING_URL_PREFIX = "https://www.linkedin.com/jobs/view/"
LISTING_URN = "urn:li:jobPosting:"
BLOCK_MARKERS = (
    "captcha-internal", "challenge-page", "security verification", "unusual activity",
)
CLOSED_NOTICE = "no longer accepting applications"
GONE_STATUSES = (404, 410)

VOID_ELEMENTS = frozenset((
    "area", "base", "basefont", "bgsound", "br", "col", "command", "embed", "frame", "hr",
    "image", "img", "input", "isindex", "keygen", "link", "menuitem", "meta", "nextid",
    "param", "source", "spacer", "track", "wbr",
))

# ---------------------------------------------------------------------------
# Decision reasons
# ---------------------------------------------------------------------------
REASON_NO_TYPE = "title does not explicitly identify an internship or new-grad role"
REASON_SENIORITY = "title contains excluded seniority terminology"
REASON_NO_ROLE = "title has no technology-role signal"
REASON_OTHER_CYCLE = "listing is for the %s cycle"
REASON_UNKNOWN_CYCLE = (
    "opportunity cycle is not explicitly %s and posting date is not eligible"
)
REASON_OUTSIDE_EUROPE = "location is outside Europe"
REASON_NOT_EUROPEAN = "location is not explicitly European"
