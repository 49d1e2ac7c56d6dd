"""Patterns shared by the column functions. All of them avoid look-around and back-references
unless the name says so, so that the same text runs in other SQL engines too."""

# Locations in free text, tested in this order.
LOCATION_PATTERNS = [
    r"(?i)\b(?:remote|hybrid|on-?site)\b",
    r"\b[A-Z][a-z]+,\s*[A-Z]{2}\b",
    r"\b[A-Z][a-z\s]+,\s*[A-Z][a-z]+\b",
    r"\b[A-Z][a-z\s]+,\s*[A-Z]{2},\s*[A-Z]{2,3}\b",
]

# Work modes in free text, tested in this order.
WORK_MODE_PATTERNS = [
    ("Remote", r"(?i)\bremote\b"), ("Hybrid", r"(?i)\bhybrid\b"), ("On-site", r"(?i)\bon-?site\b"),
]

# Words that pay is stated with.
PAY_UNITS = ["year", "yr", "hour", "hr"]
PAY_ADVERBS = ["annually", "hourly"]
YEARLY = ["a year", "per year", "annually", "yearly"]
RANGE_MARKS = ["-", "–", "to"]
PLAIN_RANGE_ENDS = ["usd", "eur", "gbp", "per year", "annually"]
PAY_OPENERS = ["up to", "starting at", "from", "base salary"]

# Words that the age of a posting is stated with.
AGE_UNITS = ["day", "hour", "minute", "min"]
AGE_WORDS = ["just posted", "just now", "today", "yesterday", "recently posted", "new posting", "fresh posting"]
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]

# Sentences that state requirements (group 1), tested in this order.
REQUIREMENT_PATTERNS = [
    r"(?i)requirements?:?\s*([^.]+)",
    r"(?i)must have:?\s*([^.]+)",
    r"(?i)required:?\s*([^.]+)",
    r"(?i)qualifications:?\s*([^.]+)",
]

# Company sizes, tested in this order.
COMPANY_SIZE_PATTERNS = [
    r"(?i)\d+\s*-\s*\d+\s*employees",
    r"(?i)\d+\+?\s*employees",
    r"(?i)startup", r"(?i)small business", r"(?i)enterprise", r"(?i)fortune 500",
]

# Words that exclude a line as a description, on a list card and on a detail page.
CARD_LINE_STOP_WORDS = [
    "days ago", "hours ago", "just posted", "remote", "hybrid",
    "salary", "benefits", "requirements", "qualifications", "posted",
    "apply", "company", "location", "job", "title", "responds within",
    "often responds", "new", "urgent", "hiring", "immediately",
]
DETAIL_LINE_STOP_WORDS = CARD_LINE_STOP_WORDS + [
    "indeed", "search jobs", "create account", "sign in", "easy apply",
]
# Fixed value: openings that mark a line as pay, age, a person's or company's name, or a place.
NOT_A_DESCRIPTION = (
    r"^\$[\d,]+|^\d+\s+(?:days?|hours?)\s+ago|^[A-Z][a-z]+\s+[A-Z][a-z]+$|^[A-Z][a-z]+,\s*[A-Z]{2}\s+\d{5}"
)
DESCRIPTION_LABEL = r"(?i)^(?:job|company|location|posted|salary|benefits|requirements):\s*"

# Fixed value: badges printed inside a card title.
TITLE_BADGES = r"(?i)\b(?:new|urgent|hiring)\b"

# What a formatted description leaves out. Labels at its beginning; lines that begin so; passages, from the
# first text over the others to the last one.
DESCRIPTION_LABELS = ["job", "company", "location", "posted", "salary", "benefits", "requirements", "description"]
CHROME_LINES = ["indeed", "job search", "search jobs", "create account", "sign in"]
BOILERPLATE = [
    ["profile insights", "skills", "do you have experience in", "yesno"],
    ["job details", "job type", "full-time"],
    ["find out how your skills align with the job description"],
]
# Headings that begin a line, and those that begin a paragraph.
LINE_HEADINGS = ["Position Title:", "Location:", "Reports To:", "Position Type:"]
PARAGRAPH_HEADINGS = ["ABOUT US", "POSITION OVERVIEW", "KEY RESPONSIBILITIES", "QUALIFICATIONS"]

# Character references decoded in text; "&amp;" comes last.
ENTITIES = [
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"),
    ("&copy;", "©"), ("&reg;", "®"), ("&trade;", "™"), ("&middot;", "·"), ("&bull;", "•"),
    ("&ndash;", "–"), ("&mdash;", "—"), ("&hellip;", "…"), ("&lsquo;", "‘"), ("&rsquo;", "’"),
    ("&ldquo;", "“"), ("&rdquo;", "”"), ("&laquo;", "«"), ("&raquo;", "»"), ("&euro;", "€"),
    ("&pound;", "£"), ("&cent;", "¢"), ("&deg;", "°"), ("&times;", "×"),
    ("&amp;", "&"),
]
