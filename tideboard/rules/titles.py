"""Title rules."""

# Phrases that mark a title as navigation. Matched as whole words;
# the lone word "of" is left out because it occurs in real titles.
NAV_KEYWORDS = [
    "view all", "working in", "log in", "sign up", "careers",
    "read more", "apply now", "search", "filter", "sort by",
    "back to", "home", "about us", "contact", "privacy",
    "tips & tricks", "tips and tricks", "view locations",
    "my ideal job", "ideal job title", "show more", "show less",
    "load more", "see all", "browse", "explore", "share",
    "save job", "job alert", "email me", "subscribe",
    "cookie", "terms", "policy", "sign in", "register",
    "create account", "forgot password", "help", "support",
    "faq", "accessibility", "language", "location", "category",
    "department", "experience", "salary", "job type", "clear all",
    "refine", "results", "showing", "page", "next", "previous",
    "first", "last", "total",
    "working at", "life at", "work at", "join our", "meet the team",
    "our teams", "our culture", "our values", "our mission",
    "why work", "why join", "learn more", "find out", "discover",
    "hiring process", "how we hire", "application status",
    "see jobs", "see our", "see how", "take a look", "watch",
    "skip to", "newsletter", "follow us", "social media",
    "accommodations", "equal opportunity", "eeo", "diversity",
    "inclusion", "belonging", "veterans", "disability",
    "know your rights", "workplace discrimination",
    "teams", "locations", "offices", "overview", "about",
    "benefits", "culture", "values", "mission", "story",
    "students", "university", "graduates", "internships",
    "rotational program", "leadership program",
    "create profile", "build profile", "account settings",
    "messages", "notifications", "saved jobs", "applications",
    "job categories", "find your role", "hourly",
    "watch on", "play video", "see video", "listen",
    "download", "print", "email", "share this",
    "take action", "join talent community", "we would love to get to know you",
    "patagonia action works",
    "love where you work", "apply today", "thanks for visiting",
    "thanks for visiting our career site", "sign up here",
    "fly rods", "fly line", "womens", "mens", "kids", "accessories",
    "clothing", "equipment", "gear", "products", "shop", "store",
    "wingshooting", "dog stories", "stories", "blog", "news", "articles",
    "customer care", "contact us", "order status",
    "shipping information", "returns", "exchanges", "repairs",
    "gift card", "rewards", "feedback",
    "protecting your future", "catalog", "request a catalog",
    "generous health benefit", "401k", "paid parental leave",
    "life & disability insurance", "conservation leadership",
]

# Title openings that belong to page controls.
UI_OPENINGS = [
    r"\d+\s*my\s+", r"view\s+", r"show\s+", r"select\s+", r"choose\s+",
    r"click\s+", r"\d+\s*result", r"we would",
]

# Fixed value: a count of jobs, as category pages print it ("5 Jobs", "Sales (0 jobs)").
JOB_COUNT = r"\(\d+\s*jobs?\)|\d+\s*jobs?$"

# One-word titles that are menu entries.
SINGLE_WORD_NAV = [
    "overview", "teams", "locations", "offices", "benefits",
    "culture", "values", "students", "hourly", "design",
    "engineering", "marketing", "sales", "finance", "legal",
    "operations", "consulting", "technology", "business",
    "strategy", "retail", "corporate", "headquarters",
    "messages", "notifications", "settings", "profile",
    "japan", "australia", "dublin", "london", "singapore",
    "hyderabad", "munich", "paris", "tokyo", "seattle",
    "austin", "boston", "portland", "carlsbad",
    "product",
    "womens", "mens", "kids", "accessories", "clothing",
    "equipment", "gear", "products", "shop", "store", "catalog",
]

# Place names that appear alone as a menu entry.
PLACE_TITLES = [
    "new york", "san francisco", "los angeles", "mountain view",
    "palo alto", "menlo park", "redmond", "seattle", "austin",
    "boston", "chicago", "denver", "atlanta", "dallas", "houston",
    "london", "dublin", "paris", "munich", "berlin", "amsterdam",
    "singapore", "tokyo", "sydney", "toronto", "vancouver",
    "bangalore", "hyderabad", "pune", "mumbai", "delhi",
    "japan", "australia", "portland", "carlsbad",
]

# Department names that appear as a title of their own.
DEPARTMENT_TITLES = [
    "engineering & tech", "engineering and tech",
    "marketing & communications", "marketing and communications",
    "business strategy", "technical solutions",
    "data center operations", "account management",
    "technical program management", "silicon engineering",
    "family services", "environmental activism",
    "justice, equity & antiracism", "justice, equity",
    "executive management & legal", "supply chain",
    "sales & e-commerce", "people & culture",
    "finance & accounting", "information technology",
    "product",
]

# Words that name a role.
ROLE_TERMS = [
    "engineer", "developer", "manager", "director", "analyst",
    "specialist", "coordinator", "assistant", "associate",
    "lead", "senior", "junior", "principal", "staff",
    "consultant", "architect", "designer", "scientist",
    "technician", "administrator", "representative", "agent",
    "officer", "supervisor", "operator", "instructor",
    "programmer", "tester", "qa", "devops", "sre",
    "intern", "co-op", "apprentice", "fellow", "executive",
    "vice president", "vp", "head of", "chief",
]

# Phrases that turn a long title without role word into navigation.
LONG_TITLE_NAV = [
    "roles", "see jobs", "remote eligible", "more",
    "learn more", "apply now", "find out",
]

# Exact titles rejected when the posting has a URL / has none.
REJECTED_WITH_URL = ["view all", "all jobs"]
REJECTED_WITHOUT_URL = [
    "fly rods", "fly line", "womens", "mens", "wingshooting",
    "dog stories", "customer care", "catalog", "protecting your future",
    "love where you work", "apply today", "thanks for visiting",
    "view all", "all jobs", "current openings",
]

# Fixed values for the strict rules: phrases looked for in the description.
CATEGORY_TEXT = [
    " jobs", "job)", "(jobs)", "0 jobs", "no jobs",
    "view all", "see all jobs", "browse jobs",
    "category", "department", "team",
]
CATEGORY_COUNT_TEXT = ["0 jobs", " jobs)", " jobs "]
PRODUCT_TEXT_MAX_WORDS = 30
CONTENT_TEXT = [
    "dog stories", "wingshooting", "stories", "blog",
    "view all dog stories", "view all stories",
]
SERVICE_TEXT = [
    "help / faq", "contact us", "order status", "shipping information",
    "size & fit", "returns & exchanges", "repairs", "gift card balance",
    "rewards", "visa", "international orders", "corporate sales",
    "promotional exclusions", "give us feedback",
]
MARKETING_TEXT = [
    "thanks for visiting", "sign up here", "enjoy 15% off",
    "love where you work", "inclusive culture", "remote and flexible",
    "generous associate discount", "company holidays", "pto",
    "rod loaner program", "this is just a placeholder copy",
    "we live to develop and share our equipment",
]
JOB_DETAIL_TEXT = [
    "responsibilities", "requirements", "qualifications",
    "experience", "skills", "bachelor", "degree",
    "years of experience", "salary", "compensation",
]

# Fixed values for the strict rules: exact titles.
COUNTRY_TITLES = [
    "japan", "australia", "united states", "united kingdom",
    "canada", "germany", "france", "spain", "italy",
]
PRODUCT_TITLES = [
    "fly rods", "fly line", "womens", "mens", "kids",
    "wingshooting", "dog stories", "customer care",
    "catalog", "request a catalog", "protecting your future",
]
MARKETING_TITLES = [
    "love where you work", "apply today",
    "thanks for visiting our career site", "thanks for visiting",
]

# Fixed values for the strict rules: words inside the title.
JOB_TITLE_WORDS = [
    "associate", "manager", "director", "engineer", "developer",
    "analyst", "specialist", "coordinator", "assistant",
    "lead", "senior", "junior", "principal", "staff",
    "consultant", "architect", "designer", "scientist",
    "technician", "administrator", "representative", "agent",
    "officer", "supervisor", "operator", "instructor",
    "sales", "retail", "store", "warehouse",
]
PRODUCT_TITLE_WORDS = [
    "fly", "rods", "line", "womens", "mens", "kids",
    "wingshooting", "stories", "catalog", "care",
]
