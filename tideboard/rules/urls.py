"""URL rules."""

# Fragments of URLs that are never a posting.
BLOCKED_FRAGMENTS = [
    "/about", "/teams", "/team/", "/locations", "/location/",
    "/offices", "/benefits", "/culture", "/values", "/mission",
    "/diversity", "/inclusion", "/eeo", "/equal-opportunity",
    "/how-we-hire", "/hiring-process", "/application",
    "/students", "/university", "/graduates", "/internships",
    "/rotational-program", "/leadership-program",
    "/profile", "/settings", "/messages", "/notifications",
    "/saved-jobs", "/account", "/sign-in", "/login", "/register",
    "/newsletter", "/subscribe", "/social", "/follow",
    "/privacy", "/terms", "/policy", "/legal", "/cookie",
    "/contact", "/help", "/support", "/faq",
    "/watch", "/video", "/media", "/youtube",
    ".pdf", ".mp4", ".mov", ".avi",
    "/actionworks", "/action-works",
    "/jointalentcommunity", "/join-talent-community",
    "/our-brands-group",
    "/fly-fishing", "/fly-rods", "/fly-line", "/fly-",
    "/womens", "/mens", "/kids", "/clothing", "/equipment",
    "/products", "/shop", "/store", "/catalog",
    "/stories", "/blog", "/news", "/articles", "/dog-stories",
    "/wingshooting", "/content",
    "/customer-care", "/contact-us",
    "/order-status", "/shipping", "/returns", "/exchanges",
    "/repairs", "/gift-card", "/rewards", "/feedback",
]

# List and category pages.
CATEGORY_FRAGMENTS = ["/job_categories", "/job-categories", "/hourly-jobs", "/hourly_jobs"]
SEARCH_FRAGMENTS = ["/jobs/results", "/search"]
SEARCH_ID_MARKS = ["jobid=", "job_id=", "id=", "/job/", "/jobs/", "req=", "requisition"]

# Path words that carry postings.
NUMBERED_PATHS = [
    "careers", "jobs", "job", "openings", "positions", "position", "postings", "posting",
    "vacancies", "vacancy", "opportunities", "opportunity",
]
BARE_ENDINGS = ["/careers", "/jobs", "/openings", "/positions", "/jointalentcommunity", "/actionworks"]

# Fragments by which a link on a page is taken for a posting link.
JOB_LINK_FRAGMENTS = [
    "/job/", "/jobs/", "/careers/", "/career/", "/openings/", "/opening/",
    "/positions/", "/position/", "/postings/", "/posting/",
    "/vacancies/", "/vacancy/", "/opportunities/", "/opportunity/",
    "/recruitment/", "/apply/", "/req/",
]

# Known job boards in priority order, (board, domain fragment).
BOARDS = [
    ("greenhouse", "greenhouse.io"),
    ("lever", "lever.co"),
    ("workday", "myworkdayjobs.com"),
    ("jobvite", "jobvite.com"),
    ("smartrecruiters", "smartrecruiters.com"),
    ("bamboohr", "bamboohr.com/careers"),
    ("ashbyhq", "ashbyhq.com"),
    ("workable", "apply.workable.com"),
]

# Platform settings, (platform, domain fragment, page type, pagination type).
PLATFORMS = [
    ("greenhouse", "greenhouse.io", "direct_listing", "numbered"),
    ("lever", "lever.co", "direct_listing", "infinite_scroll"),
    ("workday", "myworkdayjobs.com", "search_first", "numbered"),
    ("bamboohr", "bamboohr.com/careers", "direct_listing", "none"),
    ("smartrecruiters", "smartrecruiters.com", "search_first", "infinite_scroll"),
    ("jobvite", "jobvite.com", "direct_listing", "load_more"),
    ("ashbyhq", "ashbyhq.com", "direct_listing", "none"),
    ("ultipro", "ultipro.com", "direct_listing", "infinite_scroll"),
    ("dayforce", "dayforcehcm.com", "direct_listing", "load_more"),
]
DEFAULT_PLATFORM = ("direct_listing", "none")
