"""Rules that label whole pages and the cards on them."""

# Page type and pagination type by text, as ordered tests.
MODAL_MARKS = ['class="modal"', 'class="overlay"', 'class="popup"']
SEARCH_MARKS = ["search for jobs", "find jobs", "job search", "search positions"]
FILTER_MARKS = ["filter by location", "select location", "choose department"]
NUMBERED_MARKS = ["pagination", "page-item"]
LOAD_MORE_MARKS = ["load more", "show more"]
SCROLL_MARKS = ["infinite-scroll", "lazy-load", "scroll-load"]

# Visible text of landing pages.
LANDING_MARKS = [
    "work at", "life at", "join our team", "why work",
    "explore careers", "learn about", "our culture",
    "meet the team", "see our teams", "our values",
]

# Texts of pages without results, and of pages past the last result.
EMPTY_MARKS = [
    "no jobs found", "no results", "could not find any jobs", "no matching jobs",
    "no positions available", "0 jobs", "no open positions", "no current openings",
    "no opportunities",
]
END_MARKS = [
    "no more results", "no results found", "end of results", "that's all the jobs",
    "no jobs match", "try different search", "no jobs found",
    "we couldn't find any jobs", "0 jobs found",
]

# Words that show a page is about jobs at all.
JOB_WORDS = ["job", "position", "career", "opening", "vacancy", "role", "hiring"]

# A snapshot that shows a challenge page instead of results.
CHALLENGE_MARKS = ["Checking your browser", "Enable JavaScript and cookies to continue"]
CHALLENGE_PAIR = ["challenge-platform", "<title>Just a moment"]
RESULT_MARKS = ['id="mosaic-provider-jobcards"', 'class="jobsearch-ResultsList"', "data-jk="]

# Texts that belong to list headers, and texts that show a posting.
HEADER_MARKS = [
    "current openings", "all openings", "job openings",
    "search", "filter", "select location", "select job type",
]
ELEMENT_JOB_MARKS = [
    "full time", "part time", "contract", "remote",
    "manager", "director", "engineer", "days ago",
]

# Card selectors in order, (tag, attribute, how the value is tested, value).
PRIMARY_CARDS = [
    ("div", "data-jk", "present", ""),
    ("div", "class", "word", "job_seen_beacon"),
    ("td", "class", "word", "resultContent"),
]
FALLBACK_CARDS = [
    ("div", "class", "contains", "jobsearch-SerpJobCard"),
    ("div", "class", "contains", "jobsearch-"),
    ("div", "data-testid", "contains", "job"),
]
TITLE_LINK_CLASS = "jcs-JobTitle"

# JSON keys of payloads, the first present key of each list wins.
PAYLOAD_LISTS = ["jobs", "positions", "openings", "postings", "results", "data", "items"]
PAYLOAD_KEYS = {
    "title": ["title", "name", "position", "jobTitle", "job_title", "positionTitle"],
    "location": ["location", "city", "office", "workLocation", "locations"],
    "description": ["description", "summary", "details", "content", "descriptionPlain"],
    "url": ["url", "link", "applyUrl", "apply_url", "absoluteUrl", "hostedUrl"],
    "employment_type": ["employmentType", "type", "jobType", "commitment"],
    "salary_range": ["salary", "compensation", "salaryRange", "pay"],
    "posted_date": ["postedDate", "createdAt", "publishedAt", "datePosted"],
}

# Fixed value: results of a page.
PAGE_SIZE = 15
