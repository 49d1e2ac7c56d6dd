"""Elements that hold the fields of cards and detail pages.

A selector is (tags, attribute, test, value): tags separated by "|", or "" for any tag; the test is "" for none,
"present", "is", "word" (one of the value's words) or "contains"."""


def _named(attribute: str, tags: str, *values: str) -> list[tuple]:
    return [(tags, attribute, "contains", value) for value in values]


# Elements of a card, tried in this order.
CARD_TITLE = [
    ("h2", "class", "contains", "jobTitle"),
    ("a", "data-jk", "present", ""),
    ("span", "title", "present", ""),
    ("a", "class", "contains", "jcs-JobTitle"),
    ("h2", "", "", ""),
]
CARD_COMPANY = [
    ("span|a", "data-testid", "contains", "company-name"),
    ("span", "class", "word", "companyName"),
    *_named("class", "span|div|a", "companyName", "jcs-CompanyLink", "companyLink"),
    ("span|a", "class", "contains", "company"),
    ("a", "aria-label", "contains", "hiring"),
]
CARD_LOCATION = [
    ("div", "data-testid", "contains", "text-location"),
    ("div", "class", "word", "companyLocation"),
    ("div|span", "class", "contains", "location"),
]
CARD_SALARY = [
    ("div|span", "data-testid", "contains", "attribute_snippet_test_salary"),
    *_named("class", "div|span", "salary", "compensation"),
]
CARD_POSTED = [
    ("span|div", "class", "contains", "date"),
    ("span|div", "data-testid", "contains", "myJobsStateDate"),
    *_named("class", "span|div", "metadata", "attribute_snippet", "job-snippet", "posted", "time", "ago"),
]
CARD_DESCRIPTION = [
    ("div", "class", "word", "job-snippet"),
    *_named("class", "div|span", "snippet", "summary", "description", "preview"),
]

# Elements that may hold the title of a whole page.
PAGE_TITLE = [
    ("", "data-automation-id", "contains", "jobTitle"),
    *_named("data-testid", "", "job", "title"),
    *_named("class", "", "job-title", "jobTitle", "JobTitle", "position-title", "opening-title"),
    *[(f"h{level}", "", "", "") for level in range(1, 6)],
    *_named("href", "a", "job", "position", "career"),
    *_named("class", "", "title", "job", "position"),
    ("a", "", "", ""),
]

# Containers of page controls, in this order, and words of which one must be in their text.
PAGINATION = [
    ("", "class", "word", "pagination"),
    *_named("class", "", "pagination", "paging", "page-navigation"),
    ("", "role", "is", "navigation"),
    *_named("aria-label", "nav", "pagination", "Pagination"),
]
PAGINATION_WORDS = ["page", "next", "prev", "1", "2", "3"]
CONTROL_TAGS = "a|button"

# Elements of a posting's own page.
DETAIL_SECTION = "jobsearch-JobDescriptionSection"
DETAIL_BENEFITS = [
    *_named("class", "div", "benefits", "perks", "compensation", DETAIL_SECTION),
    *_named("class", "ul", "benefits", "perks"),
]
DETAIL_REQUIREMENTS = [
    *_named("class", "div", DETAIL_SECTION, "description", "requirements", "qualifications"),
    *_named("class", "ul", "requirements", "qualifications"),
]
DETAIL_SKILLS = _named("class", "div", DETAIL_SECTION, "description", "requirements")
DETAIL_COMPANY = _named("class", "div", "company-info", "jobsearch-CompanyInfoContainer", "jobsearch-CompanyDescription")
DETAIL_INDUSTRY = [*DETAIL_COMPANY, *_named("class", "span", "industry"), *_named("class", "div", "industry")]
DETAIL_SIZE = [*DETAIL_COMPANY, *_named("class", "span", "size"), *_named("class", "div", "size")]
DETAIL_SALARY_BOXES = [
    ("div", "data-testid", "is", "job-details"),
    *_named("class", "div", "job-details", "jobDetails", DETAIL_SECTION),
]
DETAIL_SALARY = _named("class", "span|div", "icl-u-xs-mr--xs", "salary", "pay")
DETAIL_POSTED = [
    ("span|div", "class", "contains", "date"),
    ("span|div", "data-testid", "is", "myJobsStateDate"),
    *_named("class", "span|div", "metadata", "job-snippet", "posted", "time", "ago"),
]
COMPANY_SIZE_WORDS = [
    "employees", "staff", "team", "company size", "1-10", "11-50", "51-200", "201-500", "501-1000", "1001-5000",
    "5001+", "startup", "enterprise",
]
SALARY_ELEMENT_WORDS = ["year", "hour", "salary", "pay", "compensation"]
DETAIL_DESCRIPTION = [
    *_named("class", "div", "jobsearch-jobDescriptionText"),
    ("div", "data-testid", "is", "job-description"),
    *_named("class", "div", "jobDescriptionText", "job-description", "jobDescription", "description", "jobsearch-JobComponent"),
]
