"""Schemas of postings, pages and embedded cards."""

POSTING_FIELDS = [
    "title", "company", "company_url", "location", "description", "url", "salary_range", "job_type",
    "posted_date", "experience_level", "benefits", "requirements", "skills", "remote_type",
    "employment_type", "industry", "company_size", "job_id",
]
ARRAY_FIELDS = {"benefits", "requirements", "skills"}

POSTING_SCHEMA = (
    ", ".join(f"{f} {'array<string>' if f in ARRAY_FIELDS else 'string'}" for f in POSTING_FIELDS)
    + ", posting_key string, source string, query_id bigint, page_no bigint, pos bigint,"
    " fetched_at timestamp_ntz, salary_min bigint, salary_max bigint, salary_period string,"
    " posted_at timestamp_ntz"
)

PAGE_SCHEMA = "page_id bigint, url string, html string"

CARD_SCHEMA = (
    "struct<title: string, company: struct<name: string>, companyUrl: string,"
    " location: struct<displayName: string>, locationTypes: array<struct<name: int>>,"
    " pay: struct<min: bigint, max: bigint>, employmentTypes: array<struct<name: int>>,"
    " shortDescription: string, jobRedirectPageUrl: string, listingKey: string,"
    " benefits: array<struct<name: int>>, status: struct<postedAtUtc: string>>"
)

EVENT_SCHEMA = (
    "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
)
