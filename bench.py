"""Times the headline queries on one machine and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tideboard import catalog  # noqa: E402
from tideboard.fixtures import posting_pages  # noqa: E402
from tideboard.session import local_session  # noqa: E402

HEADLINE = [
    "e1_board_search", "e2_embedded_search", "e3_career_pages", "h1_pages_to_text", "h2_pages_to_links",
    "h3_pages_to_cards", "h5_pages_to_title", "h6_classify_pages", "h7_pagination_info", "s3_project_payload",
    "s5_project_board_cards", "x3_clean_text", "x8_salary_text", "x9_salary_bounds", "x12_posted_at",
    "x13_detail_description_line", "x14_formatted_description", "x16_skills", "x22_posting_key", "f2_filter_location_usa",
    "f8_search", "f9_classify_url", "f10_classify_title", "f12_validate_strict", "j2_join_location_alias",
    "j4_enrich_details", "j5_match_lexicon", "j6_anti_seen", "j7_ttl_lookup", "j9_page_flags", "w1_dedup_first",
    "w2_cap_per_url", "w3_cut_pages", "w4_failure_streak", "a1_run_summary", "a3_crawl_metadata", "a5_field_completeness",
    "a8_reject_report",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, app="tideboard-bench")
    spark.sparkContext.setLogLevel("OFF")
    queries = catalog.queries()
    if names == ["all"]:
        names = list(queries)

    def run(name: str) -> float:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    # The derived tables that several queries share are staged first, so that no query pays for another.
    start = time.perf_counter()
    posting_pages(spark, sf_dir).write.format("noop").mode("overwrite").save()
    staging = round(time.perf_counter() - start, 3)
    seconds = {name: round(run(name), 3) for name in names}
    line = {
        "metric": "total seconds of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "staging": staging,
        "sf": Path(sf_dir).name.removeprefix("sf"),
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
