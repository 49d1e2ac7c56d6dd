SELECT o_orderkey AS posting_id,
       CASE o_orderkey % 3 WHEN 0 THEN 'board_a' WHEN 1 THEN 'board_b' ELSE 'career_page' END AS source,
       o_orderkey % 25 AS query_id,
       CAST(floor(o_orderkey / 25) AS BIGINT) % 8 + 1 AS page_no,
       CASE o_orderkey % 4 WHEN 0 THEN 'Senior ' WHEN 1 THEN 'Junior ' WHEN 2 THEN '' ELSE 'Staff ' END
         || CASE o_custkey % 9 WHEN 0 THEN 'Software Engineer' WHEN 1 THEN 'Data Scientist' WHEN 2 THEN 'Retail Sales Associate'
              WHEN 3 THEN 'DevOps Engineer (Remote)' WHEN 4 THEN 'Marketing Manager' WHEN 5 THEN 'View all' WHEN 6 THEN 'Engineering (5 Jobs)'
              WHEN 7 THEN 'Research Scientist' ELSE 'Warehouse Operator' END AS title,
       CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE 'Company ' || CAST(o_custkey % 40 AS STRING) END AS company,
       CASE c_nationkey % 9 WHEN 0 THEN 'Austin, TX' WHEN 1 THEN 'Chicago, IL US' WHEN 2 THEN 'Remote' WHEN 3 THEN 'New York, NY'
         WHEN 4 THEN 'Lahore, Pakistan' WHEN 5 THEN 'Toronto, ON, Canada' WHEN 6 THEN 'London, UK' WHEN 7 THEN 'Hybrid remote in Denver, CO' ELSE NULL END AS location,
       CASE o_orderkey % 7
         WHEN 0 THEN '$' || CAST(20 + CAST(floor(o_totalprice / 2000) AS BIGINT) AS STRING) || ',000 - $' || CAST(40 + CAST(floor(o_totalprice / 1500) AS BIGINT) AS STRING) || ',000 a year'
         WHEN 1 THEN '$' || CAST(20 + CAST(floor(o_totalprice / 2000) AS BIGINT) AS STRING) || 'K - $' || CAST(40 + CAST(floor(o_totalprice / 1500) AS BIGINT) AS STRING) || 'K'
         WHEN 2 THEN 'From $' || CAST(20 + o_custkey % 80 AS STRING) || 'K'
         WHEN 3 THEN '$' || CAST(15 + o_custkey % 40 AS STRING) || '.50 per hour'
         WHEN 4 THEN 'Up to $' || CAST(60 + o_custkey % 90 AS STRING) || ',000'
         ELSE NULL END AS salary_text,
       CASE o_orderkey % 8 WHEN 0 THEN 'Full-time' WHEN 1 THEN 'part time' WHEN 2 THEN 'Contract' WHEN 3 THEN 'Internship' WHEN 4 THEN 'temporary, full time' WHEN 5 THEN 'after-hours shift' ELSE NULL END AS employment_text,
       CASE o_orderkey % 9 WHEN 0 THEN 'Just posted' WHEN 1 THEN 'Today' WHEN 2 THEN 'Yesterday' WHEN 3 THEN 'Posted ' || CAST(o_custkey % 45 AS STRING) || ' days ago'
         WHEN 4 THEN CAST(1 + o_custkey % 23 AS STRING) || ' hours ago' WHEN 5 THEN CAST(1 + o_custkey % 59 AS STRING) || ' minutes ago' WHEN 6 THEN 'Active 30+ days ago'
         WHEN 7 THEN '2024-01-' || CASE WHEN o_custkey % 28 + 1 < 10 THEN '0' ELSE '' END || CAST(o_custkey % 28 + 1 AS STRING) ELSE NULL END AS posted_text,
       'We build tools. Requirements: ' || CASE o_custkey % 5 WHEN 0 THEN 'Python and AWS, 5 years. ' WHEN 1 THEN 'Java, Spring and MySQL. ' WHEN 2 THEN 'bachelor degree or better. ' WHEN 3 THEN 'Go or Rust, Docker. ' ELSE 'none. ' END
         || CASE c_custkey % 4 WHEN 0 THEN 'Benefits: Dental, vision, 401k and PTO.' WHEN 1 THEN 'Technology startup, 11-50 employees.' WHEN 2 THEN 'Healthcare enterprise.' ELSE 'Hybrid work from the office.' END AS description,
       CASE o_orderkey % 5 WHEN 0 THEN 'https://www.board-a.example.com/viewjob?jk=' || CAST(o_orderkey - CASE WHEN o_orderkey % 10 = 5 THEN 5 ELSE 0 END AS STRING) || '&from=serp'
         WHEN 1 THEN 'https://acme-corp.example.org/careers/' || CAST(o_orderkey AS STRING) WHEN 2 THEN 'https://shop.example.net/products/' || CAST(o_custkey AS STRING)
         WHEN 3 THEN '/jobs/' || CAST(o_orderkey AS STRING) ELSE NULL END AS url,
       o_orderdate AS fetched_at
FROM orders JOIN customer ON o_custkey = c_custkey
