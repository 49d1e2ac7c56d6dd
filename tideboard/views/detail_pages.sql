SELECT posting_id AS page_id, url,
       '<html><body><h1>' || title || '</h1><div data-testid="job-details"><div><span>' || coalesce(salary_text, '') || '</span></div></div><span class=' || chr(39) || 'posted' || chr(39) || '>' || coalesce(posted_text, '')
         || '</span><p>' || coalesce(employment_text, '') || '</p><div class="jobsearch-jobDescriptionText"><div>' || description || '</div><div>Our people ship every week and care about craft and calm on-call shifts, number ' || CAST(posting_id AS STRING)
         || '.</div></div><ul class="benefits"><li>Health insurance for <b>all ' || CAST(posting_id % 50 AS STRING) || '</b></li><li><span>Free lunch</span></li><li>x</li></ul><div class=' || chr(39) || 'requirements' || chr(39)
         || '><ul><li>Strong knowledge of Python and Docker</li><li>Bachelor degree or ' || CAST(posting_id % 7 + 2 AS STRING) || ' years of experience</li></ul></div>'
         || CASE posting_id % 3 WHEN 0 THEN '<span class=industry>Health care</span>' ELSE '' END || CASE posting_id % 2 WHEN 0 THEN '<div class="company-size">51-200</div>' ELSE '' END || '</body></html>' AS html
FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY query_id, page_no, posting_id) AS nth FROM postings WHERE url IS NOT NULL) first_of_url
WHERE nth = 1
