SELECT posting_id AS page_id, 'https://www.board-a.example.com/search?' || CASE WHEN source = 'board_b' THEN 'search=' ELSE 'q=' END || 'software+engineer+' || CAST(query_id AS STRING)
         || CASE WHEN page_no % 2 = 0 THEN '&l=Austin%2C+TX&start=' || CAST((page_no - 1) * 15 AS STRING) ELSE '&page=' || CAST(page_no AS STRING) END AS url,
       '<html><body><nav' || CASE posting_id % 4 WHEN 1 THEN ' role=' || chr(39) || 'navigation' || chr(39) ELSE '' END || '><a href="/about">About</a></nav><div data-jk="' || CAST(posting_id AS STRING) || '"><h2 class="jobTitle"><a href="' || coalesce(url, '#') || '">' || title
         || '</a></h2>' || CASE posting_id % 4
              WHEN 1 THEN '<span class=' || chr(39) || 'companyName' || chr(39) || '>' || coalesce('<a href=' || chr(39) || '/cmp/' || replace(company, ' ', '-') || chr(39) || '>' || company || '</a>', '') || '</span>'
              WHEN 2 THEN '<span class=companyName>' || coalesce(company, '') || '</span>'
              ELSE '<span class="companyName">' || coalesce(company, '') || '</span>' END
         || '<div class="companyLocation">' || coalesce(location, '') || '</div>'
         || CASE posting_id % 4 WHEN 2 THEN '<div class="salary"><div><span>' || coalesce(salary_text, '') || '</span></div></div>' ELSE '<div class="salary">' || coalesce(salary_text, '') || '</div>' END
         || CASE posting_id % 4 WHEN 2 THEN '<div class="job-snippet"><div>We build tools.</div><div>' || substr(description, 17) || '</div></div>' ELSE '<div class="job-snippet">' || description || '</div>' END
         || '<span class="date">' || coalesce(posted_text, '') || '</span></div>'
         || CASE posting_id % 4 WHEN 3 THEN '<div data-jk=' || chr(39) || 's' || CAST(posting_id AS STRING) || chr(39) || '><h2><a href="/jobs/s' || CAST(posting_id AS STRING) || '">Platform Engineer</a></h2><span class=companyName>Acme Tools</span><div class="companyLocation"><div>Austin, TX</div></div></div>' ELSE '' END
         || CASE WHEN source = 'board_b' THEN '<script type="application/json">{"hydrateJobCardsResponse":{"jobCards":[{"title":"' || title || '","location":{"displayName":"' || coalesce(location, '')
              || '"},"pay":{"min":' || CAST(20000 + posting_id % 90 * 1000 AS STRING) || ',"max":' || CAST(60000 + posting_id % 90 * 1000 AS STRING) || '},"listingKey":"k' || CAST(posting_id AS STRING) || '"}]}}</script>' ELSE '' END
         || CASE posting_id % 4
              WHEN 2 THEN '<ul class=pagination><li><div><a>1</a></div></li><li><div><a>2</a></div></li><li><a>' || CAST(2 + query_id % 9 AS STRING) || '</a></li><li><button>Next</button></li></ul>'
              ELSE '<div class="pagination"><a>1</a><a>2</a><a>' || CAST(2 + query_id % 9 AS STRING) || '</a><a>Next</a></div>' END || '<footer>x</footer></body></html>' AS html,
       '{"' || CASE posting_id % 3 WHEN 0 THEN 'jobs' WHEN 1 THEN 'results' ELSE 'postings' END || '":[{"' || CASE posting_id % 2 WHEN 0 THEN 'title' ELSE 'jobTitle' END || '":"' || title
         || '","city":"' || coalesce(location, '') || '","hostedUrl":"' || coalesce(url, '') || '","salary":{"min":' || CAST(posting_id % 90 AS STRING) || ',"max":' || CAST(posting_id % 90 + 30 AS STRING) || '}},7]}' AS payload
FROM postings
