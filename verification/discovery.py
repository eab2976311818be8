"""Statements for lists, sitemaps and the bundle."""

from __future__ import annotations

from verification.blocks_export import FAULTY
from verification.prelude import esc_all, host

SITE = "regexp_extract(url, '^[a-z]+://[^/?#]*')"
BUNDLE = f"""b AS (SELECT {SITE} AS link, max(page_id) AS added FROM pages GROUP BY 1)"""
MAPS = f"""m AS (SELECT page_id, url, {host('url')} AS host, page_id // 100 AS part FROM pages)"""
DOC = "'https://' || host || '/sitemap-' || part || '.xml'"
SPACE = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
ENTRY = (f"CASE WHEN page_id % 3 = 0 THEN '<url><image:image><image:loc>https://x.example/i.png</image:loc></image:image><loc> ' || {esc_all('url')} || "
         f"' </loc></url><url><loc> </loc></url>' ELSE '<url><loc>' || {esc_all('url')} || '</loc><lastmod>2024-01-01</lastmod></url>' END")

SQL = {
    "read_url_list": "SELECT row_number() OVER (ORDER BY page_id) AS ordinal, url, CASE page_id % 6 WHEN 3 THEN 'Rates' WHEN 4 THEN 'A | B' "
                     "WHEN 5 THEN '' END AS title_override FROM pages WHERE page_id % 6 > 1",
    "inline_urls": "SELECT page_id AS request_id, CAST(0 AS BIGINT) AS pos, url FROM pages UNION ALL SELECT page_id, 4, url FROM pages",
    "dedup_urls_ordered": f"SELECT {SITE} AS url, min(page_id) AS ordinal FROM pages GROUP BY 1",
    "cap_urls": f"SELECT {SITE} AS url, min(page_id) AS ordinal FROM pages GROUP BY 1 ORDER BY ordinal LIMIT 40",
    "selectors_table": f"SELECT {host('url')} AS host, max_by(CASE WHEN page_id % 3 = 0 THEN 'article.a' || page_id % 5 ELSE 'a[x=1]' END, page_id) AS css "
                       "FROM pages WHERE page_id % 3 < 2 GROUP BY 1",
    "sitemap_entries": f"WITH {MAPS} SELECT {DOC} AS doc_url, 'urlset' AS root, url AS loc FROM m",
    "bad_sitemaps": f"WITH {MAPS} SELECT DISTINCT {DOC} AS doc_url FROM m WHERE contains({DOC}, 'sitemap-1')",
    "read_gzip_sitemaps": f"""WITH {MAPS}, d AS (SELECT host, part, {DOC} AS name, ' <?xml version="1.0" encoding="UTF-8"?><urlset {SPACE} xmlns:image="http://www.google.com/schemas/sitemap-image/1.1">'
          || string_agg({ENTRY}, '' ORDER BY page_id) || '</urlset>' AS body FROM m GROUP BY host, part),
        i AS (SELECT host, part // 1000 AS k, '<sitemapindex {SPACE}><sitemap><loc>https://' || host || '/index-' || part // 1000 || '.xml</loc></sitemap>'
          || string_agg('<sitemap><loc>' || name || '</loc></sitemap>', '' ORDER BY part) || '</sitemapindex>' AS body FROM d GROUP BY host, part // 1000)
        SELECT md5(body) AS body_md5, count(*) AS documents FROM (SELECT body FROM d UNION ALL SELECT body FROM i) GROUP BY 1""",
    "expand_sitemaps": f"""WITH {MAPS},
        k AS (SELECT host, part // 1000 AS ix, part, dense_rank() OVER (PARTITION BY host, part // 1000 ORDER BY part) AS visit, page_id, url FROM m),
        f AS (SELECT host, ix, url, min(page_id) AS p FROM k WHERE visit < 50 GROUP BY ALL),
        o AS (SELECT 'https://' || host || '/index-' || ix || '.xml' AS root_url, row_number() OVER (PARTITION BY host, ix ORDER BY p) AS ordinal, url FROM f)
        SELECT * FROM o WHERE ordinal <= 5000""",
    "bundle_add": f"WITH {BUNDLE} SELECT link, 't' || added AS title, CAST(added AS VARCHAR) AS content, added FROM b",
    "bundle_remove": f"WITH {BUNDLE} SELECT link, 't' || added AS title, CAST(added AS VARCHAR) AS content, added FROM b WHERE link NOT LIKE 'https%'",
    "write_dual_export": f"""WITH {FAULTY} SELECT 'blocks' AS export, row_number() OVER (ORDER BY page_id) AS post_id, title, url AS link FROM titles WHERE page_id % 5 > 1
        UNION ALL SELECT 'raw', row_number() OVER (ORDER BY page_id), title, url FROM titles WHERE page_id % 5 > 0""",
}
