"""Statements for near-copies, description overlap, merged sketches and image cover: all pairs, all runs."""

from __future__ import annotations

from verification.page_content import AUTO, BODY_BLOCKS
from verification.prelude import collapse, decode, host, nodes_cte

_FIRST = "regexp_extract(html, '<p>([^<]+)</p>', 1)"
NEAR = (f"SELECT page_id, url, replace(html, '</article>', '<p>' || regexp_replace({_FIRST}, '\\S+$', 'changed') || '</p><p>' || {_FIRST}"
        " || '</p></article>') AS html FROM pages")
PICS = ("SELECT page_id, url, replace(replace(html, '<article>', '<article><div class=\"story\">'), '</article>', "
        "'</div><div class=\"pics\"><img src=\"/1.jpg\"><img src=\"/2.jpg\"><p>Two views of the place as it is seen from the road in the morning and in the evening light</p></div></article>') AS html FROM pages")
_WORDS = "regexp_extract_all({}, '\\S+')"
_SHINGLES = """CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END"""
SETS = f"""
s0 AS (SELECT *, {_WORDS.format('text')} AS w FROM blocks),
s1 AS (SELECT page_id, {host('url')} AS host, block_id, text, {_SHINGLES} AS g FROM s0)"""
_LIKE = "len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g)))"
_SECOND = "regexp_extract(regexp_replace(html, '(?s)^.*?<p>[^<]+</p>', ''), '^<p>(\\S+ \\S+)', 1)"
_DESCRIPTION = f"replace({_FIRST}, '\"', '') || ' ' || {_SECOND} || CASE WHEN page_id % 3 = 0 THEN '' ELSE ' words that stand nowhere else here' END"

SQL = {
    "duplicate_content_near": f"""WITH {nodes_cte(NEAR)}, {BODY_BLOCKS}, {SETS},
        x AS (SELECT b.page_id, b.block_id, bool_or(a.text = b.text OR {_LIKE} >= 0.8 - 1e-9) AS near
          FROM s1 b LEFT JOIN s1 a ON a.page_id = b.page_id AND a.block_id < b.block_id GROUP BY b.page_id, b.block_id)
        SELECT page_id, count(*) AS blocks, count(*) FILTER (WHERE near) AS near, round(count(*) FILTER (WHERE near) / count(*), 4) AS near_ratio
        FROM x GROUP BY page_id HAVING count(*) FILTER (WHERE near) > 0""",
    "near_copies": f"""WITH {nodes_cte(NEAR)}, {BODY_BLOCKS}, {SETS}, tx AS (SELECT DISTINCT host, text, md5(text) AS m, g FROM s1)
        SELECT a.host, a.m AS a, b.m AS b, round({_LIKE}, 4) AS similarity FROM tx a JOIN tx b ON a.host = b.host AND a.m < b.m
        WHERE {_LIKE} >= 0.8 - 1e-9""",
    "meta_overlap": f"""WITH {nodes_cte()}, {BODY_BLOCKS},
        tx AS (SELECT page_id, ' ' || string_agg(text, ' ' ORDER BY block_id) || ' ' AS x FROM blocks GROUP BY page_id),
        d AS (SELECT page_id, {_WORDS.format(collapse(decode(_DESCRIPTION)))} AS w FROM pages),
        g AS (SELECT page_id, list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: ' ' || array_to_string(w[i:i + 4], ' ') || ' ')) AS g
          FROM d WHERE len(w) > 0)
        SELECT page_id, len(g) AS grams, len(list_filter(g, lambda y: contains(x, y))) AS found,
          round(len(list_filter(g, lambda y: contains(x, y))) / len(g), 4) AS ratio FROM g JOIN tx USING (page_id)""",
    "site_boilerplate_merged": f"""WITH {nodes_cte()}, {BODY_BLOCKS}
        SELECT {host('url')} AS host, text, count(DISTINCT page_id) AS n_pages FROM blocks GROUP BY 1, 2 HAVING count(DISTINCT page_id) >= 3""",
    "suggest_selector_images": f"""WITH {nodes_cte(PICS)}, {AUTO}, pg AS (SELECT DISTINCT page_id, url FROM auto WHERE kind = 'text' AND regexp_matches(tok, '\\S'))
        SELECT {host('url')} AS host, 'article' AS css, count(*) AS n_pages, count(*) AS votes FROM pg GROUP BY 1""",
}
