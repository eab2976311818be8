"""Statements for the column expressions."""

from __future__ import annotations

from verification.prelude import (
    AUG, cdata, collapse, decode, esc_all, host, netloc, nodes_cte, part, slug, strip, url_slug,
)

TITLE = "regexp_extract(html, '(?is)<title[^>]*>([^<]*)', 1)"
SPLIT_TITLE = "coalesce(nullif(trim(regexp_extract({x}, '^(.*?)(?:\\s+[|–—-]\\s+.*)?$', 1)), ''), {x})"


def _resolve() -> str:
    scheme, net, path, query = (part("url", i) for i in (1, 2, 3, 4))
    site = f"{scheme} || '://' || {net}"
    folder = f"coalesce(nullif(regexp_replace({path}, '[^/]*$', ''), ''), '/')"
    folder = f"regexp_replace({folder}, '(.)/+', '\\1/', 'g')"
    up = f"coalesce(nullif(regexp_replace({folder}, '[^/]+/$', ''), ''), '/')"
    forms = [
        "url", f"{site} || '/The'", f"{scheme} || '://cdn.example.org/a.png'", f"{site} || {path} || '?q=1'",
        f"{site} || {path} || {query} || '#top'", f"{site} || {folder} || 'a.png'",
        f"{site} || {up} || 'pic/a.png'", f"{site} || {folder} || 'b/c.jpg'", "'mailto:x@example.org'",
        "'https://example.org/z'",
    ]
    return " UNION ALL ".join(
        f"SELECT page_id, CAST({i} AS BIGINT) AS n, {f} AS resolved FROM pages" for i, f in enumerate(forms)
    )


IMAGES = f"""
aug AS ({AUG}),
tg AS (SELECT page_id, url, unnest(range(len(x))) AS n, unnest(x) AS tag
       FROM (SELECT page_id, url, regexp_extract_all(html, '<(?:img|graphic)[^>]*>') AS x FROM aug)),
rf AS (SELECT *, regexp_extract(tag, '(?:src|url)="([^"]*)"', 1) AS r FROM tg),
im AS (SELECT page_id, n, CASE WHEN r LIKE '//%' THEN {part('url', 1)} || ':' || r
         WHEN r LIKE '/%' THEN {part('url', 1)} || '://' || {netloc('url')} || r
         WHEN r LIKE '../%' THEN {part('url', 1)} || '://' || {netloc('url')}
           || coalesce(nullif(regexp_replace(regexp_replace({part('url', 3)}, '[^/]*$', ''), '[^/]+/$', ''), ''), '/') || substr(r, 4)
         ELSE {part('url', 1)} || '://' || {netloc('url')}
           || coalesce(nullif(regexp_replace({part('url', 3)}, '[^/]*$', ''), ''), '/') || r END AS src
       FROM rf WHERE r <> ''),
ty AS (SELECT *, ['image/jpeg','image/png; charset=binary','','image/webp','application/x-unknown'][1 + (page_id + n) % 5] AS ct FROM im)"""
BASE = f"replace(regexp_extract({part('src', 3)}, '[^/]*$'), '%20', ' ')"
EXT = "CASE trim(split_part(ct, ';', 1)) WHEN 'image/jpeg' THEN '.jpg' WHEN 'image/png' THEN '.png' WHEN 'image/webp' THEN '.webp' ELSE '.jpg' END"


def _safe(name: str) -> str:
    named = f"CASE WHEN contains({name}, '.') THEN {name} ELSE 'image' || {EXT} END"
    return f"coalesce(nullif(trim(regexp_replace({named}, '[^A-Za-z0-9._-]+', '-', 'g'), '-'), ''), 'image.jpg')"


SQL = {
    "url_host": f"SELECT page_id, {host('url')} AS host FROM pages",
    "url_netloc": f"SELECT page_id, {netloc('url')} AS netloc FROM pages",
    "url_slug": f"SELECT page_id, {url_slug('url')} AS slug FROM pages",
    "raw_file_name": f"SELECT page_id, CASE WHEN page_id + 1 < 1000 THEN lpad(CAST(page_id + 1 AS VARCHAR), 3, '0') "
                     f"ELSE CAST(page_id + 1 AS VARCHAR) END || '-' || {url_slug('url')} || '.html' AS raw_name FROM pages",
    "resolve_url": _resolve(),
    "slugify": f"SELECT page_id, {slug(TITLE)} AS slug FROM pages",
    "cdata_wrap": f"SELECT page_id, md5({cdata(chr(114) + '.h')}) AS wrapped_md5 FROM "
                  "(SELECT page_id, replace(html, '</p>', ']]></p>') AS h FROM pages) r",
    "html_escape": f"SELECT page_id, md5({esc_all('html')}) AS escaped_md5 FROM pages",
    "trim_title_suffix": f"SELECT page_id, {SPLIT_TITLE.format(x='t')} AS title, {SPLIT_TITLE.format(x='u')} AS trimmed FROM "
                         f"(SELECT page_id, trim({decode(TITLE)}) AS t, trim({decode(TITLE)} || ' – ' || {host('url')}) AS u FROM pages)",
    "collapse_ws": f"SELECT page_id, md5({collapse('x')}) AS text_md5 FROM "
                   "(SELECT page_id, regexp_replace(html, '<[^>]*>', ' \n ', 'g') AS x FROM pages)",
    "strip_code_fence": f"SELECT page_id, md5({strip('html')}) AS html_md5 FROM pages",
    "decode_entities": f"WITH {nodes_cte()} SELECT page_id, pos, {decode('tok')} AS text FROM n WHERE kind = 'text' AND contains(tok, '&')",
    "wxr_dates": "SELECT event_id, strftime(ts, '%a, %d %b %Y %H:%M:%S') || ' +0000' AS pub_date, "
                 "strftime(ts, '%Y-%m-%d %H:%M:%S') AS post_date FROM events",
    "image_title": f"WITH {IMAGES} SELECT page_id, n, coalesce(nullif(trim(replace(replace("
                   f"regexp_replace({BASE}, '\\.[^.]*$', ''), '_', ' '), '-', ' ')), ''), 'image') AS title FROM im",
    "safe_filename": f"WITH {IMAGES} SELECT page_id, n, {_safe(BASE)} AS file_name, "
                     f"{_safe(BASE.replace('src', 'src2'))} AS typed_name FROM "
                     f"(SELECT *, regexp_replace(src, '\\.(jpg|png)', '', 'g') AS src2 FROM ty)",
    "mime_type": f"WITH {IMAGES} SELECT page_id, n, {EXT} AS extension, "
                 f"coalesce(nullif(trim(split_part(ct, ';', 1)), ''), CASE WHEN {BASE} LIKE '%.png' THEN 'image/png' "
                 "ELSE 'image/jpeg' END) AS mime FROM ty",
}
