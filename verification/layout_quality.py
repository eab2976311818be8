"""Statements for layout blocks, reports, schedules and patterns."""

from __future__ import annotations

from verification.blocks_export import FULL
from verification.media_contract import TITLE, indexed_cte
from verification.page_content import ARTICLE
from verification.prelude import AUG, attr, collapse, decode, esc_all, host, netloc, nodes_cte, part

PATTERN_ROWS = f"""{nodes_cte(AUG)}, {ARTICLE},
sh AS (SELECT page_id, pos, tag || CASE WHEN coalesce({attr('tok', 'class')}, '') <> '' THEN '.' || {attr('tok', 'class')} ELSE '' END AS shape FROM art WHERE kind = 'open'),
pat AS (SELECT shape, CASE WHEN shape = 'p' THEN 'paragraph' WHEN regexp_matches(shape, '^h[1-6]') THEN 'heading' WHEN regexp_matches(shape, '^(ul|ol)') THEN 'list' ELSE 'group' END AS block_type,
   1.0 / (1 + length(shape)) AS confidence, count(*) AS n_confirmed, count(*) + length(shape) AS n_seen FROM sh GROUP BY shape)"""
EVENTS = f"""p AS (SELECT page_id, url, {host('url')} AS job_id FROM pages), c AS (SELECT job_id, count(*) + 1 AS total FROM p GROUP BY 1)"""
TEMPLATES = """tp(template, section_pos, block_type, level) AS (VALUES ('article',1,'heading',2),('article',2,'image',NULL),('article',3,'paragraph',NULL),
  ('rates',1,'heading',3),('rates',2,'paragraph',NULL),('rates',3,'table',NULL),('rates',4,'image',NULL),
  ('quotes',1,'quote',NULL),('quotes',2,'paragraph',NULL),('quotes',3,'heading',2),
  ('lists',1,'heading',2),('lists',2,'list',NULL),('lists',3,'paragraph',NULL),('lists',4,'image',NULL),('lists',5,'table',NULL))"""
PICK = f"""{TEMPLATES}, us AS (SELECT DISTINCT page_id, block_type FROM blk), vo AS (SELECT DISTINCT template, block_type FROM tp),
  sc AS (SELECT page_id, template, round(count(*) / ((SELECT count(*) FROM us z WHERE z.page_id = us.page_id) + (SELECT count(*) FROM vo z WHERE z.template = vo.template) - count(*)), 4) AS score
         FROM us JOIN vo USING (block_type) GROUP BY page_id, template),
  pick AS (SELECT page_id, template, score FROM sc QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY score DESC, template) = 1)"""
TABLES_ONLY = PICK.replace("FROM tp)", "FROM tp WHERE block_type = 'table')")
IMG = "('<!-- wp:image {} -->' || chr(10) || '<figure class=\"wp-block-image size-large\"><img src=\"' || url || '/i.png\" alt=\"a&quot;b\"/></figure>' || chr(10) || '<!-- /wp:image -->')"


def para(x: str) -> str:
    return f"('<!-- wp:paragraph -->' || chr(10) || '<p>' || {x} || '</p>' || chr(10) || '<!-- /wp:paragraph -->')"


LI = "'<!-- wp:list-item -->' || chr(10) || '<li>"
LE = "</li>' || chr(10) || '<!-- /wp:list-item -->'"
UL = "'<!-- wp:list -->' || chr(10) || '<ul class=\"wp-block-list\">' || chr(10) || "
ULE = " || chr(10) || '</ul>' || chr(10) || '<!-- /wp:list -->'"
NESTED = f"{UL}{LI}Sub ' || page_id || '{LE} || chr(10) || {LI}Two b{LE}{ULE}"
COL_TEXT = "'<!-- wp:paragraph -->' || chr(10) || '<p>"
COL_END = "</p>' || chr(10) || '<!-- /wp:paragraph -->' || chr(10) || '</div><!-- /wp:column -->'"


def column(text: str, width: str | None) -> str:
    if width:
        return (f"'<!-- wp:column {{\"width\":\"{width}\"}} --><div class=\"wp-block-column\" style=\"flex-basis:{width}\">' || chr(10) || {COL_TEXT}{text}{COL_END}")
    return f"'<!-- wp:column --><div class=\"wp-block-column\">' || chr(10) || {COL_TEXT}{text}{COL_END}"


def columns(one: str, two: str) -> str:
    return (f"'<!-- wp:columns --><div class=\"wp-block-columns\">' || chr(10) || {one} || chr(10) || {two} || chr(10) || '</div><!-- /wp:columns -->'")


STATUS = "CASE page_id % 4 WHEN 1 THEN 'failed' WHEN 2 THEN 'skipped' ELSE 'ok' END"
ATT = "CASE tag WHEN 'form' THEN 'form' WHEN 'iframe' THEN 'embed' END"

def ledger(where: str, over: str) -> str:
    return f"""WITH a AS (SELECT event_id // 4 AS fetch_id, event_id % 4 + 1 AS attempt, event_type = 'purchase' AS ok, event_type || ' at ' || event_id AS error FROM events{where}),
        s AS (SELECT fetch_id, min(attempt) FILTER (WHERE ok) AS f, max(attempt) AS l, max_by(error, attempt) FILTER (WHERE NOT ok) AS e FROM a GROUP BY 1)
        SELECT fetch_id, coalesce(f, l) AS attempts, f IS NOT NULL AS succeeded, CASE WHEN f IS NULL THEN e END AS last_error,
          CAST((coalesce(f, l) - 1) * coalesce(f, l) / 2 * 1.5 AS DOUBLE) AS waited, {over} AS over_limit FROM s"""


SQL = {
    "flatten_token_elements": " UNION ALL ".join(
        f"SELECT page_id, CAST({n} AS BIGINT) AS block_pos, '{t}' AS block_type, {m} AS markup FROM pages" for n, t, m in (
            (1, "paragraph", para(esc_all(collapse(decode(TITLE) + " || ' bold'")))), (2, "image", IMG), (3, "paragraph", para("'tail'")),
            (4, "paragraph", para("'end ⟦'")), (5, "paragraph", para("'x'")), (6, "image", IMG))),
    "nested_list_block": f"SELECT page_id, CAST(1 AS BIGINT) AS list_no, {UL}{LI}One <em>x</em>{LE} || chr(10) || {LI}Two' || chr(10) || {NESTED} || '{LE}{ULE} AS markup FROM pages WHERE page_id % 6 = 4 "
                         f"UNION ALL SELECT page_id, 2, '<!-- wp:list {{\"ordered\":true}} -->' || chr(10) || '<ol class=\"wp-block-list\">' || chr(10) || {LI}First{LE} || chr(10) || '</ol>' || chr(10) || '<!-- /wp:list -->' FROM pages WHERE page_id % 6 = 4",
    "image_block_caption": f"""WITH {nodes_cte(AUG)}, {ARTICLE}, {indexed_cte()} SELECT page_id, img_index, '<!-- wp:image {{"sizeSlug":"large"}} -->' || chr(10)
        || '<figure class="wp-block-image size-large"><img src="' || {esc_all('src')} || '" alt="' || {esc_all('alt')} || '"/>'
        || CASE WHEN src LIKE '%/pic/%' THEN '<figcaption class="wp-element-caption">Caption ' || page_id % 3 || '</figcaption>' ELSE '' END || '</figure>' || chr(10) || '<!-- /wp:image -->' AS markup FROM img""",
    "embed_block": f"""WITH {nodes_cte(AUG)}, e AS (SELECT page_id, pos, {attr('tok', 'src')} AS u FROM n WHERE tag = 'iframe' AND kind = 'open')
        SELECT page_id, pos, 'youtube' AS provider, u AS url, '<!-- wp:embed {{"url":"' || u || '","type":"video","providerNameSlug":"youtube","responsive":true}} --><figure class="wp-block-embed is-type-video"><div class="wp-block-embed__wrapper">'
          || u || '</div></figure><!-- /wp:embed -->' AS markup FROM e""",
    "gallery_block": f"""WITH {FULL}, s AS (SELECT *, CASE WHEN lag(block_type) OVER (PARTITION BY page_id ORDER BY block_pos) = 'image' THEN 0 ELSE 1 END AS fresh FROM blk),
        g AS (SELECT *, sum(fresh) OVER (PARTITION BY page_id ORDER BY block_pos ROWS UNBOUNDED PRECEDING) AS run FROM s WHERE block_type = 'image')
        SELECT page_id, min(block_pos) AS first_pos, count(*) AS images, least(count(*), 3) AS columns, '<!-- wp:gallery {{"columns":' || least(count(*), 3)
          || ',"linkTo":"none"}} --><figure class="wp-block-gallery has-nested-images columns-' || least(count(*), 3) || '">' || chr(10) || string_agg(markup, chr(10) ORDER BY block_pos)
          || chr(10) || '</figure><!-- /wp:gallery -->' AS markup FROM g GROUP BY page_id, run HAVING count(*) > 1""",
    "columns_block": f"SELECT page_id, CAST(2 AS BIGINT) AS columns, {columns(column('One <strong>&amp;</strong>', '33.33%'), column('Two', '66.66%'))} AS markup FROM pages "
                     f"UNION ALL SELECT page_id, 2, CASE WHEN page_id % 2 = 0 THEN {columns(column('Left side', '33.33%'), column('Right side', '66.66%'))} "
                     f"ELSE {columns(column('Left side', None), column('Right side', None))} END FROM pages WHERE page_id % 6 = 5",
    "button_block": f"""SELECT page_id, '<!-- wp:buttons --><div class="wp-block-buttons"><!-- wp:button --><div class="wp-block-button"><a class="wp-block-button__link wp-element-button" href="'
        || {part('url', 1)} || '://' || {netloc('url')} || '/go">Go</a></div><!-- /wp:button --></div><!-- /wp:buttons -->' AS markup FROM pages WHERE page_id % 6 = 5""",
    "progress_log": f"WITH {EVENTS} SELECT job_id, page_id AS idx, {STATUS} AS status, url, '[' || upper({STATUS}) || '] ' || url || ' — ' || "
                    f"CASE WHEN {STATUS} = 'ok' THEN 'Title ' || page_id ELSE 'went wrong' END AS line FROM p",
    "job_progress": f"WITH {EVENTS} SELECT job_id, total - 1 AS done, total, CAST(round((total - 1) * 100 / total) AS BIGINT) AS percent FROM c",
    "politeness_schedule": f"SELECT page_id, {netloc('url')} AS netloc, CAST((row_number() OVER (PARTITION BY {netloc('url')} ORDER BY page_id) - 1) * 1.5 AS DOUBLE) AS start_second FROM pages",
    "rate_audit": "SELECT event_id, user_id, gap_us FROM (SELECT event_id, user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap_us FROM events) "
                  "WHERE gap_us < 600000000",
    "retry_ledger": ledger("", "0::BIGINT"),
    "retry_ledger_limited": ledger(" WHERE event_id % 4 < 3", "(SELECT count(*) FROM events WHERE event_id // 4 = fetch_id AND event_id % 4 = 3)"),
    "politeness_schedule_hot": f"""WITH h AS (SELECT ('0x' || substr(md5(page_id::VARCHAR), 1, 15))::BIGINT AS page_id,
          CASE WHEN page_id % 3 = 0 THEN 'hot.example.org' WHEN page_id % 7 = 0 THEN NULL ELSE {netloc('url')} END AS netloc FROM pages)
        SELECT page_id, netloc, CAST((row_number() OVER (PARTITION BY netloc ORDER BY page_id) - 1) * 1.5 AS DOUBLE) AS start_second FROM h""",
    "manual_attention": f"""WITH {nodes_cte(AUG)}, x AS (SELECT *, CASE WHEN kind = 'text' AND regexp_matches(tok, '\\S') THEN {collapse(decode('tok'))} END AS tx FROM n),
        y AS (SELECT *, last_value(tx IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_text,
          first_value(tx IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after_text FROM x)
        SELECT page_id, url, pos, {ATT} AS reason, coalesce({attr('tok', 'src')}, {attr('tok', 'action')}, '') AS target, before_text, after_text FROM y WHERE kind = 'open' AND tag IN ('form', 'iframe')""",
    "placeholders": f"""WITH {nodes_cte(AUG)}, o AS (SELECT page_id, tag, pos AS a, (SELECT min(c.pos) FROM n c WHERE c.page_id = n.page_id AND c.tag = n.tag AND c.kind = 'close' AND c.pos > n.pos) AS z
          FROM n WHERE kind = 'open' AND tag IN ('form', 'iframe'))
        SELECT page_id, pos, CASE WHEN kind = 'open' AND tag IN ('form', 'iframe') THEN '<p><strong>[Needs manual attention: ' || {ATT} || ' ' || coalesce({attr('tok', 'src')}, {attr('tok', 'action')})
          || ']</strong></p>' ELSE tok END AS tok FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.page_id = n.page_id AND n.pos > a AND n.pos <= z)""",
    "classify_structures": f"""WITH {PATTERN_ROWS}, 
        pn AS (SELECT * FROM ({'WITH ' + nodes_cte() + ', ' + ARTICLE} SELECT page_id, pos, tag || CASE WHEN coalesce({attr('tok', 'class')}, '') <> '' THEN '.' || {attr('tok', 'class')} ELSE '' END AS shape FROM art WHERE kind = 'open'))
        SELECT page_id, pos, pn.shape, block_type, round(coalesce(CAST(confidence AS DOUBLE), 0), 4) AS confidence, CASE WHEN confidence >= 0.3 THEN 'auto' ELSE 'placeholder' END AS decision
        FROM pn LEFT JOIN pat ON pat.shape = pn.shape AND pat.shape <> 'b'""",
    "learn_patterns": f"""WITH {PATTERN_ROWS}, f AS (SELECT shape, 'group' AS block_type, count(*) FILTER (WHERE pos % 3 <> 0) AS ok, count(*) AS seen FROM sh GROUP BY shape),
        u AS (SELECT shape, block_type, n_confirmed AS ok, n_seen AS seen FROM pat UNION ALL SELECT * FROM f)
        SELECT shape, block_type, round((sum(ok) + 1) / (sum(seen) + 2), 4) AS confidence, CAST(sum(ok) AS BIGINT) AS n_confirmed, CAST(sum(seen) AS BIGINT) AS n_seen FROM u GROUP BY ALL""",
    "learn_patterns_twice": f"""WITH {PATTERN_ROWS}, s AS (SELECT shape, 'group' AS block_type, 2 * count(*) AS seen, 2 * count(*) FILTER (WHERE shape = 'p' OR shape LIKE 'p.%') AS ok FROM sh GROUP BY shape)
        SELECT shape, block_type, round((ok + 1) / (seen + 2), 4) AS confidence, CAST(ok AS BIGINT) AS n_confirmed, CAST(seen AS BIGINT) AS n_seen FROM s""",
    "pick_template": f"WITH {FULL}, {PICK} SELECT page_id, template, coalesce(score, 0) AS score FROM (SELECT page_id FROM pages) LEFT JOIN pick USING (page_id)",
    "pick_template_none": f"WITH {FULL}, {TABLES_ONLY} SELECT page_id, template, coalesce(score, 0) AS score FROM (SELECT page_id FROM pages) LEFT JOIN pick USING (page_id)",
    "template_conformance": f"""WITH {FULL}, {PICK}, j AS (SELECT b.page_id, b.block_pos, b.block_type, b.level,
          (SELECT min(section_pos) FROM tp WHERE tp.template = p.template AND tp.block_type = b.block_type) AS sec,
          (SELECT count(*) FROM tp WHERE tp.template = p.template AND tp.block_type = b.block_type AND tp.level IS NOT NULL AND tp.level <> b.level) AS badlev FROM blk b JOIN pick p USING (page_id)),
        k AS (SELECT *, last_value(sec IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY block_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM j)
        SELECT page_id, block_pos, block_type, CASE WHEN sec IS NULL THEN 'not in template' WHEN badlev > 0 THEN 'other level' ELSE 'out of order' END AS problem
        FROM k WHERE sec IS NULL OR badlev > 0 OR sec < prev""",
    "host_report": f"""WITH {FULL}, r AS (SELECT {host('url')} AS host, 'selector' AS content_source, images FROM body)
        SELECT host, content_source, count(*) AS pages, count(*) AS ok, CAST(sum(images) AS BIGINT) AS images FROM r GROUP BY ROLLUP (host, content_source)""",
}
