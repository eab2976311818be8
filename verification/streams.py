"""Statements for the streaming queries: the same results as in batch."""

from __future__ import annotations

from verification.blocks_export import FULL
from verification.media_contract import BASE
from verification.prelude import host, titles_cte

SQL = {
    "stream_pages": f"WITH {FULL}, {titles_cte()} SELECT page_id, title, blocks, images, md5(body) AS body_md5 FROM body JOIN titles USING (page_id)",
    "stream_job_progress": f"SELECT {host('url')} AS job_id, count(*) AS done, count(*) FILTER (WHERE page_id % 4 IN (0, 3)) AS succeeded, "
                           "count(*) FILTER (WHERE page_id % 4 IN (1, 2)) AS failed FROM pages GROUP BY 1",
    "stream_event_dedup": "SELECT event_id, user_id, event_type FROM events",
    "stream_new_assets": f"WITH {BASE} SELECT DISTINCT src FROM img",
}
