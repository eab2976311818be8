"""Every registered query by name."""

from __future__ import annotations

from pageloom.plans import blocks_export, discovery, expressions, layout_quality, media_contract, page_content, streams

QUERIES = {**expressions.QUERIES, **page_content.QUERIES, **media_contract.QUERIES, **blocks_export.QUERIES,
    **discovery.QUERIES,
    **layout_quality.QUERIES,
    **streams.QUERIES,
}
