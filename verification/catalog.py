"""Every DuckDB statement by query name."""

from __future__ import annotations

from verification import blocks_export, discovery, expressions, layout_deep, layout_quality, media_contract, page_content, similar, streams

SQL = {**expressions.SQL, **page_content.SQL, **media_contract.SQL, **blocks_export.SQL,
    **discovery.SQL,
    **layout_quality.SQL, **layout_deep.SQL,
    **similar.SQL, **streams.SQL,
}
