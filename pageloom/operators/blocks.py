"""Cleaned rows to blocks: segmentation, markup per block type, and page bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pageloom.functions.html import html_escape
from pageloom.functions.text import strip
from pageloom.operators.nodes import closes, node_depths, opens, so_far
from pageloom.operators.vocab import CONTAINER_TAGS, INLINE_TAGS, TABLE_TAGS

HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
LISTS = ("ul", "ol")
AFTER_HOISTED = 2**62  # order of a container after the images hoisted out of it


# ---------------------------------------------------------------- markup
# The comments, tags and classes of the target editor's blocks.


def paragraph_block(inner: Column) -> Column:
    """Paragraph, '' when blank."""
    markup = F.concat(F.lit("<!-- wp:paragraph -->\n<p>"), inner, F.lit("</p>\n<!-- /wp:paragraph -->"))
    return F.when(F.coalesce(strip(inner), F.lit("")) == "", F.lit("")).otherwise(markup)


def heading_block(level: Column, inner: Column) -> Column:
    """Heading with its level held between 2 and 4, kept even when empty."""
    n = F.greatest(F.least(level, F.lit(4)), F.lit(2)).cast("string")
    return F.concat(
        F.lit('<!-- wp:heading {"level":'), n, F.lit("} -->\n<h"), n, F.lit(">"), inner,
        F.lit("</h"), n, F.lit(">\n<!-- /wp:heading -->"),
    )


def list_item(inner: Column) -> Column:
    return F.concat(F.lit("<!-- wp:list-item -->\n<li>"), inner, F.lit("</li>\n<!-- /wp:list-item -->"))


def list_block(tag: Column, items: Column) -> Column:
    attrs = F.when(tag == "ol", F.lit('{"ordered":true} ')).otherwise("")
    return F.concat(
        F.lit("<!-- wp:list "), attrs, F.lit("-->\n<"), tag, F.lit(' class="wp-block-list">\n'), items,
        F.lit("\n</"), tag, F.lit(">\n<!-- /wp:list -->"),
    )


def quote_block(paragraphs: Column) -> Column:
    return F.concat(
        F.lit('<!-- wp:quote -->\n<blockquote class="wp-block-quote">\n'), paragraphs,
        F.lit("\n</blockquote>\n<!-- /wp:quote -->"),
    )


def code_block(escaped: Column) -> Column:
    return F.concat(
        F.lit('<!-- wp:code -->\n<pre class="wp-block-code"><code>'), escaped,
        F.lit("</code></pre>\n<!-- /wp:code -->"),
    )


def table_block(inner: Column, table_class: str | None = "wp-block-table__table") -> Column:
    """Table in its figure; ``table_class=None`` gives the bare tag that newer editors expect."""
    start = f'<table class="{table_class}">' if table_class else "<table>"
    return F.concat(
        F.lit(f'<!-- wp:table -->\n<figure class="wp-block-table">{start}'), inner,
        F.lit("</table></figure>\n<!-- /wp:table -->"),
    )


def separator_block() -> Column:
    return F.lit('<!-- wp:separator -->\n<hr class="wp-block-separator"/>\n<!-- /wp:separator -->')


def image_block(url: Column, alt: Column, media_id: Column | None = None, escape_url: bool = False) -> Column:
    """Image figure; the address is written as it is unless ``escape_url`` is set."""
    address = html_escape(url) if escape_url else url
    number = F.lit(None).cast("string") if media_id is None else media_id.cast("string")
    attrs = F.when(number.isNotNull(), F.concat(F.lit('{"id":'), number, F.lit(',"sizeSlug":"large"}'))).otherwise("{}")
    css = F.when(number.isNotNull(), F.concat(F.lit(' class="wp-image-'), number, F.lit('"'))).otherwise("")
    return F.concat(
        F.lit("<!-- wp:image "), attrs, F.lit(' -->\n<figure class="wp-block-image size-large"><img src="'), address,
        F.lit('" alt="'), html_escape(F.coalesce(alt, F.lit(""))), F.lit('"'), css,
        F.lit("/></figure>\n<!-- /wp:image -->"),
    )


def image_block_caption(url: Column, alt: Column, caption: Column) -> Column:
    text = F.when(
        F.coalesce(caption, F.lit("")) != "",
        F.concat(F.lit('<figcaption class="wp-element-caption">'), html_escape(caption), F.lit("</figcaption>")),
    ).otherwise("")
    return F.concat(
        F.lit('<!-- wp:image {"sizeSlug":"large"} -->\n<figure class="wp-block-image size-large"><img src="'),
        html_escape(url), F.lit('" alt="'), html_escape(F.coalesce(alt, F.lit(""))), F.lit('"/>'), text,
        F.lit("</figure>\n<!-- /wp:image -->"),
    )


# ---------------------------------------------------------------- segmentation


def segment_rows(cleaned: DataFrame) -> DataFrame:
    """Number blocks and list items on cleaned rows.

    Adds ``block_id`` (top-level element or bare text run), ``sub`` (orders hoisted images before
    their container), ``block_tag`` on the row that starts a block, ``context`` (enclosing
    container or ''), ``item_id`` (list item or quote paragraph, 0 outside) and ``outer`` (the
    block's or item's own tag).
    """
    flow = ("p", *HEADINGS)
    no = F.lit(False)
    rows = node_depths(cleaned, {"_deep": CONTAINER_TAGS}, _unit=F.sum(F.when(_ends_unit(), 1).otherwise(0)).over(so_far()))
    top = F.col("_deep") == 0
    top_open = (opens(*flow) & top) | (opens(*CONTAINER_TAGS) & (F.col("_deep") == 1))
    top_close = closes(*flow, *CONTAINER_TAGS) & top
    single = F.coalesce(
        top & (((F.col("kind") == "void") & (F.col("tag") == "hr")) | F.col("kind").isin("image", "break")), no
    )
    rows = rows.withColumns({
        "_starts": F.coalesce(top_open, no) | single, "_ends": F.coalesce(top_close, no) | single,
    })
    ends = F.when(F.col("_ends"), 1).otherwise(0)
    bumps = F.when(F.col("_starts"), 1).otherwise(0) + ends
    rows = rows.withColumns({
        "block_id": (F.sum(bumps).over(so_far()) - ends).cast("bigint"),
        "_container": F.last(F.when(F.col("_starts"), F.col("tag")), ignorenulls=True).over(so_far()),
    })
    deep = F.col("_deep") > 0
    rows = rows.withColumn("context", F.when(deep, F.col("_container")).otherwise(""))
    in_list = F.col("context").isin(*LISTS) & (F.col("tag") == "li")
    in_quote = (F.col("context") == "blockquote") & (F.col("tag") == "p")
    mark = (F.col("_deep") == 1) & (in_list | in_quote)
    item_open, item_close = mark & (F.col("kind") == "open"), mark & (F.col("kind") == "close")
    state = F.when(item_open, 1).when(F.col("_starts") | item_close | F.col("_ends"), 0)
    rows = rows.withColumns({
        "_count": F.sum(F.when(item_open, 1).otherwise(0)).over(so_far()),
        "_state": F.coalesce(F.last(state, ignorenulls=True).over(so_far()), F.lit(0)),
    })
    hoisted = (F.col("kind") == "image") & deep
    return rows.withColumns({
        "item_id": F.when((F.col("_state") == 1) & deep, F.col("_count")).otherwise(0).cast("bigint"),
        "outer": F.col("_starts") | F.col("_ends") | item_open | item_close,
        "sub": F.when(hoisted, F.col("pos")).otherwise(F.lit(AFTER_HOISTED)).cast("bigint"),
        "block_tag": F.when(F.col("kind") == "image", F.lit("image"))
        .when(F.col("_starts") & (F.col("kind") == "break"), F.lit("break"))
        .when(F.col("_starts"), F.col("tag")),
    }).drop("_deep", "_ends", "_starts", "_container", "_count", "_state")


def _inline() -> Column:
    return F.col("kind").isin("open", "close", "void") & F.col("tag").isin(*INLINE_TAGS)


def _ends_unit() -> Column:
    """A tag, image or break that inline markup may not cross."""
    return F.col("kind").isNotNull() & (F.col("kind") != "text") & ~_inline()


def balance_inline(segmented: DataFrame) -> DataFrame:
    """Rows with ``piece`` and its order ``(k1, k2, k3)``; inline tags are balanced per text unit.

    A unit ends at the next tag that is not inline. Closes without an open are dropped; an open
    without a close gets one at the end of its unit.
    """
    inline = _inline()
    step = F.when(inline & (F.col("kind") == "open"), 1).when(inline & (F.col("kind") == "close"), -1).otherwise(0)
    by_tag = Window.partitionBy("page_id", "_unit", "tag").orderBy("pos")
    rows = segmented.withColumn("_total", F.sum(step).over(
        by_tag.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    lowest = F.least(F.lit(0), F.coalesce(F.min("_total").over(by_tag.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # Opens and closes of one level alternate; a stray close gets no level.
    level = F.when(step == 1, F.col("_total") - F.col("_lowest")).when(
        (step == -1) & (F.col("_total") >= F.col("_lowest")), F.col("_total") - F.col("_lowest") + 1)
    rows = rows.withColumn("_lowest", lowest).withColumn("_level", level)
    by_level = Window.partitionBy("page_id", "_unit", "tag", "_level").orderBy("pos")
    rows = rows.withColumn("_closed", F.lead("kind").over(by_level) == "close")
    stray = (step == -1) & F.col("_level").isNull()
    inline_context = F.col("context").isin("", *LISTS, "blockquote")
    kept = (
        F.when(F.col("outer"), F.lit(None))
        .when((F.col("kind") == "text") & (F.col("context") == "pre"),
              F.replace(F.replace("tok", F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#x27;")))
        .when(F.col("kind") == "text", F.col("tok"))
        .when(inline & inline_context & ~stray, F.col("tok"))
        .when((F.col("context") == "table") & F.col("kind").isin("open", "close") & F.col("tag").isin(*TABLE_TAGS),
              F.col("tok"))
    )
    dangling = (step == 1) & inline_context & ~F.coalesce(F.col("_closed"), F.lit(False))
    own = F.struct(F.col("_unit").alias("k1"), F.lit(0).alias("k2"), F.col("pos").alias("k3"), kept.alias("piece"))
    closer = F.struct(F.col("_unit").alias("k1"), F.lit(1).alias("k2"), (-F.col("pos")).alias("k3"),
                      F.concat(F.lit("</"), F.col("tag"), F.lit(">")).alias("piece"))
    pieces = F.when(dangling, F.array(own, closer)).otherwise(F.array(own))
    return rows.withColumn("_p", F.explode(pieces)).select(*segmented.columns, "_p.*").drop("_unit")


def block_rows(cleaned: DataFrame, table_class: str | None = "wp-block-table__table",
               escape_url: bool = False, carry: tuple[str, ...] = ("url",)) -> DataFrame:
    """``(page_id, *carry, block_id, sub, block_type, level, inner_html, markup, img_index)``, empties included.

    Every page has at least one row, so pages without content stay visible to the outcome stage. Images with a ``caption`` get it;
    rows of kind ``image`` with an ``insert`` (see :func:`pageloom.operators.layout.insert_rows`) become that block, of type ``insert_type``.
    """
    return rendered_blocks(balance_inline(segment_rows(cleaned)), table_class, escape_url, carry)


def rendered_blocks(balanced: DataFrame, table_class: str | None = "wp-block-table__table",
                    escape_url: bool = False, carry: tuple[str, ...] = ("url",)) -> DataFrame:
    """:func:`block_rows` from rows that :func:`balance_inline` gave."""
    rows = balanced
    extra = [c for c in ("caption", "insert", "insert_type") if c in rows.columns]
    if "media_url" not in rows.columns:
        rows = rows.withColumn("media_url", F.col("src")).withColumn("media_id", F.lit(None).cast("bigint"))
    text = F.coalesce(F.expr("listagg(piece, '') within group (order by k1, k2, k3)"), F.lit(""))
    # A block's tag is on its first row; inside a container it is also the context.
    tag_here = F.coalesce("block_tag", F.when(F.col("context") != "", F.col("context")))
    items = rows.withColumn("_tag", tag_here).groupBy("page_id", *carry, "block_id", "sub", "item_id").agg(
        F.max("_tag").alias("tag"), text.alias("inner"), F.max("img_index").alias("img_index"),
        F.max("media_url").alias("media_url"), F.max("media_id").alias("media_id"), F.max("alt").alias("alt"),
        *[F.max(F.when(F.col("kind") == "image", F.col(c))).alias(c) for c in extra],
    )
    item = F.when(F.col("item_id") > 0, F.when(F.col("tag").isin(*LISTS), list_item(strip(F.col("inner"))))
                  .when(F.col("tag") == "blockquote", paragraph_block(strip(F.col("inner")))))
    items = items.withColumn("_item", F.when(item != "", item))
    blocks = items.groupBy("page_id", *carry, "block_id", "sub").agg(
        F.max("tag").alias("tag"),
        F.coalesce(F.max(F.when(F.col("item_id") == 0, F.col("inner"))), F.lit("")).alias("inner"),
        F.expr("listagg(_item, '\\n') within group (order by item_id)").alias("_items"),
        F.max("item_id").alias("_last_item"),
        F.max("img_index").alias("img_index"), F.max("media_url").alias("media_url"),
        F.max("media_id").alias("media_id"), F.max("alt").alias("alt"), *[F.max(c).alias(c) for c in extra],
    )
    tag, inner = F.coalesce("tag", F.lit("text")), strip(F.col("inner"))
    level = F.when(tag.isin(*HEADINGS), F.least(F.greatest(F.substring(tag, 2, 1).try_cast("int"), F.lit(2)), F.lit(4)))
    items_text = F.coalesce("_items", F.lit(""))
    quoted = F.when(F.col("_last_item") > 0, items_text).otherwise(paragraph_block(inner))
    kind = (
        F.when(tag.isin(*HEADINGS), F.lit("heading")).when(tag.isin(*LISTS), F.lit("list"))
        .when(tag == "blockquote", F.lit("quote")).when(tag == "pre", F.lit("code"))
        .when(tag == "table", F.lit("table")).when(tag == "hr", F.lit("separator"))
        .when(tag == "image", F.lit("image")).otherwise(F.lit("paragraph"))
    )
    image = image_block(F.col("media_url"), F.col("alt"), F.col("media_id"), escape_url)
    if "caption" in extra:
        captioned = image_block_caption(F.col("media_url"), F.col("alt"), F.col("caption"))
        image = F.when(F.coalesce("caption", F.lit("")) != "", captioned).otherwise(image)
    if "insert" in extra:
        kind, image = F.coalesce("insert_type", kind), F.coalesce("insert", image)
    markup = (
        F.when(tag.isin(*HEADINGS), heading_block(level, inner))
        .when(tag.isin(*LISTS), list_block(tag, items_text))
        .when(tag == "blockquote", quote_block(quoted))
        .when(tag == "pre", code_block(F.col("inner")))
        .when(tag == "table", table_block(F.col("inner"), table_class))
        .when(tag == "hr", separator_block())
        .when(tag == "image", image)
        .when(tag == "break", F.lit(""))
        .otherwise(paragraph_block(inner))
    )
    return blocks.select(
        "page_id", *carry, "block_id", "sub", kind.alias("block_type"), level.cast("bigint").alias("level"),
        F.when(tag.isin(*LISTS, "blockquote"), items_text).otherwise(inner).alias("inner_html"),
        markup.alias("markup"), "img_index",
    )


def segment_blocks(rows: DataFrame) -> DataFrame:
    """``(page_id, block_pos, block_type, level, inner_html, markup)`` of the non-blank blocks."""
    order = Window.partitionBy("page_id").orderBy("block_id", "sub")
    return rows.filter(F.col("markup") != "").select(
        "page_id", F.row_number().over(order).cast("bigint").alias("block_pos"), "block_type", "level", "inner_html", "markup"
    )


def join_blocks(rows: DataFrame, carry: tuple[str, ...] = ("url",)) -> DataFrame:
    """``(page_id, *carry, body, blocks, images)``: blocks joined by a blank line; '' for an empty page."""
    filled = rows.withColumn("_m", F.when(F.col("markup") != "", F.col("markup")))
    return filled.groupBy("page_id", *carry).agg(
        F.coalesce(F.expr("listagg(_m, '\\n\\n') within group (order by block_id, sub)"), F.lit("")).alias("body"),
        F.count("_m").alias("blocks"), F.count("img_index").alias("images"),
    )


def block_stats(blocks: DataFrame, hosts: DataFrame) -> DataFrame:
    """``(host, block_type, blocks, pages)`` with subtotals per host and overall (NULL keys)."""
    per_page = blocks.groupBy("page_id", "block_type").agg(F.count("*").alias("_n")).join(hosts, "page_id")
    detail = per_page.groupBy("host", "block_type").agg(F.sum("_n").alias("_n"), F.count("*").alias("_p"))
    return detail.rollup("host", "block_type").agg(F.sum("_n").alias("blocks"), F.sum("_p").alias("page_types"))
