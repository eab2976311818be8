"""The whole migration as stages: raw pages to titled, block-marked pages with an outcome."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pageloom.operators.blocks import balance_inline, block_rows, join_blocks, rendered_blocks, segment_rows
from pageloom.operators.content import content_nodes
from pageloom.operators.contract import (
    clean_rows, drop_boilerplate, final_gate, ingest_cleaned, restore_lost_tokens, token_integrity, token_order,
)
from pageloom.operators.layout import MARKS, cleaned_blocks, insert_rows, mark_columns, place_blocks, with_nested_lists
from pageloom.operators.media import index_images, plan_media
from pageloom.operators.nodes import by_page, whole_page
from pageloom.operators.titles import page_titles
from pageloom.session import materialize

NO_CONTENT = "no main content extracted"
EMPTY = "empty after conversion"
CARRY = ("url", "content_source", "has_content")


def extracted_rows(pages: DataFrame, selectors: DataFrame | None = None, css: str | None = None,
                   prune: bool = False, boilerplate: bool = True, captions: bool = False, partitioned: bool = False) -> DataFrame:
    """Content rows with numbered images and ``has_content`` per page.

    ``prune`` leaves out scripts and comments, which only the raw export keeps. Without ``boilerplate``, containers
    that announce something else than the article go with all they hold. ``captions`` keeps a figure's caption with its
    image. ``partitioned`` as in :func:`html_nodes`.
    """
    content = content_nodes(pages, selectors, css, prune=prune, partitioned=partitioned)
    if not boilerplate:
        content = drop_boilerplate(content)
    return flag_solid(index_images(content, extended=captions))


def flag_solid(rows: DataFrame) -> DataFrame:
    """Add ``has_content``: the page has a tag, an image or text that is not blank."""
    solid = F.col("kind").isin("open", "close", "void", "image") | (
        (F.col("kind") == "text") & F.col("tok").rlike(r"(?U)\S")
    )
    return rows.withColumn("has_content", F.max(F.coalesce(solid, F.lit(False))).over(whole_page()))


def convert_pages(pages: DataFrame, selectors: DataFrame | None = None, css: str | None = None,
                  mode: str = "remote", results: DataFrame | None = None,
                  table_class: str | None = "wp-block-table__table", boilerplate: bool = True,
                  partitioned: bool = False) -> DataFrame:
    """``(page_id, url, title, content_source, body, blocks, images, status, message)``, one row per page.

    ``boilerplate=False`` removes share bars, related posts, sign-ups and the like by class or id, at the price of one
    more sort of the nodes. ``partitioned`` is for pages bucketed by ``page_id``. Everything after the one exchange by ``page_id`` works on that partitioning; only upload and
    bundle modes add a join on the image source. A page that goes wrong becomes a row with a
    status, never an error.
    """
    rows = extracted_rows(pages, selectors, css, prune=True, boilerplate=boilerplate, partitioned=partitioned)
    if mode in ("upload", "bundle"):
        images = rows.filter("kind = 'image'")
        # One map of images per page, so that the node rows keep their partitioning by page.
        entry = F.struct("img_index", F.struct(F.col("url").alias("media_url"), "media_id"))
        media = plan_media(images, mode, results).groupBy("page_id").agg(F.map_from_entries(F.collect_list(entry)).alias("_media"))
        found = F.when(F.col("kind") == "image", F.element_at("_media", F.col("img_index")))
        rows = rows.join(media, "page_id", "left").withColumns(
            {"media_url": found["media_url"], "media_id": found["media_id"]}).drop("_media")
    return _outcomes(join_blocks(block_rows(clean_rows(rows), table_class, carry=CARRY), CARRY), pages, partitioned)


def _outcomes(bodies: DataFrame, pages: DataFrame, partitioned: bool) -> DataFrame:
    """Bodies with titles, a status and a message."""
    titles = page_titles(pages, partitioned=partitioned).select("page_id", "title")
    status = F.when(F.col("has_content") & (F.col("body") != ""), F.lit("ok")).otherwise("skipped")
    message = F.when(~F.col("has_content"), F.lit(NO_CONTENT)).when(F.col("body") == "", F.lit(EMPTY))
    return bodies.join(titles, "page_id").select(
        "page_id", "url", "title", "content_source", "body", "blocks", "images",
        status.alias("status"), message.alias("message"),
    )


def convert_pages_layout(pages: DataFrame, selectors: DataFrame | None = None, css: str | None = None,
                         table_class: str | None = "wp-block-table__table", boilerplate: bool = True,
                         partitioned: bool = False) -> DataFrame:
    """:func:`convert_pages` (``remote`` images) that keeps the layout, with everything at its place in the page.

    Lists stay nested, side-by-side containers become columns with their blocks, runs of images galleries, figures keep their
    captions, frames of known providers embeds and links styled as buttons buttons; forms, maps, widgets and unknown frames leave a
    visible placeholder. The balanced node rows are written out, as blocks and nested lists both read them, and so are the blocks, which
    are counted and placed.
    """
    content = content_nodes(pages, selectors, css, prune=True, partitioned=partitioned)
    if not boilerplate:
        content = drop_boilerplate(content)
    rows = mark_columns(flag_solid(index_images(insert_rows(content), extended=True)))
    # Dealt by page again, once per reader: aggregates, windows and the join of both then need no exchange of their own.
    balanced = by_page(materialize(balance_inline(segment_rows(clean_rows(rows)))))
    blocks = materialize(with_nested_lists(rendered_blocks(balanced, table_class, carry=(*CARRY, *MARKS)), balanced))
    counted = blocks.groupBy("page_id", *CARRY).agg(
        F.count(F.when(F.col("markup") != "", 1)).alias("blocks"), F.count("img_index").alias("images"))
    bodies = counted.join(place_blocks(blocks, galleries=True).withColumnRenamed("markup", "body"), "page_id", "left").withColumn(
        "body", F.coalesce("body", F.lit("")))
    return _outcomes(bodies, pages, partitioned)


def convert_cleaned(pages: DataFrame, cleaned: DataFrame, media: DataFrame) -> DataFrame:
    """``(page_id, url, title, body, blocks, images, status, message)`` from an outside cleaner's HTML.

    ``cleaned(page_id, html, refused)`` carries image tokens, ``media(page_id, img_index, url,
    media_id, alt)`` what they stand for. A page that was refused or is missing has failed, and so has one whose
    tokens came out more than once, were never there, or could not be placed. Lost tokens are put back at the end of the
    page; that, and tokens out of order, is said in the message of a page that is ok.
    """
    taken = materialize(ingest_cleaned(pages, cleaned))  # both are read by every check
    media = materialize(media.select("page_id", "img_index", "url", "media_id", "alt"))
    kept = taken.filter("status = 'ok'")
    restored = restore_lost_tokens(media.join(kept, "page_id", "left_semi"), kept)
    found = token_integrity(media.join(kept, "page_id", "left_semi"), kept).groupBy("page_id").agg(
        F.count_if(F.col("problem") == "duplicated").alias("_twice"), F.count_if(F.col("problem") == "unknown").alias("_unknown"))
    moved = token_order(kept).groupBy("page_id").agg(F.count("*").alias("_moved"))
    taken = taken.drop("html").join(restored, "page_id", "left").join(found, "page_id", "left").join(moved, "page_id", "left")

    def told(count: str, what: str):
        return F.when(F.col(count) > 0, F.concat(F.col(count).cast("string"), F.lit(f" image token(s) {what}")))

    broken = F.coalesce(F.col("_twice") + F.col("_unknown") > 0, F.lit(False))
    taken = materialize(taken.select(
        "page_id", "html", F.when(broken, F.lit("failed")).otherwise(F.col("status")).alias("status"),
        F.coalesce("message", F.nullif(F.concat_ws("; ", told("_twice", "repeated"), told("_unknown", "unknown"),
                                                   told("restored", "lost, put at the end"), told("_moved", "out of order")), F.lit(""))).alias("message")))
    html = pages.select("page_id", "url").join(taken, "page_id")
    rows = cleaned_blocks(html.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")), media)
    filled = rows.withColumn("_m", F.when(F.col("markup") != "", F.col("markup")))
    bodies = filled.groupBy("page_id").agg(
        F.coalesce(F.expr("listagg(_m, '\\n\\n') within group (order by block_id, sub, n)"), F.lit("")).alias("body"),
        F.count("_m").alias("blocks"),
    )
    # All images of the page count, those whose token was lost too, as attachments number them all.
    bodies = bodies.join(media.groupBy("page_id").agg(F.count("*").alias("images")), "page_id", "left")
    titles = page_titles(pages).select("page_id", "title")
    empty = (F.col("status") == "ok") & (F.coalesce("body", F.lit("")) == "")
    bodies = materialize(bodies)
    gate = final_gate(bodies.select("page_id", F.col("body").alias("html"))).filter(
        F.col("message") == "image token left in output").select("page_id", F.lit(True).alias("_leaked"))
    done = html.drop("html").join(bodies, "page_id", "left").join(gate, "page_id", "left")
    leaked = (F.col("status") == "ok") & F.coalesce("_leaked", F.lit(False))
    done = done.withColumns({
        "status": F.when(leaked, F.lit("failed")).otherwise(F.col("status")),
        "message": F.when(leaked, F.lit("image token left in output")).otherwise(F.col("message")),
        "images": F.when(F.col("status") == "ok", F.col("images")),
    })
    return done.join(titles, "page_id").select(
        "page_id", "url", "title", F.coalesce("body", F.lit("")).alias("body"),
        F.coalesce("blocks", F.lit(0)).alias("blocks"), F.coalesce("images", F.lit(0)).alias("images"),
        F.when(empty, F.lit("skipped")).otherwise(F.col("status")).alias("status"),
        F.when(empty, F.lit(EMPTY)).otherwise(F.col("message")).alias("message"),
    )
