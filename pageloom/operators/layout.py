"""Blocks beyond the whitelist: nested lists, embeds, galleries, columns, buttons, flattened tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pageloom.functions.html import attribute_of, decode_known, escape_text, html_escape
from pageloom.functions.text import collapse_ws, strip
from pageloom.functions.urls import resolve_url
from pageloom.operators.blocks import (
    AFTER_HOISTED, LISTS, balance_inline, block_rows, image_block, paragraph_block, segment_rows,
)
from pageloom.operators.content import links
from pageloom.operators.contract import clean_rows
from pageloom.operators.media import TOKEN_PATTERN
from pageloom.operators.nodes import before, closes, element_extents, html_nodes, node_depths, opens, so_far
from pageloom.operators.quality import attention_reason, placeholder_text
from pageloom.operators.tree import container_levels, render_nested
from pageloom.operators.vocab import CONTAINER_TAGS, EMBED_PROVIDERS


def _flattened(segmented: DataFrame, media: DataFrame) -> DataFrame:
    """``(page_id, block_id, sub, n, img_index, block_type, markup)`` of the blocks that hold image tokens."""
    texts = segmented.filter("kind = 'text'").withColumn("_text", decode_known(F.col("tok"))).groupBy(
        "page_id", "block_id", "sub"
    ).agg(F.expr("listagg(_text, ' ') within group (order by pos)").alias("_text")).filter(
        F.col("_text").rlike(TOKEN_PATTERN)
    )
    cut = F.regexp_extract_all("_text", F.lit(r"⟦IMG_\d+⟧|(?:[^⟦]++|⟦(?!IMG_\d+⟧))++"), F.lit(0))
    index = F.regexp_extract("_piece", "^" + TOKEN_PATTERN + "$", 1)
    pieces = texts.select("page_id", "block_id", "sub", F.posexplode(cut).alias("n", "_piece")).withColumn(
        "img_index", F.when(index != "", index.try_cast("bigint"))
    )
    placed = pieces.join(media.select("page_id", "img_index", "url", "media_id", "alt"), ["page_id", "img_index"], "left")
    is_image = F.col("img_index").isNotNull()
    markup = F.when(is_image & F.col("url").isNotNull(), image_block(F.col("url"), F.col("alt"), F.col("media_id"))).when(
        ~is_image, paragraph_block(html_escape(collapse_ws(F.col("_piece"))))
    )
    return placed.withColumn("markup", markup).filter(F.coalesce("markup", F.lit("")) != "").select(
        "page_id", "block_id", "sub", "n", "img_index",
        F.when(is_image, F.lit("image")).otherwise("paragraph").alias("block_type"), "markup",
    )


def flatten_token_elements(nodes: DataFrame, media: DataFrame) -> DataFrame:
    """``(page_id, block_pos, block_type, markup)`` of elements that still hold image tokens.

    Such an element is layout: its text becomes escaped paragraphs and its tokens image blocks,
    in order. Tokens without media drop out. ``nodes`` is the node table of cleaned HTML.
    """
    segmented = segment_rows(nodes.filter(F.coalesce(F.col("kind"), F.lit("")).isin("open", "close", "void", "text")))
    order = Window.partitionBy("page_id").orderBy("block_id", "sub", "n")
    return _flattened(segmented, media).select(
        "page_id", F.row_number().over(order).cast("bigint").alias("block_pos"), "block_type", "markup"
    )


def cleaned_blocks(cleaned: DataFrame, media: DataFrame) -> DataFrame:
    """``(page_id, block_id, sub, n, img_index, block_type, markup)`` from cleaned HTML ``(page_id, url, html)``.

    Elements with image tokens are flattened, all others become their block. ``media`` is
    ``(page_id, img_index, url, media_id, alt)``. Empty pages keep a row with empty markup.
    """
    none = {c: F.lit(None).cast(t) for c, t in (("img_index", "bigint"), ("src", "string"), ("alt", "string"))}
    rows = clean_rows(html_nodes(cleaned, prune=True).withColumns(none))
    plain = block_rows(rows).filter(~F.col("markup").rlike(TOKEN_PATTERN)).select(
        "page_id", "block_id", "sub", F.lit(0).alias("n"), F.lit(None).cast("bigint").alias("img_index"),
        "block_type", "markup",
    )
    return plain.unionByName(_flattened(segment_rows(rows), media))


# Markup of the target editor's list, embed, gallery, column and button blocks, here and below.
_ITEM_OPEN, _ITEM_CLOSE = "<!-- wp:list-item -->\n<li>", "</li>\n<!-- /wp:list-item -->"


def nested_lists(segmented: DataFrame) -> DataFrame:
    """``(page_id, block_id, markup)`` of every outermost list, with the lists inside its items as blocks at any depth.

    ``segmented`` comes from :func:`balance_inline`. An item runs to the next item of its list or to the list's end, so
    missing closing tags do no harm; text or a list before the first item gets an item of its own. A list runs to the end of
    its block when it is not closed. Images have left the list before (they stand in front of its block).
    """
    rows = segmented.filter(F.col("context").isin(*LISTS) & (F.col("sub") == AFTER_HOISTED)).withColumn(
        "pos", F.struct("k1", "k2", "k3"))
    tag = F.col("tag")
    own = F.coalesce(F.col("k2") == 0, F.lit(False))
    opening, closing = own & opens(*LISTS), own & closes(*LISTS)
    # The closing row of the outermost list is no longer in its context; what is open at the last row ends there.
    rows = container_levels(rows, opening, closing, "level", ("page_id", "block_id"))
    last = F.lead("pos").over(Window.partitionBy("page_id", "block_id").orderBy("pos")).isNull()
    rows = rows.withColumns({"_opens": opening, "_item": own & opens("li"), "_last": last})
    # Runs of text of one item: they end where an item or a nested list starts or ends.
    border = F.col("_opens") | F.col("_item") | F.col("level_closes").isNotNull()
    rows = rows.withColumn("_run", F.sum(F.when(F.coalesce(border, F.lit(False)), 1).otherwise(0)).over(
        Window.partitionBy("page_id", "block_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    keys = ["page_id", "block_id"]
    texts = rows.filter("level > 0").groupBy(*keys, "_run", "level").agg(
        F.max("pos").alias("pos"), strip(F.coalesce(F.expr("listagg(piece, '') within group (order by pos)"), F.lit(""))).alias("markup")
    ).filter("markup <> ''").select(
        *keys, F.struct("pos", F.lit(9).alias("n"), F.lit(0).cast("bigint").alias("l")).alias("at"), "level", F.lit("part").alias("role"), "markup",
        F.lit(None).cast("string").alias("closing"))

    def event(n: int, level: Column, role: str, markup: Column | str = "", end: Column | None = None) -> Column:
        return F.struct(
            F.struct(F.col("pos"), F.lit(n).alias("n"), F.lit(0).cast("bigint").alias("l")).alias("at"), level.cast("bigint").alias("level"), F.lit(role).alias("role"),
            (F.lit(markup) if isinstance(markup, str) else markup).alias("markup"),
            (F.lit(None).cast("string") if end is None else end).alias("closing"))

    level = F.col("level")
    start = F.concat(F.lit("<!-- wp:list "), F.when(tag == "ol", F.lit('{"ordered":true} ')).otherwise(""), F.lit("-->\n<"), tag,
                     F.lit(' class="wp-block-list">\n'))
    end = F.concat(F.lit("\n</"), tag, F.lit(">\n<!-- /wp:list -->"))
    one = F.lit(1).cast("bigint")
    left_open = F.transform(F.sequence(F.greatest(level, one), one, -one), lambda k: F.struct(
        F.struct(F.col("pos"), F.lit(99).alias("n"), (-k).alias("l")).alias("at"), k.alias("level"), F.lit("outer_end").alias("role"),
        F.lit("").alias("markup"), F.lit(None).cast("string").alias("closing")))
    nothing = F.array().cast(left_open_type())
    events = F.flatten(F.array(
        F.when(F.col("_opens") & (level > 1), F.array(event(0, level - 1, "part"))).otherwise(nothing),
        F.when(F.col("_opens"), F.array(event(1, level, "outer", start, end))).otherwise(nothing),
        F.when(F.col("_item"), F.array(event(2, level, "inner", _ITEM_OPEN))).otherwise(nothing),
        F.when(F.col("level_closes").isNotNull(), F.array(event(3, F.col("level_closes"), "outer_end"))).otherwise(nothing),
        F.when(F.col("_last") & (level > 0), left_open).otherwise(nothing),
    ))
    marks = rows.filter(border | F.col("_last")).select(*keys, F.explode(events).alias("e")).select(*keys, "e.*")
    return render_nested(marks.unionByName(texts), keys, _ITEM_OPEN, _ITEM_CLOSE, "\n", "\n")


def left_open_type() -> str:
    """Type of the events of :func:`nested_lists`."""
    place = "struct<pos:struct<k1:bigint,k2:int,k3:bigint>,n:int,l:bigint>"
    return f"array<struct<at:{place},level:bigint,role:string,markup:string,closing:string>>"


def nested_list_block(cleaned: DataFrame) -> DataFrame:
    """``(page_id, list_no, markup)``: outermost lists in order, lists inside list items kept as list blocks at any depth.

    ``cleaned`` holds whitelisted rows with their final text.
    """
    order = Window.partitionBy("page_id").orderBy("block_id")
    return nested_lists(balance_inline(segment_rows(cleaned))).select(
        "page_id", F.row_number().over(order).cast("bigint").alias("list_no"), "markup")


def _provider(url: Column, field: int) -> Column:
    value = F.lit(None).cast("string")
    for provider in reversed(EMBED_PROVIDERS):
        value = F.when(url.rlike(provider[2]), F.lit(provider[field])).otherwise(value)
    return value


def embed_markup(url: Column) -> Column:
    """Embed of an address of a known provider; NULL for any other."""
    kind, provider = _provider(url, 1), _provider(url, 0)
    return F.concat(
        F.lit('<!-- wp:embed {"url":"'), url, F.lit('","type":"'), kind,
        F.lit('","providerNameSlug":"'), provider, F.lit('","responsive":true} --><figure class="wp-block-embed is-type-'),
        kind, F.lit('"><div class="wp-block-embed__wrapper">'), escape_text(url),
        F.lit("</div></figure><!-- /wp:embed -->"),
    )


def embed_block(nodes: DataFrame) -> DataFrame:
    """``(page_id, pos, provider, url, markup)`` of frames and bare links to known providers."""
    frames = nodes.filter(opens("iframe")).select(
        "page_id", "pos", resolve_url(F.col("url"), attribute_of(F.col("tok"), "src")).alias("_to")
    )
    # A bare link shows its own address as text.
    text_next = F.lead(F.when(F.col("kind") == "text", strip(decode_known(F.col("tok"))))).over(
        Window.partitionBy("page_id").orderBy("pos"))
    bare = nodes.withColumn("_next", text_next).filter(opens("a")).select(
        "page_id", "pos", attribute_of(F.col("tok"), "href").alias("_to"), "_next"
    ).filter("_to = _next").drop("_next")
    rows = frames.unionByName(bare).select(
        "page_id", "pos", _provider(F.col("_to"), 0).alias("provider"), F.col("_to").alias("url"), embed_markup(F.col("_to")).alias("markup"))
    return rows.filter(F.col("provider").isNotNull())


def gallery_markup(images: Column, inner: Column, max_columns: int = 3) -> Column:
    n = F.least(images, F.lit(max_columns)).cast("string")
    return F.concat(
        F.lit('<!-- wp:gallery {"columns":'), n,
        F.lit(',"linkTo":"none"} --><figure class="wp-block-gallery has-nested-images columns-'), n,
        F.lit('">\n'), inner, F.lit("\n</figure><!-- /wp:gallery -->"),
    )


def gallery_block(blocks: DataFrame, max_columns: int = 3) -> DataFrame:
    """``(page_id, first_pos, images, columns, markup)`` of runs of two or more adjacent image blocks."""
    order = Window.partitionBy("page_id").orderBy("block_pos")
    images = blocks.filter(F.col("block_type") == "image").withColumn(
        "_island", F.col("block_pos") - F.row_number().over(order)
    )
    runs = images.groupBy("page_id", "_island").agg(
        F.min("block_pos").alias("first_pos"), F.count("*").alias("images"),
        F.expr("listagg(markup, '\\n') within group (order by block_pos)").alias("_inner"),
    ).filter(F.col("images") > 1)
    columns = F.least(F.col("images"), F.lit(max_columns)).cast("bigint")
    return runs.select(
        "page_id", "first_pos", "images", columns.alias("columns"),
        gallery_markup(F.col("images"), F.col("_inner"), max_columns).alias("markup"))


COLUMNS_CLASS = r"(^|\s)(columns|row|wp-block-columns)($|\s)"
COLUMN_CLASS = r"(^|\s)(column|col|col-[0-9]+|wp-block-column)($|\s)"
_COLUMN_CLOSE = "\n</div><!-- /wp:column -->"
_COLUMNS = ('<!-- wp:columns --><div class="wp-block-columns">\n', "\n</div><!-- /wp:columns -->")


def _column_open(css_class: Column) -> Column:
    """Start of a column; a ``col-N`` class gives its width in twelfths."""
    twelfths = F.regexp_extract(css_class, r"(?:^|\s)col-([0-9]+)", 1)
    hundredths = F.floor(twelfths.try_cast("int") * 10_000 / 12)
    percent = F.concat(F.regexp_replace(F.format_number(hundredths / 100, 2), r"\.?0+$", ""), F.lit("%"))
    width = F.when(twelfths != "", percent)
    return F.concat(
        F.lit("<!-- wp:column "), F.coalesce(F.concat(F.lit('{"width":"'), width, F.lit('"} ')), F.lit("")),
        F.lit('--><div class="wp-block-column"'), F.coalesce(F.concat(F.lit(' style="flex-basis:'), width, F.lit('"')), F.lit("")), F.lit(">\n"),
    )


MARKS = ("mark", "mark_class")


def mark_columns(nodes: DataFrame) -> DataFrame:
    """Add ``mark`` and ``mark_class`` where containers that may be columns open and close.

    ``mark`` is ``+w`` and ``-w`` at the start and end of a container with a class of wrappers, ``+c`` and ``-c`` for one of columns. Containers
    inside lists, tables, quotes and preformatted text stay unmarked.
    """
    boxes = ("div", "section")
    rows = node_depths(nodes, {"_deep": CONTAINER_TAGS})
    flow = F.col("_deep") == 0
    css = F.coalesce(attribute_of(F.col("tok"), "class"), F.lit(""))
    rows = container_levels(rows.withColumn("_css", F.when(opens(*boxes), css)), opens(*boxes) & flow, closes(*boxes) & flow, "_box")
    opening = opens(*boxes) & flow
    level = F.coalesce(F.when(opening, F.col("_box")), F.col("_box_closes"))
    rows = rows.withColumns({"_at_level": level, "_kind": F.when(opening, F.when(
        F.col("_css").rlike(COLUMNS_CLASS), "w").when(F.col("_css").rlike(COLUMN_CLASS), "c"))})
    # Starts and ends of one level alternate, so an end has its start before it.
    started = F.lag("_kind").over(Window.partitionBy("page_id", "_at_level").orderBy("pos"))
    rows = rows.withColumn("_ended", F.when(F.col("_box_closes").isNotNull(), started))
    mark = F.coalesce(F.concat(F.lit("+"), "_kind"), F.concat(F.lit("-"), "_ended"))
    return rows.withColumns({"mark": mark, "mark_class": F.when(F.col("_kind").isNotNull(), F.col("_css"))}).drop(
        "_deep", "_css", "_box", "_box_closes", "_at_level", "_kind", "_ended")


def _valid_marks(blocks: DataFrame) -> DataFrame:
    """Drop the marks that make no columns: a column outside a wrapper, a wrapper without columns. Rows with neither mark nor markup go, too.

    ``blocks`` has ``page_id``, ``at``, ``mark`` and ``markup``. A start takes part on its own level and, as a child, on the level of what it lies in.
    """
    starts, ends = F.coalesce(F.col("mark").startswith("+"), F.lit(False)), F.coalesce(F.col("mark").startswith("-"), F.lit(False))
    rows = container_levels(blocks, starts, ends, "_m", at="at")
    level = F.coalesce(F.when(starts, F.col("_m")), F.col("_m_closes"))
    # Empty rows are no part of any row's place. They go behind a window, as a filter before it would work out every markup twice.
    rows = rows.filter("mark is not null or markup <> ''").filter(~ends | F.col("_m_closes").isNotNull()).withColumn("_level", level)
    views = F.when(starts, F.array(F.col("_level"), F.col("_level") - 1)).otherwise(F.array("_level"))
    rows = rows.select("*", F.posexplode(views).alias("_view", "_on"))
    order = Window.partitionBy("page_id", "_on").orderBy("at")
    own_start = (F.col("_view") == 0) & starts
    so_far_ = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({
        "_group": F.sum(F.when(own_start, 1).otherwise(0)).over(so_far_),
        "_over": F.last(F.when(own_start, F.col("mark")), ignorenulls=True).over(so_far_),
    })
    child = (F.col("_view") == 1) & (F.col("mark") == "+c")
    rows = rows.withColumns({
        "_cells": F.max(child.cast("int")).over(Window.partitionBy("page_id", "_on", "_group")),
        "_child_of": F.when(F.col("_view") == 1, F.col("_over")),
    })
    rows = rows.withColumn("_parent", F.max("_child_of").over(Window.partitionBy("page_id", "at"))).filter("_view = 0")
    # An end shares the fate of its start, which is the row before it on its level.
    good = F.when(F.col("mark") == "+w", F.col("_cells") == 1).when(F.col("mark") == "+c", F.coalesce(F.col("_parent") == "+w", F.lit(False)))
    before = F.lag(good).over(Window.partitionBy("page_id", "_level").orderBy("at"))
    rows = rows.withColumn("_good", F.coalesce(F.when(starts, good), F.when(ends, before)))
    return rows.withColumn("mark", F.when(F.col("_good"), F.col("mark"))).drop(
        "_m", "_m_closes", "_level", "_view", "_on", "_group", "_over", "_cells", "_child_of", "_parent", "_good")


def place_blocks(blocks: DataFrame, galleries: bool = False, keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """``(*keys, markup)``: the blocks of a page in order, with those inside columns in their columns.

    ``blocks`` comes from :func:`block_rows` over rows of :func:`mark_columns`, carrying ``MARKS``. Columns
    nest to any depth; what a wrapper holds outside its columns gets a column of its own. With ``galleries``, two or more images in a row become a
    gallery.
    """
    return _placed(_valid_marks(blocks.withColumn("at", F.struct("block_id", "sub"))), galleries, keys)


def _placed(rows: DataFrame, galleries: bool, keys: tuple[str, ...]) -> DataFrame:
    """:func:`place_blocks` from the rows of :func:`_valid_marks`."""
    at = F.struct("block_id", "sub", F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("l"))
    rows = rows.select(*keys, at.alias("at"), "block_type", "markup", *MARKS).filter("mark is not null or markup <> ''")
    if galleries:
        rows = _merge_galleries(rows, keys)
    order = Window.partitionBy("page_id").orderBy("at")
    rows = container_levels(rows, F.col("mark") == "+w", F.col("mark") == "-w", "level", at="at").withColumn(
        "_last", F.lead("at").over(order).isNull())
    level, mark = F.col("level"), F.col("mark")

    def entry(n: int, level: Column, role: str, markup: Column, number: Column | None = None) -> Column:
        at = F.struct(F.col("at.block_id").alias("block_id"), F.col("at.sub").alias("sub"), F.lit(n).alias("n"),
                      (F.lit(0).cast("bigint") if number is None else number).alias("l"))
        return F.struct(at.alias("at"), level.alias("level"), F.lit(role).alias("role"), markup.alias("markup"))

    nothing, one = F.lit(""), F.lit(1).cast("bigint")
    own = (
        F.when(mark == "+w", F.array(entry(0, level - 1, "part", nothing), entry(1, level, "outer", F.lit(_COLUMNS[0]))))
        .when(mark == "+c", F.array(entry(0, level, "inner", _column_open(F.col("mark_class")))))
        .when(mark == "-c", F.array(entry(0, level, "inner_end", nothing)))
        .when(mark == "-w", F.array(entry(0, F.col("level_closes"), "outer_end", nothing)))
        .otherwise(F.array(entry(0, level, "part", F.col("markup"))))
    )
    # Containers still open at the end of a page end there.
    left = F.when(F.col("_last") & (level > 0), F.transform(
        F.sequence(F.greatest(level, one), one, -one), lambda k: entry(9, k, "outer_end", nothing, -k)))
    entries = rows.select(*keys, F.explode(F.when(left.isNotNull(), F.concat(own, left)).otherwise(own)).alias("e")).select(*keys, "e.*")
    empty = _column_open(F.lit(""))
    return render_nested(entries.withColumn("closing", F.lit(_COLUMNS[1])), list(keys), empty, _COLUMN_CLOSE, "\n", "\n\n")


def _merge_galleries(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Two or more image blocks in a row as one gallery block."""
    order = Window.partitionBy("page_id").orderBy("at")
    image = F.col("mark").isNull() & (F.col("block_type") == "image")
    island = F.sum(F.when(image, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumns({"_image": image, "_island": island})
    whole = Window.partitionBy("page_id", "_island", "_image")
    rows = rows.withColumns({"_first": F.when(F.col("_image"), F.min("at").over(whole)).otherwise(F.col("at"))})
    merged = rows.groupBy(*keys, F.col("_first").alias("at")).agg(
        F.count("*").alias("_n"), F.max("block_type").alias("block_type"), F.max("mark").alias("mark"), F.max("mark_class").alias("mark_class"),
        F.expr("listagg(markup, '\n') within group (order by at)").alias("markup"))
    single = F.col("_n") == 1
    return merged.select(
        *keys, "at", F.when(single, F.col("block_type")).otherwise("gallery").alias("block_type"),
        F.when(single, F.col("markup")).otherwise(gallery_markup(F.col("_n"), F.col("markup"))).alias("markup"), *MARKS)


def columns_block(nodes: DataFrame) -> DataFrame:
    """``(page_id, pos, columns, markup)`` of side-by-side containers, recognised by class, with the blocks in their columns.

    One row per outermost wrapper, ``pos`` being where it starts; ``columns`` counts its own columns. ``nodes`` are content rows with numbered
    images, as for :func:`block_rows`.
    """
    marked = mark_columns(nodes)
    blocks = _valid_marks(block_rows(clean_rows(marked.withColumn("_from", F.when(F.col("mark").isNotNull(), F.col("pos")))),
                                     carry=(*MARKS, "_from")).withColumn("at", F.struct("block_id", "sub")))
    rows = container_levels(blocks, F.col("mark") == "+w", F.col("mark") == "-w", "_deep", at="at")
    outer = (F.col("mark") == "+w") & (F.col("_deep") == 1)
    order = Window.partitionBy("page_id").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_wrap", F.last(F.when(outer, F.col("_from")), ignorenulls=True).over(order))
    rows = rows.filter((F.col("_deep") > 0) | (F.col("_deep_closes") == 1)).filter("page_id is not null and _wrap is not null")
    # Counted over the rows at hand and carried as a key, so that they are made once.
    rows = rows.withColumn("columns", F.count_if((F.col("mark") == "+c") & (F.col("_deep") == 1)).over(Window.partitionBy("page_id", "_wrap")))
    return _placed(rows, False, ("page_id", "_wrap", "columns")).select("page_id", F.col("_wrap").alias("pos"), "columns", "markup")


BUTTON_CLASS = r"(^|[\s_-])(button|btn)($|[\s_-])"


def button_markup(url: Column, text: Column) -> Column:
    return F.concat(
        F.lit('<!-- wp:buttons --><div class="wp-block-buttons"><!-- wp:button --><div class="wp-block-button">'
              '<a class="wp-block-button__link wp-element-button" href="'), html_escape(url), F.lit('">'),
        escape_text(text), F.lit("</a></div><!-- /wp:button --></div><!-- /wp:buttons -->"),
    )


def _is_button() -> Column:
    return F.coalesce(attribute_of(F.col("tok"), "class").rlike(BUTTON_CLASS), F.lit(False))


def button_block(nodes: DataFrame) -> DataFrame:
    """``(page_id, link_id, markup)`` of links styled as buttons."""
    styled = nodes.withColumn("_button", F.when(opens("a"), _is_button()))
    number = F.sum(F.when(opens("a"), 1).otherwise(0)).over(so_far()).cast("bigint")
    chosen = styled.withColumn("link_id", number).filter("_button").select("page_id", "link_id")
    rows = links(nodes).join(chosen, ["page_id", "link_id"], "left_semi")
    return rows.select("page_id", "link_id", button_markup(F.col("url_to"), F.col("text")).alias("markup"))


def insert_rows(content: DataFrame) -> DataFrame:
    """Content rows in which special elements became rows of kind ``image`` with ``insert`` (markup) and ``insert_type``.

    Frames of known providers and links that show such an address become embeds, links styled as buttons become buttons, and elements that
    need a person's attention (:func:`pageloom.operators.quality.attention_reason`) visible placeholders. What such an element
    holds goes with it; of elements inside each other the outer one counts. A button without address stays a link. To be used before images
    are numbered: the inserts then stand at their place in the flow as images do, and take no number.
    """
    tok = F.col("tok")
    text = F.when(F.col("kind") == "text", decode_known(tok))
    address = resolve_url(F.col("url"), F.when(opens("iframe"), attribute_of(tok, "src")).when(opens("a"), attribute_of(tok, "href")))
    rows = element_extents(content.withColumns({"_text": text, "_to": F.when(opens("iframe", "a"), address)}))
    # The text of a link: its text nodes up to its end.
    rows = rows.withColumns({
        "_link": F.when(opens("a"), F.col("pos")), "_link_end": F.when(opens("a"), F.col("end_pos"))})
    rows = rows.withColumns({c: F.last(c, ignorenulls=True).over(so_far()) for c in ("_link", "_link_end")})
    in_link = F.col("pos") <= F.col("_link_end")
    shown = collapse_ws(F.array_join(F.collect_list(F.when(in_link, F.col("_text"))).over(
        Window.partitionBy("page_id", "_link").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), ""))
    rows = rows.withColumn("_shown", F.when(opens("a"), shown))
    to = F.col("_to")
    embed = F.when(opens("iframe") | (F.col("_shown") == to), embed_markup(to))
    button = F.when(opens("a") & _is_button() & (F.coalesce(to, F.lit("")) != ""), button_markup(to, F.col("_shown")))
    held = F.when(attention_reason().isNotNull(), paragraph_block(placeholder_text()))
    rows = rows.withColumns({
        "insert_type": F.when(embed.isNotNull(), F.lit("embed")).when(button.isNotNull(), F.lit("button")).when(
            held.isNotNull(), F.lit("placeholder")),
        "insert": F.coalesce(embed, button, held),
    })
    outer = F.max(F.when(F.col("insert").isNotNull(), F.col("end_pos"))).over(before())
    rows = rows.withColumn("_inside", F.coalesce(F.col("pos") <= outer, F.lit(False))).filter(~F.col("_inside") | F.col("tok").isNull())
    hit = F.col("insert").isNotNull()
    return rows.withColumns({
        "kind": F.when(hit, F.lit("image")).otherwise(F.col("kind")), "tag": F.when(hit, F.lit("")).otherwise(F.col("tag")),
    }).drop("_text", "_to", "_link", "_link_end", "_shown", "_inside", "end_pos")


def with_nested_lists(blocks: DataFrame, balanced: DataFrame) -> DataFrame:
    """``blocks`` whose lists keep the lists inside them; both come from the same ``balanced`` rows.

    The lists of a page come as one map, so that rows dealt by page stay where they are.
    """
    nested = nested_lists(balanced).filter("page_id is not null").groupBy("page_id").agg(
        F.map_from_entries(F.collect_list(F.struct("block_id", "markup"))).alias("_nested"))
    joined = blocks.join(nested, "page_id", "left")
    found = F.when(F.col("block_type") == "list", F.element_at("_nested", F.col("block_id")))
    return joined.withColumn("markup", F.coalesce(found, "markup")).drop("_nested")
