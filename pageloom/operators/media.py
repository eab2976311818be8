"""Images: the per-page table, tokens, and the assets shared across pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pageloom.functions.html import attribute_of, decode_known, html_escape
from pageloom.functions.text import strip
from pageloom.functions.urls import resolve_url, url_host
from pageloom.operators.nodes import node_depths, opens, so_far
from pageloom.operators.skew import ranged_prefix, salted_join
from pageloom.operators.vocab import IMAGE_TAGS

# The image token around its index.
TOKEN_OPEN, TOKEN_CLOSE = "⟦IMG_", "⟧"
TOKEN_PATTERN = r"⟦IMG_(\d+)⟧"
IMAGE_MODES = ("remote", "sideload", "bundle", "upload")


def token_text(index: Column) -> Column:
    return F.concat(F.lit(TOKEN_OPEN), index.cast("string"), F.lit(TOKEN_CLOSE))


def _first_attr(*names: str) -> Column:
    return F.coalesce(*[F.nullif(attribute_of(F.col("tok"), n), F.lit("")) for n in names])


def index_images(content: DataFrame, extended: bool = False) -> DataFrame:
    """Turn image tags into rows of kind ``image`` with ``img_index``, ``src`` and ``alt``.

    Images without a source go and use no index. ``extended`` also reads lazy-loading sources
    and ``srcset``, takes a figure's caption as ``caption``, and removes the caption text.
    """
    is_image = F.col("tag").isin(*IMAGE_TAGS) & F.col("kind").isin("open", "void")
    sources = _first_attr("src", "data-src", "url")
    if extended:
        srcset = F.regexp_extract(strip(attribute_of(F.col("tok"), "srcset")), r"^[^\s,]+", 0)
        sources = F.coalesce(_first_attr("src", "data-src", "data-lazy-src", "url"), F.nullif(srcset, F.lit("")))
        content = _with_captions(content)
    rows = content.withColumn("_image", F.coalesce(is_image, F.lit(False)))
    rows = rows.withColumn("_ref", F.when(F.col("_image"), sources))
    rows = rows.filter(~F.col("_image") | F.col("_ref").isNotNull())
    closing_tags = F.col("tag").isin(*IMAGE_TAGS) & F.col("closing")
    alt = strip(F.coalesce(_first_attr("alt", "title"), F.lit("")))
    number = F.sum(F.when(F.col("_image"), 1).otherwise(0)).over(so_far()) - 1
    return (
        rows.filter(~F.coalesce(closing_tags, F.lit(False)))
        .withColumns({
            "img_index": F.when(F.col("_image"), number.cast("bigint")),
            "src": F.when(F.col("_image"), resolve_url(F.col("url"), F.col("_ref"))),
            "alt": F.when(F.col("_image"), alt),
            "kind": F.when(F.col("_image"), F.lit("image")).otherwise(F.col("kind")),
            "tag": F.when(F.col("_image"), F.lit("")).otherwise(F.col("tag")),
        })
        .drop("_image", "_ref")
    )


def _with_captions(content: DataFrame) -> DataFrame:
    """Add ``caption`` to every row of a figure and drop the caption's own nodes."""
    figure = F.sum(F.when(opens("figure"), 1).otherwise(0)).over(so_far())
    rows = node_depths(content, {"_in_figure": ("figure",), "_in_caption": ("figcaption",)}, _figure=figure)
    text = F.when(
        (F.col("_in_caption") > 0) & (F.col("_in_figure") > 0) & (F.col("kind") == "text"),
        decode_known(F.col("tok")),
    )
    whole = Window.partitionBy("page_id", "_figure").orderBy("pos").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    caption = strip(F.array_join(F.collect_list(text).over(whole), ""))
    rows = rows.withColumn("caption", F.when(F.col("_in_figure") > 0, caption))
    is_caption = (F.col("_in_caption") > 0) | (F.col("closing") & (F.col("tag") == "figcaption"))
    return rows.filter(~F.coalesce(is_caption & F.col("caption").isNotNull(), F.lit(False))).drop(
        "_in_figure", "_figure", "_in_caption"
    )


def extract_images(content: DataFrame, extended: bool = False) -> DataFrame:
    """``(page_id, img_index, src, alt[, caption])`` in document order."""
    rows = index_images(content, extended).filter(F.col("kind") == "image")
    # Declared non-null, so that joins on the source add no filter that computes it twice.
    columns = ["page_id", "img_index", F.coalesce("src", F.lit("")).alias("src"), "alt"]
    return rows.select(*columns, *(["caption"] if extended else []))


def tokenize_images(indexed: DataFrame) -> DataFrame:
    """``(page_id, url, html, images)``: content HTML with each image as a paragraph holding its token."""
    token = F.concat(F.lit("<p>"), token_text(F.col("img_index")), F.lit("</p>"))
    return (
        indexed.withColumn("_piece", F.when(F.col("kind") == "image", token).otherwise(F.col("tok")))
        .groupBy("page_id", "url")
        .agg(
            F.coalesce(F.expr("listagg(_piece, '') within group (order by pos)"), F.lit("")).alias("html"),
            F.count("img_index").alias("images"),
        )
    )


def image_tag(src: Column, alt: Column) -> Column:
    return F.concat(F.lit('<img src="'), html_escape(src), F.lit('" alt="'), html_escape(alt), F.lit('">'))


def raw_html(indexed: DataFrame) -> DataFrame:
    """``(page_id, url, html)``: content with absolute images, straight from the node rows."""
    piece = F.when(F.col("kind") == "image", image_tag(F.col("src"), F.col("alt"))).otherwise(F.col("tok"))
    return indexed.withColumn("_piece", piece).groupBy("page_id", "url").agg(
        F.coalesce(F.expr("listagg(_piece, '') within group (order by pos)"), F.lit("")).alias("html")
    )


def token_pieces(html_rows: DataFrame) -> DataFrame:
    """``(page_id, n, piece, img_index)``: HTML cut at its image tokens."""
    cut = F.regexp_extract_all("html", F.lit(r"⟦IMG_\d+⟧|[^⟦]+|⟦"), F.lit(0))
    index = F.regexp_extract("piece", "^" + TOKEN_PATTERN + "$", 1)
    return html_rows.select("page_id", F.posexplode_outer(cut).alias("n", "piece")).select(
        "page_id", F.col("n").cast("bigint").alias("n"), "piece",
        F.when(index != "", index.try_cast("bigint")).alias("img_index"),
    )


def detokenize(html_rows: DataFrame, images: DataFrame) -> DataFrame:
    """``(page_id, html)`` with tokens replaced by image tags; unknown tokens stay as they are."""
    pieces = token_pieces(html_rows).join(images.select("page_id", "img_index", "src", "alt"),
                                          ["page_id", "img_index"], "left")
    piece = F.when(F.col("src").isNotNull(), image_tag(F.col("src"), F.col("alt"))).otherwise(F.col("piece"))
    return pieces.withColumn("piece", piece).groupBy("page_id").agg(
        F.coalesce(F.expr("listagg(piece, '') within group (order by n)"), F.lit("")).alias("html")
    )


def distinct_assets(images: DataFrame) -> DataFrame:
    """``(src, first_page, first_index, refs)``: every source once, however many pages use it."""
    first = F.min(F.struct("page_id", "img_index"))
    return images.groupBy("src").agg(first.alias("_first"), F.count("*").alias("refs")).select(
        "src", F.col("_first.page_id").alias("first_page"), F.col("_first.img_index").alias("first_index"), "refs"
    )


def plan_media(images: DataFrame, mode: str, results: DataFrame | None = None) -> DataFrame:
    """``(page_id, img_index, src, url, media_id, alt)``: what each image will point at.

    ``remote`` and ``sideload`` keep the source. ``upload`` takes ``results(src, url, media_id,
    ok)``, ``bundle`` takes ``results(src, url, ok)`` with local names; an asset that failed or
    is missing falls back to its source. Each reference keeps its own alternative text.
    """
    if mode not in IMAGE_MODES:
        raise ValueError(f"unknown image mode {mode}")
    base = images.select("page_id", "img_index", "src", "alt")
    none = F.lit(None).cast("bigint")
    if mode in ("remote", "sideload"):
        return base.select("page_id", "img_index", "src", F.col("src").alias("url"), none.alias("media_id"), "alt")
    if results is None:
        raise ValueError(f"mode {mode} needs results")
    media = F.col("media_id") if mode == "upload" else none
    usable = results.filter("ok").select(
        "src", F.col("url").alias("_url"), media.cast("bigint").alias("media_id")
    )
    # A plain join: adaptive execution splits the partitions of sources that very many pages use.
    return base.join(usable, "src", "left").select(
        "page_id", "img_index", "src", F.coalesce("_url", "src").alias("url"), "media_id", "alt"
    )


def assign_filenames(assets: DataFrame) -> DataFrame:
    """``(src, name, sha256, file_name, conflict)`` from ``assets(src, name, sha256, ordinal)``.

    ``ordinal`` may be of any type with an order, such as a struct of page and image.

    The same name with the same bytes shares a file; other bytes get ``stem-1``, ``stem-2`` in
    order of first appearance. ``conflict`` marks a generated name that another asset has by nature.
    """
    files = assets.groupBy("name", "sha256").agg(F.min("ordinal").alias("ordinal"))
    ranked = ranged_prefix(files, "ordinal", F.lit(1), "suffix", ("name",))
    extension = F.regexp_extract("name", r"(?<=[^.])\.[^.]*$", 0)
    stem = F.expr("substring(name, 1, length(name) - length(_ext))")
    named = ranked.withColumn("_ext", extension).withColumn(
        "file_name", F.when(F.col("suffix") == 0, F.col("name")).otherwise(
            F.concat(stem, F.lit("-"), F.col("suffix").cast("string"), F.col("_ext")))
    )
    natural = assets.select(F.col("name").alias("file_name")).distinct().withColumn("_natural", F.lit(True))
    flagged = named.join(natural, "file_name", "left").select(
        "name", "sha256", "file_name",
        ((F.col("suffix") > 0) & F.coalesce("_natural", F.lit(False))).alias("conflict"),
    )
    # One row per distinct file joins back to its sources; both sides are keyed by the content hash.
    return assets.select("src", "name", "sha256").join(flagged, ["name", "sha256"])


def map_tokens_to_media(tokens: DataFrame, media: DataFrame) -> DataFrame:
    """Token rows with their media (an image block); tokens without media drop out."""
    return tokens.join(media, ["page_id", "img_index"])


def unmapped_tokens(tokens: DataFrame, media: DataFrame) -> DataFrame:
    """Report of the tokens that :func:`map_tokens_to_media` drops."""
    return tokens.join(media, ["page_id", "img_index"], "left_anti")


def page_attachments(images: DataFrame, mode: str) -> DataFrame:
    """Every image of a page, repeats included, in ``sideload`` mode; none otherwise."""
    rows = images.select("page_id", "img_index", "src", "alt")
    return rows if mode == "sideload" else rows.filter(F.lit(False))


def image_inventory(images: DataFrame, placed: DataFrame) -> DataFrame:
    """``(page_id, img_index, src, alt, position_lost, no_alt)``; ``placed`` holds the tokens of the output."""
    seen = placed.select("page_id", "img_index").distinct().withColumn("_placed", F.lit(True))
    return images.join(seen, ["page_id", "img_index"], "left").select(
        "page_id", "img_index", "src", "alt",
        F.col("_placed").isNull().alias("position_lost"), (F.col("alt") == "").alias("no_alt"),
    )


def asset_sharing(images: DataFrame, pages: DataFrame, template_share: float = 0.5) -> DataFrame:
    """``(host, src, pages, host_pages, is_template)``: assets by how much of their site uses them."""
    hosts = pages.select("page_id", url_host(F.col("url")).alias("host"))
    per_host = hosts.groupBy("host").agg(F.count("*").alias("host_pages"))
    used = images.select("page_id", "src").dropDuplicates(["page_id", "src"]).join(hosts, "page_id")
    shared = used.groupBy("host", "src").agg(F.count("*").alias("pages"))
    return salted_join(shared, per_host, ["host"], "inner", "src").select(
        "host", "src", "pages", "host_pages",
        ((F.col("pages") > 1) & (F.col("pages") >= F.col("host_pages") * template_share)).alias("is_template"),
    )


