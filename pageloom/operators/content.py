"""Selecting the main content of a page, and corpus-level views of it."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from pageloom.functions.html import attribute_of, decode_known
from pageloom.functions.text import collapse_ws, word_count
from pageloom.functions.urls import resolve_url, url_host, url_netloc
from pageloom.operators.nodes import (
    before, body_nodes, by_page, closes, element_extents, first_element, flag_first, html_nodes, node_depth, node_depths, opens,
    page, whole_page, so_far,
)
from pageloom.operators.selectors import is_structural, structural_steps, with_structural_hits
from pageloom.operators.similarity import similar_pairs, word_shingles
from pageloom.operators.skew import salted_join
from pageloom.operators.vocab import BLOCK_TAGS, CHROME_TAGS, IMAGE_TAGS
from pageloom.session import materialize

_STRUCTURAL = re.compile(r"[>+~,*:\[]")
MIN_BLOCK_WORDS = 15
MAX_LINK_SHARE = 3  # a block is dropped when more than one word in three is link text


# ---------------------------------------------------------------- selectors


def selector_parts(css: Column) -> Column:
    """``tag#id.class`` compounds separated by spaces as an array of structs; NULL when unsupported."""
    def part(compound: Column) -> Column:
        return F.struct(
            F.lower(F.regexp_extract(compound, r"^([a-zA-Z][a-zA-Z0-9_-]*)", 1)).alias("tag"),
            F.regexp_extract(compound, r"#([a-zA-Z0-9_-]+)", 1).alias("id"),
            F.regexp_extract_all(compound, F.lit(r"\.([a-zA-Z0-9_-]+)"), F.lit(1)).alias("classes"),
        )

    supported = css.rlike(r"^\s*[a-zA-Z0-9_.#-]+(\s+[a-zA-Z0-9_.#-]+)*\s*$")
    return F.when(supported, F.transform(F.split(F.trim(css), r"\s+"), part))


def _matches(part: Column) -> Column:
    """The node is an open (or void) tag of the given compound."""
    tok = F.col("tok")
    classes = F.split(F.coalesce(attribute_of(tok, "class"), F.lit("")), r"\s+")
    return (
        F.col("kind").isin("open", "void")
        & ((part["tag"] == "") | (part["tag"] == F.col("tag")))
        & ((part["id"] == "") | F.coalesce(attribute_of(tok, "id") == part["id"], F.lit(False)))
        & ((F.size(part["classes"]) == 0) | (F.size(F.array_except(part["classes"], classes)) == 0))
    )


def _selector_hit(nodes: DataFrame, max_parts: int, structural: bool) -> DataFrame:
    """Add boolean ``_hit``: the node matches the page's selector (column ``css``).

    Plain selectors are matched with windows that the page needs anyway. With ``structural``, the others are matched in a
    pass over the tags of their pages, for which a page's rows stand in one array.
    """
    nodes = nodes.withColumn("_parts", selector_parts(F.col("css")))
    count = F.size("_parts")
    if structural:
        nodes = with_structural_hits(nodes)
    rows = nodes if max_parts == 1 else element_extents(nodes)
    hit = F.lit(False)
    for k in range(max_parts):
        here = F.coalesce(_matches(F.get("_parts", F.lit(k))), F.lit(False))
        if k:
            reach = F.max(F.when(F.col(f"_m{k - 1}"), F.col("end_pos"))).over(before())
            here = here & F.coalesce(F.col("pos") <= reach, F.lit(False))
        rows = rows.withColumn(f"_m{k}", here)
        hit = F.when(count == k + 1, F.col(f"_m{k}")).otherwise(hit)
    if structural:
        hit = hit | F.coalesce(F.col("pos") == F.col("hit_pos"), F.lit(False))
    rows = rows.withColumn("_hit", F.coalesce(hit, F.lit(False)))
    return rows.drop("end_pos", "_parts", "hit_pos", *[f"_m{k}" for k in range(max_parts)])


def select_first(nodes: DataFrame, css: str) -> DataFrame:
    """Inner nodes of the first element matching ``css`` on each page."""
    structural = _STRUCTURAL.search(css) is not None
    rows = _selector_hit(nodes.withColumn("css", F.lit(css)), 1 if structural else len(css.split()), structural)
    return flag_first(rows, F.col("_hit"), "_in", inner=True).filter("_in").drop("_in", "_hit", "css")


def supported_selector(css: Column) -> Column:
    """The selector is one of those that can be matched."""
    return F.coalesce(selector_parts(css).isNotNull() | structural_steps(css).isNotNull(), F.lit(False))


def match_selector(pages: DataFrame, selectors: DataFrame) -> DataFrame:
    """``(page_id, css)``: by host, else by the raw authority; NULL when neither is configured.

    The last row of a host counts, by ``line_no`` if ``selectors`` has it; without that order, two different
    selectors of one host are an error.
    """
    keyed = pages.select("page_id", url_host(F.col("url")).alias("_host"), url_netloc(F.col("url")).alias("_netloc"))
    if "line_no" in selectors.columns:
        css = F.max_by("css", "line_no")
    else:
        several = F.raise_error(F.concat(F.lit("several selectors for host "), F.first("host")))
        css = F.when(F.min("css") == F.max("css"), F.max("css")).otherwise(several.cast("string"))
    rules = selectors.filter(F.col("css") != "").groupBy("host").agg(css.alias("css"))
    by_host = rules.select(F.col("host").alias("_host"), F.col("css").alias("_css_host"))
    by_netloc = rules.select(F.col("host").alias("_netloc"), F.col("css").alias("_css_netloc"))
    joined = salted_join(keyed, by_host, ["_host"], "left", "page_id")
    joined = salted_join(joined, by_netloc, ["_netloc"], "left", "page_id")
    return joined.select("page_id", F.coalesce("_css_host", "_css_netloc").alias("css"))


# ---------------------------------------------------------------- automatic content


def _text_runs(nodes: DataFrame) -> DataFrame:
    """Number the text blocks of a page: column ``block_id``.

    A block starts at a non-blank text node with a block-level tag since the previous one.
    Tags before the first text of a block already carry its number; closing tags keep the
    number of the block they end.
    """
    filled = (F.col("kind") == "text") & F.col("tok").rlike(r"\S")
    border = F.col("kind").isin("open", "close", "void") & F.col("tag").isin(*BLOCK_TAGS)
    rows = (
        nodes.withColumn("_filled", F.coalesce(filled, F.lit(False)))
        .withColumn("_border", F.coalesce(F.max(F.when(border, F.col("pos"))).over(so_far()), F.lit(-1)))
        .withColumn("_text_at", F.coalesce(F.max(F.when(F.col("_filled"), F.col("pos"))).over(before()), F.lit(-2)))
        .withColumn("_fresh", F.col("_border") > F.col("_text_at"))
    )
    started = F.sum(F.when(F.col("_filled") & F.col("_fresh"), 1).otherwise(0)).over(so_far())
    ahead = F.col("kind").isin("open", "void") & F.col("_fresh")
    return (
        rows.withColumn("block_id", (started + F.when(ahead, 1).otherwise(0)).cast("bigint"))
        .drop("_border", "_text_at", "_fresh")
    )


def text_blocks(nodes: DataFrame, carry: tuple[str, ...] = ("url",)) -> DataFrame:
    """``(page_id, *carry, block_id, text, words, link_words)`` for the non-empty text blocks of the body."""
    rows = _text_runs(node_depth(body_nodes(nodes), ("a",), "_in_link")).filter("_filled")
    words = word_count(F.col("tok"))
    return (
        rows.withColumn("_text", decode_known(F.col("tok")))
        .groupBy("page_id", *carry, "block_id")
        .agg(
            F.expr("listagg(_text, '') within group (order by pos)").alias("text"),
            F.sum(words).alias("words"),
            F.sum(F.when(F.col("_in_link") > 0, words).otherwise(0)).alias("link_words"),
        )
        .withColumn("text", collapse_ws(F.col("text")))
    )


def flag_content(nodes: DataFrame, hit: Column | None = None) -> DataFrame:
    """Boolean columns ``_auto`` and, with a selector ``hit``, ``_selected`` and ``_matched``.

    ``_auto``: outside chrome, a text block stays when at most a third of its words are link text
    and it or a neighbouring block has fifteen words or more. Only shallow features, on purpose:
    the neighbours supply the recall. ``_selected``: inside the first element that ``hit`` marks.
    Both are worked out together, level by level, so that windows over the page order share
    operators and one sort; the block sums need the second sort.
    """
    rows = nodes
    at = F.when(hit if hit is not None else F.lit(False), F.col("pos"))
    body = F.min(F.when(opens("body"), F.col("pos"))).over(whole_page())
    first = {"_first": F.min(at).over(whole_page()), "_first_tag": F.min_by("tag", at).over(whole_page())}
    rows = rows.withColumns({"_body": body, **(first if hit is not None else {})})

    border = F.col("kind").isin("open", "close", "void") & F.col("tag").isin(*BLOCK_TAGS)
    running = {"_border": F.coalesce(F.max(F.when(border, F.col("pos"))).over(so_far()), F.lit(-1))}
    started, nest = first_element()
    if hit is not None:
        running["_nest"] = nest
    totals = {"_chrome": CHROME_TAGS, "_in_link": ("a",)}
    rows = node_depths(rows, totals, **running)
    area = (
        (F.col("_chrome") == 0) & ~closes(*CHROME_TAGS)
        & (F.col("_body").isNull() | (F.col("pos") > F.col("_body"))) & ~closes("body", "html")
    )
    filled = (F.col("kind") == "text") & F.col("tok").rlike(r"\S")
    rows = rows.withColumn("_area", F.coalesce(area, F.lit(False))).withColumn(
        "_filled", F.col("_area") & F.coalesce(filled, F.lit(False))
    )
    text_at = F.coalesce(F.max(F.when(F.col("_filled"), F.col("pos"))).over(before()), F.lit(-2))
    levels = {"_fresh": F.col("_border") > text_at}
    if hit is not None:
        levels["_ended"] = F.min(F.when(started, F.col("_nest"))).over(so_far())
    rows = rows.withColumns(levels)
    block = F.sum(F.when(F.col("_filled") & F.col("_fresh"), 1).otherwise(0)).over(so_far())
    ahead = F.col("kind").isin("open", "void") & F.col("_fresh")
    words = F.when(F.col("_filled"), word_count(F.col("tok"))).otherwise(0)
    rows = rows.withColumns({"_block": (block + F.when(ahead, 1).otherwise(0)).cast("bigint"), "_words": words})
    rows = rows.withColumn("_linked", F.when(F.col("_in_link") > 0, F.col("_words")).otherwise(0))
    by_block = page().orderBy("_block")
    here, previous, following = (by_block.rangeBetween(i, i) for i in (0, -1, 1))
    rows = rows.withColumns({
        "_own": F.coalesce(F.sum("_words").over(here), F.lit(0)),
        "_previous": F.coalesce(F.sum("_words").over(previous), F.lit(0)),
        "_following": F.coalesce(F.sum("_words").over(following), F.lit(0)),
        "_own_linked": F.coalesce(F.sum("_linked").over(here), F.lit(0)),
    })
    keep = (F.col("_own_linked") * MAX_LINK_SHARE <= F.col("_own")) & (
        F.greatest("_own", "_previous", "_following") >= MIN_BLOCK_WORDS
    )
    flags = {"_auto": F.col("_area") & F.coalesce(keep, F.lit(False))}
    if hit is not None:
        inside = F.coalesce(F.col("pos") > F.col("_first"), F.lit(False))
        flags["_selected"] = inside & (F.coalesce(F.col("_ended"), F.lit(1)) >= 1)
        flags["_matched"] = F.col("_first").isNotNull()
    kept = [c for c in nodes.columns]
    return rows.withColumns(flags).select(*kept, *flags)


def auto_content(nodes: DataFrame) -> DataFrame:
    """Nodes of the automatically found main content."""
    return flag_content(nodes).filter("_auto").drop("_auto")


def content_nodes(pages: DataFrame, selectors: DataFrame | None = None, css: str | None = None,
                  carry: tuple[str, ...] = ("url",), prune: bool = False, partitioned: bool = False,
                  max_parts: int | None = None, structural: bool | None = None) -> DataFrame:
    """Content rows of every page with ``content_source`` (selector, auto, fallback or unsupported).

    A page without content keeps one row with a NULL token, so it is never lost. ``css`` sets
    one selector for all pages; ``selectors`` is a ``(host, css)`` table. ``prune`` and ``partitioned`` as in
    :func:`html_nodes`. ``fallback`` is a selector that matched nothing, ``unsupported`` one that was not
    understood; both take the automatic content. ``max_parts``, the compounds of the longest selector without structure, and
    ``structural``, whether any has some (:mod:`pageloom.operators.selectors`), save the look at ``selectors`` while the plan is built.
    """
    if selectors is not None:
        css_of_page = match_selector(pages, selectors)
        if max_parts is None:
            plain = F.when(~is_structural(F.col("css")), F.size(F.split(F.trim("css"), r"\s+")))
            max_parts, found = selectors.agg(F.max(plain), F.max(is_structural(F.col("css")))).first()
            structural = found if structural is None else structural
        max_parts = max(1, max_parts or 1)
        structural = structural is None or bool(structural)
        keyed = pages.select("page_id", *carry, "html")
        keyed = (keyed if partitioned else by_page(keyed)).join(css_of_page, "page_id", "left")
        nodes = html_nodes(keyed, (*carry, "css"), partitioned=True, prune=prune)
    else:
        nodes = html_nodes(pages, carry, partitioned, prune).withColumn("css", F.lit(css).cast("string"))
        structural = css is not None and _STRUCTURAL.search(css) is not None
        max_parts = len(css.split()) if css and not structural else 1

    rows = _selector_hit(nodes, max_parts, structural)
    rows = flag_content(rows, F.col("_hit"))
    source = (
        F.when(F.col("css").isNull(), F.lit("auto")).when(F.col("_matched"), F.lit("selector"))
        .when(~supported_selector(F.col("css")), F.lit("unsupported")).otherwise(F.lit("fallback"))
    )
    keep = F.coalesce(F.when(F.col("_matched"), F.col("_selected")).otherwise(F.col("_auto")), F.lit(False))
    rows = rows.withColumns({"content_source": source, "_keep": keep})
    sentinel = F.coalesce(F.col("pos"), F.lit(0)) == 0
    blank = [F.when(F.col("_keep"), F.col(c)).alias(c) for c in ("tok", "kind")]
    return rows.filter(F.col("_keep") | sentinel).select(
        "page_id", *carry, "pos", blank[0],
        F.when(F.col("_keep"), F.col("tag")).otherwise("").alias("tag"),
        (F.col("closing") & F.col("_keep")).alias("closing"), blank[1], "content_source",
    )


def content_summary(content: DataFrame) -> DataFrame:
    """``(page_id, url, content_source, text_chars, images, is_empty)`` per page."""
    text = F.when(F.col("kind") == "text", collapse_ws(decode_known(F.col("tok"))))
    marked = content.withColumn("_chars", F.length(text))
    image = F.col("tag").isin(*IMAGE_TAGS) & F.col("kind").isNotNull()
    tags = F.col("kind").isin("open", "close", "void")
    return marked.groupBy("page_id", "url", "content_source").agg(
        F.coalesce(F.sum("_chars"), F.lit(0)).alias("text_chars"),
        F.count_if(image).alias("images"),
        (F.count_if(tags) + F.coalesce(F.sum("_chars"), F.lit(0)) == 0).alias("is_empty"),
    )


# ---------------------------------------------------------------- links, tables


def links(nodes: DataFrame) -> DataFrame:
    """``(page_id, link_id, href, url_to, text)`` of every ``<a href>`` in document order."""
    number = F.sum(F.when(opens("a"), 1).otherwise(0)).over(so_far()).cast("bigint")
    rows = node_depths(nodes, {"_in_link": ("a",)}, link_id=number).filter(F.col("_in_link") > 0)
    rows = rows.withColumn("_href", F.when(opens("a"), attribute_of(F.col("tok"), "href"))).withColumn(
        "_text", F.when(F.col("kind") == "text", decode_known(F.col("tok")))
    )
    grouped = rows.groupBy("page_id", "url", "link_id").agg(
        F.min_by("_href", F.when(opens("a"), F.col("pos"))).alias("href"),
        F.coalesce(F.expr("listagg(_text, '') within group (order by pos)"), F.lit("")).alias("text"),
    )
    return grouped.filter(F.coalesce(F.col("href"), F.lit("")) != "").select(
        "page_id", "link_id", "href", resolve_url(F.col("url"), F.col("href")).alias("url_to"),
        collapse_ws(F.col("text")).alias("text"),
    )


def tables(nodes: DataFrame) -> DataFrame:
    """``(page_id, table_no, row_no, col_no, is_header, text)``, one row per table cell."""
    def count(*tags: str) -> Column:
        return F.sum(F.when(opens(*tags), 1).otherwise(0)).over(so_far())

    rows = node_depths(
        nodes, {"_in_table": ("table",), "_in_cell": ("td", "th")},
        table_no=count("table"), _tr=count("tr"), _cell=count("td", "th"),
    ).filter((F.col("_in_table") > 0) & (F.col("_in_cell") > 0))
    rows = rows.withColumn("_text", F.when(F.col("kind") == "text", decode_known(F.col("tok"))))
    cells = rows.groupBy("page_id", "table_no", "_tr", "_cell").agg(
        F.coalesce(F.expr("listagg(_text, '') within group (order by pos)"), F.lit("")).alias("text"),
        F.max(opens("th")).alias("is_header"),
    )
    per_table = Window.partitionBy("page_id", "table_no")
    per_row = Window.partitionBy("page_id", "table_no", "_tr").orderBy("_cell")
    return cells.select(
        "page_id", F.col("table_no").cast("bigint"),
        (F.dense_rank().over(per_table.orderBy("_tr"))).cast("bigint").alias("row_no"),
        F.row_number().over(per_row).cast("bigint").alias("col_no"),
        "is_header", collapse_ws(F.col("text")).alias("text"),
    )


# ---------------------------------------------------------------- corpus views


def site_boilerplate(blocks: DataFrame, min_pages: int = 3) -> DataFrame:
    """``(host, text, n_pages)`` of text blocks found on ``min_pages`` or more pages of one host.

    Duplicates inside a page go first, on the page's own partition, so the count per
    ``(host, text)`` combines before its shuffle however common one text is.
    """
    per_page = blocks.select("page_id", url_host(F.col("url")).alias("host"), "text").dropDuplicates(
        ["page_id", "host", "text"]
    )
    return (
        per_page.groupBy("host", "text").agg(F.count("*").alias("n_pages"))
        .filter(F.col("n_pages") >= min_pages)
    )


def drop_site_boilerplate(blocks: DataFrame, shared: DataFrame) -> DataFrame:
    """Text blocks that are not site boilerplate."""
    keyed = blocks.withColumn("host", url_host(F.col("url")))
    return salted_join(keyed, shared.select("host", "text"), ["host", "text"], "left_anti", "page_id")


def duplicate_content(blocks: DataFrame) -> DataFrame:
    """``(page_id, blocks, repeated, repeat_ratio)`` of pages whose body repeats itself."""
    counts = blocks.groupBy("page_id", "text").agg(F.count("*").alias("_n"))
    pages = counts.groupBy("page_id").agg(
        F.sum("_n").alias("blocks"), F.sum(F.col("_n") - 1).alias("repeated")
    )
    return pages.filter(F.col("repeated") > 0).withColumn(
        "repeat_ratio", F.round(F.col("repeated") / F.col("blocks"), 4)
    )


def near_copies(blocks: DataFrame, by: str, threshold: float = 0.8, words: int = 5) -> DataFrame:
    """``(by, a, b, similarity)``: pairs of different texts within ``by`` (a column) whose word shingles agree to ``threshold`` or more.

    ``a`` and ``b`` are md5 of the texts, the smaller first. Exact: no pair is lost to a hash of signatures. Equal texts are one, so copies make no pairs, and a shingle
    that all texts of a site share is only met by texts that have nothing rarer.
    """
    texts = blocks.select(F.coalesce(F.col(by).cast("string"), F.lit("")).alias(by), "text").distinct()
    return similar_pairs(texts.select(F.md5("text").alias("id"), by, word_shingles(F.col("text"), words).alias("tokens")), threshold, [by])


def duplicate_content_near(blocks: DataFrame, threshold: float = 0.8, words: int = 5) -> DataFrame:
    """``(page_id, blocks, near, near_ratio)`` of pages with text blocks that repeat an earlier one of the page, nearly or wholly."""
    texts = materialize(blocks.groupBy("page_id", "text").agg(F.min("block_id").alias("_first"), F.count("*").alias("_n")))
    texts = texts.withColumn("_at", F.struct("_first", F.md5("text").alias("_md5")))
    sets = texts.filter("page_id is not null").select("page_id", F.col("_at").alias("id"), word_shingles(F.col("text"), words).alias("tokens"))
    later = similar_pairs(sets, threshold, ["page_id"], bounded=True).select("page_id", F.col("b").alias("_at")).distinct()
    marked = texts.join(later.withColumn("_near", F.lit(1)), ["page_id", "_at"], "left")
    near = F.col("_n") - F.when(F.col("_near").isNull(), 1).otherwise(0)
    return marked.groupBy("page_id").agg(F.sum("_n").alias("blocks"), F.sum(near).alias("near")).filter("near > 0").withColumn(
        "near_ratio", F.round(F.col("near") / F.col("blocks"), 4))


def meta_overlap(nodes: DataFrame, words: int = 5) -> DataFrame:
    """``(page_id, grams, found, ratio)``: runs of ``words`` words of the meta description that the page's text holds, across block borders.

    A shorter description is one run. Pages without a description have no row.
    """
    is_description = (F.col("tag") == "meta") & (F.lower(attribute_of(F.col("tok"), "name")) == "description")
    description = F.when(is_description, collapse_ws(attribute_of(F.col("tok"), "content")))
    described = nodes.withColumn("description", F.max(description).over(whole_page())).filter(F.coalesce("description", F.lit("")) != "")
    text = F.concat(F.lit(" "), F.expr("listagg(text, ' ') within group (order by block_id)"), F.lit(" "))
    pages = text_blocks(described, ("url", "description")).groupBy("page_id", "description").agg(text.alias("_text"))
    own = F.regexp_extract_all("description", F.lit(r"\S+"), F.lit(0))
    last = F.greatest(F.size("_own") - words + 1, F.lit(1))
    grams = F.transform(F.sequence(F.lit(1), last), lambda i: F.concat(
        F.lit(" "), F.array_join(F.slice("_own", i, F.lit(words)), " "), F.lit(" ")))
    rows = pages.withColumn("_own", own).withColumn("_grams", F.array_distinct(grams))
    found = F.size(F.filter("_grams", lambda g: F.col("_text").contains(g)))
    return rows.select("page_id", F.size("_grams").cast("bigint").alias("grams"), found.cast("bigint").alias("found"),
                       F.round(found / F.size("_grams"), 4).alias("ratio"))


def boilerplate_sketches(blocks: DataFrame) -> DataFrame:
    """``(host, text, sketch)`` of one run: the pages each text stands on, as a sketch that runs can be merged by."""
    return blocks.groupBy(url_host(F.col("url")).alias("host"), "text").agg(F.hll_sketch_agg("page_id").alias("sketch"))


def merge_sketches(*runs: DataFrame) -> DataFrame:
    """Sketches of several runs as if of one; a page that came in two runs counts once."""
    every = runs[0]
    for run in runs[1:]:
        every = every.unionByName(run)
    return every.groupBy("host", "text").agg(F.hll_union_agg("sketch").alias("sketch"))


def shared_texts(sketches: DataFrame, min_pages: int = 3) -> DataFrame:
    """:func:`site_boilerplate` from sketches: counts of a few pages are exact, large ones within about 2 %."""
    return sketches.select("host", "text", F.hll_sketch_estimate("sketch").alias("n_pages")).filter(F.col("n_pages") >= min_pages)


def meta_duplication(nodes: DataFrame) -> DataFrame:
    """``(page_id, blocks, echoed)``: text blocks whose text also stands in the meta description."""
    is_description = (F.col("tag") == "meta") & (F.lower(attribute_of(F.col("tok"), "name")) == "description")
    described = nodes.withColumn(
        "description", F.max(F.when(is_description, collapse_ws(attribute_of(F.col("tok"), "content")))).over(whole_page())
    ).filter(F.col("description").isNotNull())
    blocks = text_blocks(described, ("url", "description"))
    return blocks.groupBy("page_id").agg(
        F.count("*").alias("blocks"),
        F.count_if(F.col("description").contains(F.col("text"))).alias("echoed"),
    )


def suggest_selector(pages: DataFrame, coverage: float = 0.9) -> DataFrame:
    """``(host, css, n_pages, votes)``: the container most pages of a host would pick.

    Per page, the smallest container holding ``coverage`` of the automatically found words and of the images among them.
    """
    rows = flag_content(html_nodes(pages))
    words = F.when(F.col("kind") == "text", word_count(F.col("tok"))).otherwise(0)
    rows = rows.withColumn("_w", words)
    good = F.when(F.col("_auto"), F.col("_w")).otherwise(0)
    image = F.when(F.col("_auto") & F.col("tag").isin(*IMAGE_TAGS) & F.col("kind").isin("open", "void"), 1).otherwise(0)
    rows = rows.withColumns({"_all": F.sum("_w").over(so_far()), "_good": F.sum(good).over(so_far()), "_pics": F.sum(image).over(so_far())})
    rows = rows.withColumns({"_page_good": F.max("_good").over(whole_page()), "_page_pics": F.max("_pics").over(whole_page())})
    rows = element_extents(rows, ("_all", "_good", "_pics"))
    ident = F.coalesce(attribute_of(F.col("tok"), "id"), F.lit(""))
    first_class = F.regexp_extract(F.coalesce(attribute_of(F.col("tok"), "class"), F.lit("")), r"\S+", 0)
    css = F.concat(
        F.col("tag"),
        F.when(ident != "", F.concat(F.lit("#"), ident)).otherwise(""),
        F.when(first_class != "", F.concat(F.lit("."), first_class)).otherwise(""),
    )
    inside_good, inside_all = F.col("_good_end") - F.col("_good"), F.col("_all_end") - F.col("_all")
    candidates = rows.filter(opens("div", "article", "section", "main", "body") & (F.col("_page_good") > 0)).filter(
        (inside_good >= F.col("_page_good") * coverage) & (F.col("_pics_end") - F.col("_pics") >= F.col("_page_pics") * coverage)
    ).select("page_id", "url", "pos", css.alias("css"), inside_all.alias("size"))
    best = candidates.groupBy("page_id", "url").agg(
        F.min_by("css", F.struct(F.col("size"), -F.col("pos"))).alias("css")
    )
    votes = best.groupBy(url_host(F.col("url")).alias("host"), "css").agg(F.count("*").alias("votes"))
    return votes.groupBy("host").agg(
        F.max_by("css", F.struct(F.col("votes"), F.col("css"))).alias("css"),
        F.sum("votes").alias("n_pages"), F.max("votes").alias("votes"),
    )
