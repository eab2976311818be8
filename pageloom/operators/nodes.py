"""The node table: HTML as ordered rows, and positions within the tree.

A page is one input row, so a page's nodes are bounded by one cell of the source. Raw pages are
hash-partitioned by ``page_id`` once, before they are exploded; every window and aggregate keyed
by ``page_id`` downstream reuses that partitioning without another exchange.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from pageloom.functions.html import attribute_of, decode_known, node_tokens, normalize_entities, token_tag
from pageloom.operators.vocab import CHROME_TAGS, RAW_TAGS, VOID_TAGS

#: Stored bytes of pages dealt to one task: as nodes, with every window's sort buffer, they take several hundred times as much.
TASK_BYTES = 1 << 20


def by_page(pages: DataFrame) -> DataFrame:
    """``pages`` hash-partitioned by ``page_id``, into more parts the more there is to read.

    A number of parts that Spark chooses follows the cores and the bytes shuffled, and so a task would grow with the table.
    The size is that of the files (or rows) read, as Spark's own estimate has it; where it has none, Spark chooses.
    """
    leaves = pages._jdf.queryExecution().optimizedPlan().collectLeaves()
    stored = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    parts = math.ceil(stored / TASK_BYTES)
    if parts < 2 or stored >= 1 << 60:
        return pages.repartition("page_id")
    return pages.repartition(max(parts, pages.sparkSession.sparkContext.defaultParallelism), "page_id")


def page() -> WindowSpec:
    return Window.partitionBy("page_id")


def whole_page() -> WindowSpec:
    """The full page, in page order, so that it shares the sort of the running windows."""
    return page().orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def so_far() -> WindowSpec:
    """The page up to and including the current node."""
    return page().orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def before() -> WindowSpec:
    """The page before the current node."""
    return page().orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)


def html_nodes(pages: DataFrame, carry: tuple[str, ...] = ("url",), partitioned: bool = False,
               prune: bool = False) -> DataFrame:
    """``(page_id, *carry, pos, tok, tag, closing, kind)``; an empty page keeps one NULL row.

    Set ``partitioned`` when the pages come from a table bucketed by ``page_id``. ``prune`` leaves
    out scripts, styles and comments before any window sees them, often most of a page's bytes;
    positions stay, and so does a page's first row, without its text. Rare character references in text and tags become
    their characters (:func:`pageloom.functions.html.normalize_entities`).
    """
    source = pages.select("page_id", *carry, "html")
    if not partitioned:
        source = by_page(source)
    tokens = source.select("page_id", *carry, F.posexplode_outer(node_tokens(F.col("html"))).alias("pos", "tok"))
    tok = F.col("tok")
    tagged = tokens.select(
        "page_id", *carry, F.col("pos").cast("bigint").alias("pos"), "tok",
        token_tag(tok).alias("tag"), tok.startswith("</").alias("closing"),
    )
    tag = F.col("tag")
    kind = (
        F.when(tok.isNull(), F.lit(None).cast("string"))
        .when(tok.startswith("<!--") | tok.startswith("<?"), F.lit("comment"))
        .when(tag.isin(*RAW_TAGS) & ~F.col("closing"), F.lit("raw"))
        .when(tok.startswith("<!"), F.lit("doctype"))
        .when(tag == "", F.lit("text"))
        .when(F.col("closing"), F.lit("close"))
        .when(tag.isin(*VOID_TAGS), F.lit("void"))
        .otherwise(F.lit("open"))
    )
    in_tag = F.col("kind").isin("open", "close", "void")
    read = F.coalesce(in_tag | (F.col("kind") == "text"), F.lit(False))
    nodes = tagged.withColumn("kind", kind).withColumn(
        "tok", F.when(read, normalize_entities(F.col("tok"), in_tag)).otherwise(F.col("tok")))
    if not prune:
        return nodes
    useless = F.coalesce(F.col("kind").isin("raw", "comment", "doctype"), F.lit(False))
    return nodes.filter(~useless | (F.col("pos") == 0)).withColumn("tok", F.when(~useless, F.col("tok")))


def opens(*tags: str) -> Column:
    return (F.col("kind") == "open") & F.col("tag").isin(*tags)


def closes(*tags: str) -> Column:
    return (F.col("kind") == "close") & F.col("tag").isin(*tags)


def _step(tags: tuple[str, ...]) -> Column:
    return F.when(opens(*tags), 1).when(closes(*tags), -1).otherwise(0)


def node_depths(nodes: DataFrame, classes: dict[str, tuple[str, ...]], **running: Column) -> DataFrame:
    """Nesting of several tag classes after each node; stray closes never go below zero.

    All classes, and any further ``running`` window columns of the same page order, share two
    window operators and one sort.
    """
    totals = {f"_t_{name}": F.sum(_step(tags)).over(so_far()) for name, tags in classes.items()}
    depths = {
        name: (F.col(f"_t_{name}") - F.least(F.lit(0), F.min(f"_t_{name}").over(so_far()))).cast("bigint")
        for name in classes
    }
    return nodes.withColumns({**totals, **running}).withColumns(depths).drop(*totals)


def node_depth(nodes: DataFrame, tags: tuple[str, ...], name: str = "depth") -> DataFrame:
    """Nesting of one class of tags after each node."""
    return node_depths(nodes, {name: tags})


def drop_chrome(nodes: DataFrame, tags: tuple[str, ...] = CHROME_TAGS) -> DataFrame:
    """Remove navigation, header, footer, aside and form subtrees; an unclosed one runs to the end."""
    kept = (F.col("_chrome") == 0) & ~closes(*tags)
    return node_depth(nodes, tags, "_chrome").filter(kept | F.col("tok").isNull()).drop("_chrome")


def body_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes after the first ``<body>``, or all when there is none."""
    start = F.min(F.when(opens("body"), F.col("pos"))).over(whole_page())
    return nodes.withColumn("_body", start).filter(
        F.col("_body").isNull() | (F.col("pos") >= F.col("_body")) | F.col("tok").isNull()
    ).drop("_body")


def element_extents(nodes: DataFrame, running: tuple[str, ...] = (), within: tuple[str, ...] = ()) -> DataFrame:
    """Add ``end_pos``, the position of each open tag's own close.

    An unclosed element ends one past the last node of the page (or of its ``within`` group);
    a stray close has a NULL end.

    For every page-ordered running column in ``running``, ``<column>_end`` is its value there.
    Opens and closes of one tag alternate within one nesting level, so the close is the next
    row of the level.
    """
    by_tag = Window.partitionBy("page_id", *within, "tag").orderBy("pos")
    tag_so_far = by_tag.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = by_tag.rowsBetween(Window.unboundedPreceding, -1)
    by_level = Window.partitionBy("page_id", *within, "tag", "_level").orderBy("pos")
    step = F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)
    floor = F.least(F.lit(0), F.coalesce(F.col("_lowest"), F.lit(0)))
    level = (
        F.when(F.col("kind") == "open", F.col("_total") - floor)
        .when((F.col("kind") == "close") & (F.col("_total") >= floor), F.col("_total") - floor + 1)
        .otherwise(F.lit(-1))
    )
    next_close = F.lead(F.when(F.col("kind") == "close", F.col("pos"))).over(by_level)
    end = (
        F.when(F.col("kind") == "open", F.coalesce(next_close, F.col("_last") + 1))
        .when((F.col("kind") == "close") & (F.col("_level") < 0), F.lit(None))
        .otherwise(F.col("pos"))
    )
    extents = (
        nodes.withColumn("_total", F.sum(step).over(tag_so_far))
        .withColumn("_lowest", F.min("_total").over(earlier))
        .withColumn("_level", level)
        .withColumn("_last", F.max("pos").over(Window.partitionBy("page_id", *within)))
        .withColumn("end_pos", end)
    )
    for column in running:
        at_close = F.lead(F.when(F.col("kind") == "close", F.col(column))).over(by_level)
        extents = extents.withColumn(
            f"{column}_end", F.coalesce(at_close, F.max(column).over(whole_page()))
        )
    return extents.drop("_total", "_lowest", "_level", "_last")


def drop_subtrees(extents: DataFrame, condition: Column, first_only: bool = False) -> DataFrame:
    """Remove the subtrees of the opens matching ``condition`` (all, or the first of a page)."""
    hit = (F.col("kind") == "open") & F.coalesce(condition, F.lit(False))
    rows = extents.withColumn("_hit", hit)
    if first_only:
        first = F.min(F.when(F.col("_hit"), F.col("pos"))).over(whole_page())
        rows = rows.withColumn("_hit", F.col("_hit") & (F.col("pos") == first))
    reach = F.max(F.when(F.col("_hit"), F.col("end_pos"))).over(so_far())
    return (
        rows.withColumn("_reach", reach)
        .filter(F.col("_reach").isNull() | (F.col("pos") > F.col("_reach")) | F.col("tok").isNull())
        .drop("_hit", "_reach")
    )


def drop_by_id(nodes: DataFrame, element_id: str) -> DataFrame:
    """Remove the first element with the given id."""
    return drop_subtrees(
        element_extents(nodes), attribute_of(F.col("tok"), "id") == element_id, first_only=True
    ).drop("end_pos")


def visible_text(nodes: DataFrame, separator: str = "", name: str = "text") -> DataFrame:
    """Text of each page, text nodes joined with ``separator``."""
    text = F.when(F.col("kind") == "text", decode_known(F.col("tok")))
    joined = F.expr(f"listagg(_text, '{separator}') within group (order by pos)")
    return (
        nodes.withColumn("_text", text).groupBy("page_id")
        .agg(F.coalesce(joined, F.lit("")).alias(name))
    )


def flag_first(nodes: DataFrame, hit: Column, name: str, inner: bool = False) -> DataFrame:
    """Boolean column: the node lies in the first element for which ``hit`` holds.

    The element ends where the nesting of its own tag, counted from its open tag, returns to
    zero, so the page order is the only sort needed. With ``inner`` the element's own tags
    are left out.
    """
    at = F.when(hit, F.col("pos"))
    started, nest = first_element()
    inside = F.coalesce(F.col("pos") > F.col("_first"), F.lit(False)) if inner else started
    return (
        nodes.withColumns({"_first": F.min(at).over(whole_page()), "_first_tag": F.min_by("tag", at).over(whole_page())})
        .withColumn("_nest", nest)
        .withColumn("_ended", F.min(F.when(started, F.col("_nest"))).over(so_far()))
        .withColumn(name, inside & (F.coalesce(F.col("_ended"), F.lit(1)) >= 1))
        .drop("_first", "_first_tag", "_nest", "_ended")
    )


def first_element() -> tuple[Column, Column]:
    """``(started, nesting)`` of the element at ``_first`` with tag ``_first_tag``."""
    started = F.coalesce(F.col("pos") >= F.col("_first"), F.lit(False))
    same = started & (F.col("tag") == F.col("_first_tag"))
    step = F.when(same & (F.col("kind") == "open"), 1).when(same & (F.col("kind") == "close"), -1).otherwise(0)
    return started, F.sum(step).over(so_far())
