"""Headings and the title cascade."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pageloom.functions.html import attribute_of, decode_known
from pageloom.functions.text import strip, trim_title_suffix
from pageloom.operators.nodes import flag_first, html_nodes, node_depths, opens, whole_page, so_far
from pageloom.operators.vocab import BOILERPLATE_HEADINGS, CHROME_TAGS, CTA_ID, HEADING_TAGS


def _heading_number():
    return F.sum(F.when(opens(*HEADING_TAGS), 1).otherwise(0)).over(so_far()).cast("bigint")


def headings(nodes: DataFrame) -> DataFrame:
    """``(page_id, heading_id, pos, tag, text)`` of h1-h3 in document order.

    Text nodes are trimmed and joined without a separator, as in ``Foo <b>bar</b>`` to ``Foobar``.
    """
    rows = node_depths(nodes, {"_in_heading": HEADING_TAGS}, heading_id=_heading_number())
    rows = rows.filter(F.col("_in_heading") > 0)
    rows = rows.withColumn("_text", F.when(F.col("kind") == "text", strip(decode_known(F.col("tok")))))
    is_open = opens(*HEADING_TAGS)
    return rows.groupBy("page_id", "heading_id").agg(
        F.min("pos").alias("pos"),
        F.min_by("tag", F.when(is_open, F.col("pos"))).alias("tag"),
        F.coalesce(F.expr("listagg(_text, '') within group (order by pos)"), F.lit("")).alias("text"),
    )


def boilerplate_headings_dim(spark) -> DataFrame:
    """The fixed headings that belong to a site template rather than to a page."""
    return spark.createDataFrame([(h,) for h in BOILERPLATE_HEADINGS], "heading string")


def drop_boilerplate_headings(heads: DataFrame, dim: DataFrame | None = None) -> DataFrame:
    """Remove empty headings and those in the boilerplate list."""
    if dim is None:
        return heads.filter((F.col("text") != "") & ~F.lower("text").isin(*BOILERPLATE_HEADINGS))
    matched = F.lower(heads["text"]) == dim["heading"]
    return heads.filter(F.col("text") != "").join(dim, matched, "left_anti")


def page_titles(pages: DataFrame, nodes: DataFrame | None = None, skip: tuple[str, ...] = BOILERPLATE_HEADINGS,
                cta_id: str | None = CTA_ID, partitioned: bool = False) -> DataFrame:
    """``(page_id, url, title, title_source)``.

    ``skip`` lists headings (lower case) and ``cta_id`` the id of an element that belong to a site's template.

    Cascade: override, first content heading, ``<title>`` without its suffix, ``og:title``,
    "Untitled". One pass over the nodes: every candidate becomes a slot row, then two
    aggregations on the page's own partition pick the winner.
    """
    carry = tuple(c for c in ("url", "title_override") if c in pages.columns)
    base = html_nodes(pages, carry, partitioned, prune=True) if nodes is None else nodes
    override = F.col("title_override") if "title_override" in base.columns else F.lit(None).cast("string")

    # All page-ordered flags in shared window operators, so that the page is scanned once.
    flagged = node_depths(
        base.withColumn("_body", F.min(F.when(opens("body"), F.col("pos"))).over(whole_page())),
        {"_in_title": ("title",), "_chrome": CHROME_TAGS, "_in_heading": HEADING_TAGS},
        _title_no=F.sum(F.when(opens("title"), 1).otherwise(0)).over(so_far()), heading_id=_heading_number(),
    )
    flagged = flagged.withColumn(
        "_work", (F.col("_chrome") == 0) & (F.col("_body").isNull() | (F.col("pos") >= F.col("_body")))
    )
    # Body text is done with; only text of headings and titles goes through the windows below.
    needless = (F.col("kind") == "text") & (F.col("_in_heading") == 0) & (F.col("_in_title") == 0) & (F.col("pos") > 0)
    flagged = flagged.filter(~F.coalesce(needless, F.lit(False)))
    cta = F.col("_work") & (F.col("kind") == "open") & (attribute_of(F.col("tok"), "id") == cta_id)
    flagged = flag_first(flagged, F.coalesce(cta, F.lit(False)), "_cta")

    is_text = F.col("kind") == "text"
    og = (F.col("tag") == "meta") & (attribute_of(F.col("tok"), "property") == "og:title")
    in_heading = F.col("_work") & ~F.col("_cta") & (F.col("_in_heading") > 0)
    in_title = (F.col("_in_title") > 0) & (F.col("_title_no") == 1)
    slot = (
        F.when(in_heading & is_text, F.col("heading_id"))
        .when(in_title & is_text, F.lit(-1))
        .when(og, F.lit(-2))
        .otherwise(F.lit(-3))
    )
    text = (
        F.when(F.col("_slot") >= 0, strip(decode_known(F.col("tok"))))
        .when(F.col("_slot") == -1, decode_known(F.col("tok")))
        .when(F.col("_slot") == -2, strip(attribute_of(F.col("tok"), "content")))
    )
    slots = (
        flagged.withColumn("_slot", slot.cast("bigint"))
        .filter((F.col("_slot") > -3) | (F.coalesce(F.col("pos"), F.lit(0)) == 0))
        .select("page_id", "url", override.alias("_override"), "pos", "_slot", text.alias("_text"))
        .groupBy("page_id", "url", "_slot")
        .agg(
            F.max("_override").alias("_override"),
            F.expr("listagg(_text, '') within group (order by pos)").alias("_text"),
            F.min_by("_text", "pos").alias("_first"),
        )
    )
    usable = (F.col("_slot") >= 0) & (F.col("_text") != "") & ~F.lower("_text").isin(*skip)
    picked = slots.groupBy("page_id", "url").agg(
        F.max("_override").alias("_override"),
        F.min_by("_text", F.when(usable, F.col("_slot"))).alias("_heading"),
        F.max(F.when(F.col("_slot") == -1, F.col("_text"))).alias("_title"),
        F.max(F.when(F.col("_slot") == -2, F.col("_first"))).alias("_og"),
    )
    override_ok = F.coalesce(F.col("_override"), F.lit("")) != ""
    title_ok = F.coalesce(F.col("_title"), F.lit("")) != ""
    og_ok = F.coalesce(F.col("_og"), F.lit("")) != ""
    return picked.select(
        "page_id", "url",
        F.when(override_ok, F.col("_override"))
        .when(F.col("_heading").isNotNull(), F.col("_heading"))
        .when(title_ok, trim_title_suffix(F.col("_title")))
        .when(og_ok, F.col("_og"))
        .otherwise(F.lit("Untitled")).alias("title"),
        F.when(override_ok, F.lit("override"))
        .when(F.col("_heading").isNotNull(), F.lit("heading"))
        .when(title_ok, F.lit("title"))
        .when(og_ok, F.lit("og"))
        .otherwise(F.lit("none")).alias("title_source"),
    )
