"""Structural selectors: children, siblings, lists, attributes and positions, matched in one pass over a page's tags.

A selector is a row of steps, each a compound and what links it to the step before. Per element one number holds which
steps it satisfies, a bit each; on the way through the tags a stack keeps these numbers for the open elements.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pageloom.functions.html import attribute, attribute_of
from pageloom.operators.vocab import BLOCK_TAGS

_NAME = r"[a-zA-Z_][a-zA-Z0-9_-]*"
_ATTR = r"\[\s*({0}[a-zA-Z_:][-a-zA-Z0-9_:.]*)\s*(?:({0}[~|^$*]?=)\s*({0}\"[^\"]*\"|'[^']*'|[^\s\]\"'=]+)\s*)?\]"
_ATTR, _ANY_ATTR = _ATTR.replace("{0}", ""), _ATTR.replace("{0}", "?:")
_NTH, _ANY_NTH = r":nth-child\(\s*([0-9]{1,9})\s*\)", r":nth-child\(\s*[0-9]{1,9}\s*\)"
_COMPOUND = (
    r"(?=[*a-zA-Z_#.\[:])(?:\*|" + _NAME + r")?(?:#[a-zA-Z0-9_-]+|\.[a-zA-Z0-9_-]+|"
    + _ANY_ATTR + "|:first-child|" + _ANY_NTH + ")*"
)
_LINK = r"(\s*[>+~,]\s*|\s+|^)"
_SELECTOR = rf"^(?:{_COMPOUND})(?:(?:\s*[>+~,]\s*|\s+)(?:{_COMPOUND}))*$"
#: Steps of a selector, all its alternatives together; longer ones count as not supported.
MAX_STEPS = 62


def structural_steps(css: Column) -> Column:
    """Array of steps ``(link, tag, id, classes, attrs, nth)`` of a selector; NULL when it is outside the grammar.

    ``link`` is '' where an alternative starts, else ' ', '>', '+' or '~'. Supported compounds: tag or ``*``, ``#id``, ``.class``,
    ``[name]`` with ``=``, ``~=``, ``|=``, ``^=``, ``$=`` or ``*=``, ``:first-child`` and ``:nth-child(number)``.
    """
    css = F.trim(F.regexp_replace(css, r"^[\t\n\r\f ]+|[\t\n\r\f ]+$", ""))
    pattern = F.lit(rf"{_LINK}({_COMPOUND})")
    links, compounds = (F.regexp_extract_all(css, pattern, F.lit(k)) for k in (1, 2))

    def attrs(compound: Column) -> Column:
        names, kinds, values = (F.regexp_extract_all(compound, F.lit(_ATTR), F.lit(k)) for k in (1, 2, 3))
        return F.transform(F.arrays_zip(names.alias("name"), kinds.alias("kind"), values.alias("value")), lambda a: F.struct(
            F.lower(a["name"]).alias("name"), a["kind"].alias("kind"), F.regexp_replace(a["value"], "^[\"']|[\"']$", "").alias("value")))

    def step(pair: Column) -> Column:
        link = F.regexp_replace(pair["link"], r"\s+", "")
        compound = pair["compound"]
        plain = F.regexp_replace(compound, r"\[(?:\"[^\"]*\"|'[^']*'|[^\]\"'])*\]", "")
        nth = F.regexp_extract(plain, _NTH, 1)
        return F.struct(
            F.when(link == ",", "").when((link == "") & (pair["link"] != ""), " ").otherwise(link).alias("link"),
            F.lower(F.regexp_extract(plain, f"^({_NAME})", 1)).alias("tag"),
            F.regexp_extract(plain, r"#([a-zA-Z0-9_-]+)", 1).alias("id"),
            F.regexp_extract_all(F.regexp_replace(plain, r":[a-z-]+(\([^)]*\))?", ""), F.lit(r"\.([a-zA-Z0-9_-]+)"), F.lit(1)).alias("classes"),
            attrs(compound).alias("attrs"),
            F.when(nth != "", nth.cast("int")).when(plain.contains(":first-child"), 1).otherwise(0).alias("nth"),
        )

    steps = F.transform(F.arrays_zip(links.alias("link"), compounds.alias("compound")), step)
    return F.when(css.rlike(_SELECTOR) & (F.size(steps) <= MAX_STEPS), steps)


def is_structural(css: Column) -> Column:
    """The selector needs this module: it holds more than tags, ids and classes one inside the other."""
    return css.rlike(r"[>+~,*:\[]")


def _attribute_holds(tok: Column, a: Column) -> Column:
    value, want, kind = attribute(tok, a["name"], normal=True), a["value"], a["kind"]
    part = want != ""
    return F.coalesce(
        F.when(kind == "", value.isNotNull()).when(kind == "=", value == want)
        .when(kind == "~=", F.array_contains(F.split(value, r"\s+"), want) & part)
        .when(kind == "|=", (value == want) | value.startswith(F.concat(want, F.lit("-"))))
        .when(kind == "^=", value.startswith(want) & part).when(kind == "$=", value.endswith(want) & part)
        .when(kind == "*=", value.contains(want) & part), F.lit(False))


def _step_matches(step: Column, tok: Column, tag: Column) -> Column:
    """A node's own tag satisfies a step's compound (its position aside)."""
    classes = F.split(F.coalesce(attribute_of(tok, "class"), F.lit("")), r"\s+")
    return (
        ((step["tag"] == "") | (step["tag"] == tag))
        & ((step["id"] == "") | F.coalesce(attribute_of(tok, "id") == step["id"], F.lit(False)))
        & ((F.size(step["classes"]) == 0) | (F.size(F.array_except(step["classes"], classes)) == 0))
        & F.forall(step["attrs"], lambda a: _attribute_holds(tok, a))
    )


def _bit(k: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), k.cast("int"))


def _mask(steps: Column, chosen) -> Column:
    """Number with the bit of every step for which ``chosen(step, k)`` holds."""
    bits = F.transform(steps, lambda s, k: F.when(chosen(s, k), _bit(k)).otherwise(F.lit(0).cast("bigint")))
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b))


_TAG_KINDS = ("open", "close", "void")
_FRAME = "struct<tag:string,own:bigint,above:bigint,last:bigint,sibs:bigint,n:int>"


def _innermost(stack: Column, *tags: str) -> Column:
    """Frames from the innermost one with such a tag up to the top; 0 if there is none."""
    found = [F.array_position(F.reverse(F.transform(stack, lambda f: f["tag"])), tag) for tag in tags]
    near = F.least(*[F.when(at > 0, at) for at in found]) if len(found) > 1 else F.when(found[0] > 0, found[0])
    return F.coalesce(near, F.lit(0).cast("bigint"))


def structural_hits(nodes: DataFrame) -> DataFrame:
    """``(page_id, hit_pos)``: the first element of each page that its selector (``_steps``) matches.

    One pass over the page's tags in order, in one expression. A closing tag ends the innermost open element of its name and all
    inside it; a block-level tag ends an open paragraph, and a list item the one before it in its list.
    """
    is_tag = F.col("kind").isin(*_TAG_KINDS)
    rows = nodes.filter(F.col("_steps").isNotNull() & is_tag).select(
        "page_id", "_steps", _tag_of(F.col("pos"), F.col("kind"), F.col("tag"), F.col("tok")).alias("_tag"))
    pages = rows.groupBy("page_id").agg(F.first("_steps").alias("_steps"), F.array_sort(F.collect_list("_tag")).alias("_tags"))
    return _first_hits(pages).select("page_id", "hit_pos").filter("hit_pos is not null")


def with_structural_hits(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``hit_pos``, as :func:`structural_hits` finds it for their selector (``css``); NULL where that is a plain one or matches nothing.

    The rows of a page are put side by side for the pass and taken apart again, so that they are worked out once. Rows
    without ``page_id`` have no hit. Where rows of one page differ in their selector, one of those that need the pass counts.
    """
    css = F.when(is_structural(F.col("css")), F.col("css"))
    rest = [c for c in nodes.columns if c != "page_id"]
    pages = nodes.groupBy("page_id").agg(F.max(css).alias("_css"), F.collect_list(F.struct(*rest)).alias("_nodes"))
    pages = pages.withColumn("_steps", F.when(F.col("page_id").isNotNull(), structural_steps(F.col("_css"))))
    tags = F.filter("_nodes", lambda n: n["kind"].isin(*_TAG_KINDS) & (n["css"] == F.col("_css")))
    tags = F.array_sort(F.transform(tags, lambda n: _tag_of(n["pos"], n["kind"], n["tag"], n["tok"])))
    hits = _first_hits(pages.withColumn("_tags", F.when(F.col("_steps").isNotNull(), tags)))
    return hits.select("page_id", "hit_pos", F.inline("_nodes"))


def _tag_of(pos: Column, kind: Column, tag: Column, tok: Column) -> Column:
    """A tag for :func:`_first_hits`: ``bits`` are the steps (``_steps``) that it satisfies by itself."""
    bits = F.when(kind != "close", _mask(F.col("_steps"), lambda s, k: _step_matches(s, tok, tag))).otherwise(F.lit(0).cast("bigint"))
    return F.struct(pos.alias("pos"), kind.alias("kind"), tag.alias("tag"), bits.alias("bits"))


def _first_hits(pages: DataFrame) -> DataFrame:
    """``pages`` with ``hit_pos``, from ``_steps`` and the tags of the page in order (``_tags``, see :func:`_tag_of`)."""
    steps = F.col("_steps")
    masks = {name: _mask(steps, lambda s, k, link=link: s["link"] == link) for name, link in (
        ("_first", ""), ("_desc", " "), ("_child", ">"), ("_next", "+"), ("_later", "~"))}
    following = lambda k: F.get(F.transform(steps, lambda s: s["link"]), k + 1)
    pages = pages.withColumns({
        **masks, "_final": _mask(steps, lambda s, k: F.coalesce(following(k), F.lit("")) == ""),
        "_nths": F.transform(steps, lambda s: s["nth"]),
    })
    zero = F.lit(0).cast("bigint")
    start = F.struct(
        F.array(F.struct(F.lit("").alias("tag"), zero.alias("own"), zero.alias("above"), zero.alias("last"), zero.alias("sibs"),
                         F.lit(0).alias("n"))).cast(f"array<{_FRAME}>").alias("stack"),
        F.lit(None).cast("bigint").alias("at"))

    def cut(stack: Column, frames: Column) -> Column:
        return F.slice(stack, F.lit(1), F.greatest(F.size(stack) - frames, F.lit(1)).cast("int"))

    def bind(value: Column, use) -> Column:
        return F.get(F.transform(F.array(value), use), F.lit(0))

    def opened(state: Column, e: Column) -> Column:
        item = _innermost(state["stack"], "li")
        within_list = _innermost(state["stack"], "ul", "ol")
        ended = F.when((e["tag"] == "li") & (item > 0) & ((within_list == 0) | (item < within_list)), item).when(
            e["tag"].isin(*BLOCK_TAGS), _innermost(state["stack"], "p")).otherwise(zero)
        return bind(cut(state["stack"], ended), lambda stack: placed(stack, e))

    def placed(stack: Column, e: Column) -> Column:
        return bind(F.element_at(stack, -1), lambda parent: bind(own_bits(parent, e), lambda own: F.struct(
            F.concat(
                F.slice(stack, F.lit(1), F.size(stack) - 1),
                F.array(F.struct(parent["tag"].alias("tag"), parent["own"].alias("own"), parent["above"].alias("above"), own.alias("last"),
                                 parent["sibs"].bitwiseOR(own).alias("sibs"), (parent["n"] + 1).alias("n"))),
                F.when(e["kind"] == "open", F.array(F.struct(
                    e["tag"].alias("tag"), own.alias("own"), parent["above"].bitwiseOR(own).alias("above"), zero.alias("last"), zero.alias("sibs"),
                    F.lit(0).alias("n")))).otherwise(F.array().cast(f"array<{_FRAME}>")),
            ).cast(f"array<{_FRAME}>").alias("stack"),
            F.when(own.bitwiseAND(F.col("_final")) != 0, e["pos"]).alias("at"))))

    def own_bits(parent: Column, e: Column) -> Column:
        def after(bits: Column, mask: str) -> Column:
            return F.shiftleft(bits, 1).bitwiseAND(F.col(mask))

        allowed = F.col("_first").bitwiseOR(after(parent["above"], "_desc")).bitwiseOR(after(parent["own"], "_child")).bitwiseOR(
            after(parent["last"], "_next")).bitwiseOR(after(parent["sibs"], "_later"))
        wrong = F.aggregate(
            F.transform(F.col("_nths"), lambda nth, k: F.when((nth > 0) & (nth != parent["n"] + 1), _bit(k)).otherwise(zero)),
            zero, lambda a, b: a.bitwiseOR(b))
        return e["bits"].bitwiseAND(allowed).bitwiseAND(F.bitwise_not(wrong))

    def ended(state: Column, e: Column) -> Column:
        near = F.array_position(F.reverse(F.transform(state["stack"], lambda f: f["tag"])), e["tag"])
        return F.struct(cut(state["stack"], near).alias("stack"), state["at"].alias("at"))

    def merge(state: Column, e: Column) -> Column:
        return F.when(state["at"].isNotNull(), state).when(e["kind"] == "close", ended(state, e)).otherwise(opened(state, e))

    return pages.withColumn("hit_pos", F.aggregate("_tags", start, merge, lambda s: s["at"]))
