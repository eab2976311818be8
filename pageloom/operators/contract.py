"""The cleaned-HTML contract: enforcing it on node rows, and checking outside cleaners against it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pageloom.functions.html import attribute_of, decode_known, escape_text
from pageloom.functions.text import collapse_ws, strip_code_fence, word_count
from pageloom.operators.media import TOKEN_PATTERN, token_text
from pageloom.operators.nodes import before, drop_subtrees, element_extents, node_depth, opens, whole_page, so_far
from pageloom.operators.vocab import (
    BLOCK_TAGS, BOILERPLATE_CONTAINERS, BOILERPLATE_RULES, CONTAINER_TAGS, INLINE_TAGS, TAG_RENAMES, WHITELIST,
    WRAPPER_TAGS,
)

_TAG_KINDS = ("open", "close", "void")


def normalize_tags(nodes: DataFrame) -> DataFrame:
    """h1 to h2, b to strong, i to em; ``u`` is unwrapped. Attributes stay as they are."""
    renames = F.create_map(*[F.lit(v) for pair in TAG_RENAMES.items() for v in pair])
    is_tag = F.col("kind").isin(*_TAG_KINDS)
    new = F.coalesce(F.element_at(renames, F.col("tag")), F.col("tag"))
    lead = F.when(F.col("closing"), F.lit("</")).otherwise(F.lit("<"))
    rest = F.expr("substring(tok, length(tag) + if(closing, 3, 2))")
    renamed = is_tag & F.col("tag").isin(*TAG_RENAMES)
    dropped = is_tag & (F.col("tag") == "u")
    return (
        nodes.filter(~F.coalesce(dropped, F.lit(False)))
        .withColumn("tok", F.when(renamed, F.concat(lead, new, rest)).otherwise(F.col("tok")))
        .withColumn("tag", F.when(renamed, new).otherwise(F.col("tag")))
    )


def enforce_whitelist(nodes: DataFrame, breaks: bool = False) -> DataFrame:
    """Keep whitelisted tags and all text; other tags are unwrapped, scripts and comments go.

    With ``breaks``, an unwrapped block-level tag leaves a row of kind ``break``, so that text on
    its two sides does not run together.
    """
    kind, tag = F.col("kind"), F.col("tag")
    is_tag = kind.isin(*_TAG_KINDS)
    allowed = kind.isNull() | kind.isin("text", "image") | (is_tag & tag.isin(*WHITELIST))
    if not breaks:
        return nodes.filter(allowed)
    border = is_tag & tag.isin(*BLOCK_TAGS) & ~tag.isin(*WHITELIST)
    border = F.coalesce(border, F.lit(False))
    return nodes.filter(allowed | border).withColumn("kind", F.when(border, F.lit("break")).otherwise(kind))


def strip_attributes(nodes: DataFrame) -> DataFrame:
    """Tags without attributes, except ``href`` on links; void tags as ``<br/>``."""
    kind, tag, tok = F.col("kind"), F.col("tag"), F.col("tok")
    href = attribute_of(tok, "href")
    link = F.concat(F.lit('<a href="'), F.replace(escape_text(href), F.lit('"'), F.lit("&quot;")), F.lit('">'))
    rebuilt = (
        F.when((kind == "open") & (tag == "a") & (href != ""), link)
        .when(kind == "open", F.concat(F.lit("<"), tag, F.lit(">")))
        .when(kind == "close", F.concat(F.lit("</"), tag, F.lit(">")))
        .when(kind == "void", F.concat(F.lit("<"), tag, F.lit("/>")))
        .otherwise(tok)
    )
    return nodes.withColumn("tok", rebuilt)


def unwrap_inline(nodes: DataFrame) -> DataFrame:
    """Inside a block: only inline tags and text remain."""
    kind = F.col("kind")
    return nodes.filter(kind.isin("text", "image") | (kind.isin(*_TAG_KINDS) & F.col("tag").isin(*INLINE_TAGS)))


def clean_rows(indexed: DataFrame) -> DataFrame:
    """Content rows under the contract, text decoded and escaped once; the input of the block stage."""
    rows = strip_attributes(enforce_whitelist(normalize_tags(indexed), breaks=True))
    text = escape_text(decode_known(F.col("tok")))
    return rows.withColumn("tok", F.when(F.col("kind") == "text", text).otherwise(F.col("tok")))


def unwrap_page_wrapper(nodes: DataFrame) -> DataFrame:
    """Peel ``div/article/section/main/body`` while it is the fragment's only element.

    The n-th tag from the front is peeled when it closes at the n-th tag from the back and all
    tags before it were peeled, so every level goes in one pass.
    """
    is_tag = F.coalesce(F.col("kind").isin(*_TAG_KINDS), F.lit(False))
    rows = nodes.withColumn("_rank", F.sum(F.when(is_tag, 1).otherwise(0)).over(so_far()))
    rows = element_extents(rows, ("_rank",)).withColumn("_count", F.max("_rank").over(whole_page()))
    mirrored = opens(*WRAPPER_TAGS) & (F.col("_rank_end") == F.col("_count") - F.col("_rank") + 1)
    peels = F.min(F.when(is_tag, F.coalesce(mirrored, F.lit(False)))).over(so_far())
    rows = rows.withColumn("_peel", is_tag & peels)
    rows = rows.withColumn("_peeled", F.sum(F.when(F.col("_peel"), 1).otherwise(0)).over(whole_page()))
    tail = is_tag & (F.col("_rank") > F.col("_count") - F.col("_peeled"))
    return rows.filter(~F.col("_peel") & ~tail).drop("_rank", "_rank_end", "_count", "_peel", "_peeled", "end_pos")


def boilerplate_reason() -> Column:
    """Why a container is boilerplate, from its class and id; NULL when it is not."""
    tok = F.col("tok")
    names = F.lower(F.concat_ws(" ", attribute_of(tok, "class"), attribute_of(tok, "id")))
    reason = F.lit(None).cast("string")
    for name, pattern in reversed(BOILERPLATE_RULES):
        reason = F.when(names.rlike(pattern), F.lit(name)).otherwise(reason)
    return F.when(opens(*BOILERPLATE_CONTAINERS), reason)


def drop_boilerplate(nodes: DataFrame) -> DataFrame:
    """Remove the subtrees of boilerplate containers."""
    rows = element_extents(nodes.withColumn("_reason", boilerplate_reason()))
    return drop_subtrees(rows, F.col("_reason").isNotNull()).drop("end_pos", "_reason")


def boilerplate_report(nodes: DataFrame) -> DataFrame:
    """``(page_id, pos, tag, reason, words)`` of every container that :func:`drop_boilerplate` removes."""
    words = F.when(F.col("kind") == "text", word_count(F.col("tok"))).otherwise(0)
    rows = nodes.withColumn("_reason", boilerplate_reason()).withColumn("_words", F.sum(words).over(so_far()))
    rows = element_extents(rows, ("_words",))
    outer = F.max(F.when(F.col("_reason").isNotNull(), F.col("end_pos"))).over(before())
    return (
        rows.withColumn("_outer", outer)
        .filter(F.col("_reason").isNotNull() & (F.col("_outer").isNull() | (F.col("pos") > F.col("_outer"))))
        .select("page_id", "pos", "tag", F.col("_reason").alias("reason"),
                (F.col("_words_end") - F.col("_words")).cast("bigint").alias("words"))
    )


# ---------------------------------------------------------------- tokens


def token_rows(html_rows: DataFrame) -> DataFrame:
    """``(page_id, n, img_index)``: image tokens of an HTML column, in order."""
    found = F.regexp_extract_all("html", F.lit(TOKEN_PATTERN), F.lit(1))
    return html_rows.select("page_id", F.posexplode(found).alias("n", "_index")).select(
        "page_id", F.col("n").cast("bigint").alias("n"), F.col("_index").try_cast("bigint").alias("img_index")
    )


def token_integrity(images: DataFrame, output: DataFrame) -> DataFrame:
    """``(page_id, img_index, n_in, n_out, problem)`` where the token multisets differ.

    ``images`` is the page's image table, ``output`` any ``(page_id, html)``. Both sides are
    tagged and counted in one aggregation.
    """
    sides = images.select("page_id", "img_index", F.lit(1).alias("_in"), F.lit(0).alias("_out")).unionByName(
        token_rows(output).select("page_id", "img_index", F.lit(0).alias("_in"), F.lit(1).alias("_out"))
    )
    counts = sides.groupBy("page_id", "img_index").agg(F.sum("_in").alias("n_in"), F.sum("_out").alias("n_out"))
    problem = (
        F.when(F.col("n_in") == 0, F.lit("unknown")).when(F.col("n_out") == 0, F.lit("missing"))
        .otherwise(F.lit("duplicated"))
    )
    return counts.filter(F.col("n_in") != F.col("n_out")).withColumn("problem", problem)


def token_order(output: DataFrame) -> DataFrame:
    """``(page_id, n, img_index, previous)`` where a token comes after a higher one."""
    previous = F.lag("img_index").over(Window.partitionBy("page_id").orderBy("n"))
    return token_rows(output).withColumn("previous", previous).filter(F.col("img_index") < F.col("previous"))


def restore_lost_tokens(images: DataFrame, output: DataFrame) -> DataFrame:
    """``(page_id, html, restored)``: missing tokens appended as trailing paragraphs."""
    missing = token_integrity(images, output).filter(F.col("problem") == "missing").withColumn(
        "_p", F.concat(F.lit("<p>"), token_text(F.col("img_index")), F.lit("</p>"))
    )
    tails = missing.groupBy("page_id").agg(
        F.expr("listagg(_p, '\\n') within group (order by img_index)").alias("_tail"), F.count("*").alias("restored")
    )
    return output.select("page_id", "html").join(tails, "page_id", "left").select(
        "page_id",
        F.when(F.col("_tail").isNotNull(), F.concat("html", F.lit("\n"), "_tail")).otherwise(F.col("html")).alias("html"),
        F.coalesce("restored", F.lit(0)).alias("restored"),
    )


def isolate_tokens(nodes: DataFrame) -> DataFrame:
    """``(page_id, html)`` with each token alone in its own paragraph.

    A token in a paragraph ends it and starts it again; a token in a list, table or quote moves
    before that element. Paragraphs left empty by the split are removed.
    """
    rows = node_depth(nodes, CONTAINER_TAGS, "_deep")
    rows = rows.withColumn("_start", F.last(
        F.when(opens(*CONTAINER_TAGS) & (F.col("_deep") == 1), F.col("pos")), ignorenulls=True).over(so_far()))
    rows = node_depth(rows, ("p",), "_in_p")
    pieces = F.when(
        F.col("kind") == "text", F.regexp_extract_all("tok", F.lit(r"⟦IMG_\d+⟧|[^⟦]+|⟦"), F.lit(0))
    ).otherwise(F.array("tok"))
    cut = rows.select("*", F.posexplode(pieces).alias("_n", "_piece"))
    token = F.col("_piece").rlike("^" + TOKEN_PATTERN + "$")
    alone = F.concat(F.lit("<p>"), F.col("_piece"), F.lit("</p>"))
    in_flow = F.when(F.col("_in_p") > 0, F.concat(F.lit("</p>"), alone, F.lit("<p>"))).otherwise(alone)
    hoisted = token & (F.col("_deep") > 0)
    placed = cut.select(
        "page_id",
        F.when(hoisted, F.col("_start")).otherwise(F.col("pos")).alias("_a"),
        F.when(hoisted, F.lit(0)).otherwise(1).alias("_b"), F.col("pos").alias("_c"), "_n",
        F.when(hoisted, alone).when(token, in_flow).otherwise(F.col("_piece")).alias("_piece"),
    )
    html = F.expr("listagg(_piece, '') within group (order by _a, _b, _c, _n)")
    return placed.groupBy("page_id").agg(F.regexp_replace(html, r"<p>\s*</p>", "").alias("html"))


def final_gate(output: DataFrame) -> DataFrame:
    """``(page_id, passed, message)``: fails empty output and output with a token left in it."""
    leaked = F.col("html").contains("⟦IMG_")
    empty = F.length(collapse_ws(F.coalesce("html", F.lit("")))) == 0
    return output.select(
        "page_id", (~leaked & ~empty).alias("passed"),
        F.when(empty, F.lit("empty output")).when(leaked, F.lit("image token left in output")).alias("message"),
    )


# ---------------------------------------------------------------- cleaned input, fidelity


def ingest_cleaned(extracted: DataFrame, cleaned: DataFrame) -> DataFrame:
    """``(page_id, html, status, message)`` from an outside cleaner's ``cleaned(page_id, html, refused)``."""
    joined = extracted.select("page_id").join(
        cleaned.select("page_id", F.col("html").alias("_html"), "refused"), "page_id", "left"
    )
    ok = F.col("_html").isNotNull() & ~F.coalesce("refused", F.lit(False))
    return joined.select(
        "page_id", F.when(ok, strip_code_fence(F.col("_html"))).alias("html"),
        F.when(ok, F.lit("ok")).otherwise("failed").alias("status"),
        F.when(F.coalesce("refused", F.lit(False)), F.lit("cleaner refused this page"))
        .when(F.col("_html").isNull(), F.lit("no cleaned page")).alias("message"),
    )


def text_fidelity(source: DataFrame, output: DataFrame) -> DataFrame:
    """``(page_id, source_words, output_words, missing, invented)`` from two ``(page_id, text)`` tables.

    Word multisets of both sides are counted together per page and word.
    """
    def tagged(df: DataFrame, a: int, b: int) -> DataFrame:
        word = F.explode(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)))
        return df.select("page_id", word.alias("word"), F.lit(a).alias("_a"), F.lit(b).alias("_b"))

    words = tagged(source, 1, 0).unionByName(tagged(output, 0, 1)).groupBy("page_id", "word").agg(
        F.sum("_a").alias("_a"), F.sum("_b").alias("_b")
    )
    return words.groupBy("page_id").agg(
        F.sum("_a").alias("source_words"), F.sum("_b").alias("output_words"),
        F.sum(F.greatest(F.col("_a") - F.col("_b"), F.lit(0))).alias("missing"),
        F.sum(F.greatest(F.col("_b") - F.col("_a"), F.lit(0))).alias("invented"),
    )
