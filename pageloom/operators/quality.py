"""Outcomes, schedules, ledgers, attention reports and learned structure patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pageloom.functions.html import attribute_of, decode_known, html_escape
from pageloom.functions.text import collapse_ws
from pageloom.functions.urls import url_host, url_netloc
from pageloom.operators.nodes import before, element_extents, opens
from pageloom.operators.similarity import candidates, ranked, verified
from pageloom.operators.skew import bucketed_lag, bucketed_prefix, ranged_prefix, salted_join
from pageloom.operators.vocab import ATTENTION_CLASSES, ATTENTION_CONTAINERS, ATTENTION_RULES
from pageloom.session import materialize

# Fixed value: back-off of one failed attempt.
BACKOFF_SECONDS = 1.5
AUTO_CONFIDENCE = 0.5


# ---------------------------------------------------------------- jobs


def job_summary(outcomes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``(total, succeeded, failed, exit_code)``; a skipped page counts as failed."""
    failed = F.count_if(F.col("status") != "ok")
    return outcomes.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "ok").alias("succeeded"), failed.alias("failed"),
        F.when(failed > 0, F.lit(1)).otherwise(0).cast("bigint").alias("exit_code"),
    )


def progress_log(events: DataFrame) -> DataFrame:
    """``(job_id, idx, status, url, line)``: one line per page and status, the earliest event."""
    first = events.groupBy("job_id", "idx", "status").agg(F.min_by(F.struct("url", "title", "message"), "ts").alias("_e"))
    extra = F.coalesce(F.nullif(F.col("_e.title"), F.lit("")), F.nullif(F.col("_e.message"), F.lit("")))
    return first.select(
        "job_id", "idx", "status", F.col("_e.url").alias("url"),
        F.concat(F.lit("["), F.upper("status"), F.lit("] "), F.col("_e.url"),
                 F.coalesce(F.concat(F.lit(" — "), extra), F.lit(""))).alias("line"),
    )


def job_progress(events: DataFrame) -> DataFrame:
    """``(job_id, done, total, percent)`` from page events that may repeat."""
    lines = events.groupBy("job_id", "idx").agg(F.max("total").alias("total"))
    return lines.groupBy("job_id").agg(F.count("*").alias("done"), F.max("total").alias("total")).withColumn(
        "percent", F.when(F.col("total") > 0, F.round(F.col("done") * 100 / F.col("total"))).otherwise(0.0).cast("bigint")
    )


# ---------------------------------------------------------------- fetching


def politeness_schedule(urls: DataFrame, rate_seconds: float = 1.0, order: str = "page_id",
                        bucket: int | None = None) -> DataFrame:
    """``(page_id, netloc, start_second)``: earliest start with the given gap per authority.

    The position within an authority is counted in two levels, so one busy site does not end up
    in one task: by sampled ranges of ``order``, or by steps of ``bucket`` where the numbers are known
    to be dense. Pages without URL form an authority of their own (NULL).
    """
    keyed = urls.select("page_id", *([] if order == "page_id" else [order]), url_netloc(F.col("url")).alias("netloc"))
    if bucket is None:
        ranked = ranged_prefix(keyed, order, F.lit(1), "_before", ("netloc",))
    else:
        ranked = bucketed_prefix(keyed, order, F.lit(1), "_before", bucket, ("netloc",))
    return ranked.select("page_id", "netloc", (F.col("_before") * F.lit(rate_seconds)).alias("start_second"))


def rate_audit(log: DataFrame, key: str, ident: str, rate_seconds: float, bucket_seconds: int = 3600) -> DataFrame:
    """``(ident, key, gap_us)`` of hits closer to the previous one of their key than allowed."""
    micros = log.select(ident, key, F.unix_micros(F.col("ts").cast("timestamp")).alias("_us"))
    bucket = F.floor(F.col("_us") / F.lit(bucket_seconds * 1_000_000)).cast("bigint")
    lagged = bucketed_lag(micros, key, F.col("_us"), "_us", "_previous", bucket, ident)
    gap = F.col("_us") - F.col("_previous")
    return lagged.filter(gap < int(rate_seconds * 1_000_000)).select(ident, key, gap.alias("gap_us"))


def retry_ledger(attempts: DataFrame, max_attempts: int | None = None) -> DataFrame:
    """``(fetch_id, attempts, succeeded, last_error, waited, over_limit)`` from ``(fetch_id, attempt, ok, error)``.

    Attempts after the first success do not count; each failure but the last waits 1.5 s times its
    number. With ``max_attempts``, later attempts are counted in ``over_limit`` only.
    """
    number, ok = F.col("attempt"), F.col("ok")
    within = F.lit(True) if max_attempts is None else number <= max_attempts
    summary = attempts.groupBy("fetch_id").agg(
        F.min(F.when(ok & within, number)).alias("_first_ok"), F.max(F.when(within, number)).alias("_last"),
        F.max_by("error", F.when(~ok & within, number)).alias("_error"), F.count_if(~within).alias("over_limit"),
    )
    used = F.coalesce("_first_ok", "_last")
    waits = used - 1
    return summary.select(
        "fetch_id", used.alias("attempts"), F.col("_first_ok").isNotNull().alias("succeeded"),
        F.when(F.col("_first_ok").isNull(), F.col("_error")).alias("last_error"),
        (waits * (waits + 1) / 2 * F.lit(BACKOFF_SECONDS)).alias("waited"), "over_limit",
    )


# ---------------------------------------------------------------- attention


def attention_reason() -> Column:
    """Why a person must look at an element; NULL for all others."""
    names = F.lower(F.concat_ws(" ", attribute_of(F.col("tok"), "class"), attribute_of(F.col("tok"), "id")))
    reason = F.lit(None).cast("string")
    for name, pattern in reversed(ATTENTION_CLASSES):
        reason = F.when(opens(*ATTENTION_CONTAINERS) & names.rlike(pattern), F.lit(name)).otherwise(reason)
    for tag, name in reversed(ATTENTION_RULES):
        reason = F.when(opens(tag), F.lit(name)).otherwise(reason)
    return reason


def _target() -> Column:
    tok = F.col("tok")
    return F.coalesce(attribute_of(tok, "src"), attribute_of(tok, "action"), attribute_of(tok, "data"), F.lit(""))


def manual_attention(nodes: DataFrame) -> DataFrame:
    """``(page_id, url, pos, reason, target, before_text, after_text)`` of elements a person must look at."""
    text = F.when((F.col("kind") == "text") & F.col("tok").rlike(r"\S"), collapse_ws(decode_known(F.col("tok"))))
    backwards = Window.partitionBy("page_id").orderBy(F.col("pos").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rows = nodes.withColumn("_text", text).withColumn(
        "before_text", F.last("_text", ignorenulls=True).over(before())
    ).withColumn("after_text", F.last("_text", ignorenulls=True).over(backwards))
    return rows.withColumn("reason", attention_reason()).filter(F.col("reason").isNotNull()).select(
        "page_id", "url", "pos", "reason", _target().alias("target"), "before_text", "after_text"
    )


def placeholder_text() -> Column:
    return F.concat(
        F.lit("<strong>[Needs manual attention: "), attention_reason(),
        F.when(_target() != "", F.concat(F.lit(" "), html_escape(_target()))).otherwise(""), F.lit("]</strong>"))


def placeholders(nodes: DataFrame) -> DataFrame:
    """Node rows where each element needing attention became one visible marker paragraph."""
    rows = element_extents(nodes.withColumn("_reason", attention_reason()))
    reach = F.max(F.when(F.col("_reason").isNotNull(), F.col("end_pos"))).over(before())
    rows = rows.withColumn("_outer", F.coalesce(F.col("pos") <= reach, F.lit(False)))
    marker = F.concat(
        F.lit("<p><strong>[Needs manual attention: "), F.col("_reason"),
        F.when(_target() != "", F.concat(F.lit(" "), _target())).otherwise(""), F.lit("]</strong></p>"),
    )
    return rows.filter(~F.col("_outer")).withColumn(
        "tok", F.when(F.col("_reason").isNotNull(), marker).otherwise(F.col("tok"))
    ).drop("_reason", "_outer", "end_pos")


# ---------------------------------------------------------------- learning


def shape() -> Column:
    """Structure key of an element: its tag and first class."""
    first = F.regexp_extract(F.coalesce(attribute_of(F.col("tok"), "class"), F.lit("")), r"\S+", 0)
    return F.concat(F.col("tag"), F.when(first != "", F.concat(F.lit("."), first)).otherwise(""))


def classify_structures(nodes: DataFrame, patterns: DataFrame, min_confidence: float = AUTO_CONFIDENCE) -> DataFrame:
    """``(page_id, pos, shape, block_type, confidence, decision)``; unknown shapes get confidence 0.

    Common shapes make up most rows, so the join to the pattern table is salted.
    """
    rows = nodes.filter(F.col("kind") == "open").select("page_id", "pos", shape().alias("shape"))
    best = patterns.groupBy("shape").agg(
        F.max_by(F.struct("block_type", "confidence"), F.struct("confidence", "block_type")).alias("_p")
    ).select("shape", "_p.block_type", "_p.confidence")
    known = salted_join(rows, best, ["shape"], "left", "page_id")
    confidence = F.coalesce("confidence", F.lit(0.0))
    return known.select(
        "page_id", "pos", "shape", "block_type", confidence.alias("confidence"),
        F.when(confidence >= min_confidence, F.lit("auto")).otherwise("placeholder").alias("decision"),
    )


def learn_patterns(patterns: DataFrame, findings: DataFrame) -> DataFrame:
    """New ``(shape, block_type, confidence, n_confirmed, n_seen)`` snapshot from ``findings(shape, block_type, confirmed)``.

    Old snapshot and findings are counted in one aggregation. Confidence is the share of
    confirmations among the sightings ``n_seen``, smoothed by one of each kind.
    """
    old = patterns.select("shape", "block_type", F.col("n_confirmed").alias("_ok"), F.col("n_seen").alias("_seen"))
    new = findings.groupBy("shape", "block_type").agg(F.count_if("confirmed").alias("_ok"), F.count("*").alias("_seen"))
    merged = old.unionByName(new).groupBy("shape", "block_type").agg(F.sum("_ok").alias("_ok"), F.sum("_seen").alias("_seen"))
    return merged.select(
        "shape", "block_type", F.round((F.col("_ok") + 1) / (F.col("_seen") + 2), 4).alias("confidence"),
        F.col("_ok").alias("n_confirmed"), F.col("_seen").alias("n_seen"),
    )


def _vocabularies(rows: DataFrame, name: str) -> DataFrame:
    """``(name, tokens, id)``: the block types of each, sorted, and as one text; as many as there are block types at most."""
    types = rows.filter(F.col("block_type").isNotNull()).groupBy(name).agg(F.array_sort(F.collect_set("block_type")).alias("tokens"))
    return types.withColumn("id", F.array_join("tokens", "\x01"))


#: Least similarity of the candidates in each round of :func:`pick_template`; the last takes whatever shares a type.
TEMPLATE_ROUNDS = (0.75, 0.4, 0.0)


def pick_template(blocks: DataFrame, templates: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """``(page_id, template, score)``: the template whose block vocabulary overlaps most with the page's.

    A page that shares no block type with any template has template NULL and score 0; ``pages`` adds those
    that have no block at all. Pages and templates with equal vocabularies are one each in the search. A round looks at pairs that share one
    of their rarest types and fit in size, by the similarity it asks for; what finds its best there takes no part in the next.
    """
    mine, theirs = materialize(_vocabularies(blocks, "page_id")), _vocabularies(templates, "template")  # read twice; blocks are dear
    named = materialize(theirs.groupBy("id", "tokens").agg(F.min("template").alias("template")))
    order = materialize(ranked(named.select("id", "tokens"), []))
    left = materialize(ranked(mine.select("id", "tokens").distinct(), [], counted=named))
    found = None
    for least in TEMPLATE_ROUNDS:
        met = verified(candidates(left, order, least, []), left, order, []).join(named.select(F.col("id").alias("b"), "template"), "b")
        scored = met.withColumn("score", F.round("similarity", 4))
        best = materialize(scored.groupBy("a").agg(
            F.max("similarity").alias("_top"), F.min_by(F.struct("template", "score"), F.struct(-F.col("score"), F.col("template"))).alias("_b")
        ).filter(F.col("_top") >= least).select(F.col("a").alias("id"), "_b"))
        found = best if found is None else found.union(best)
        left = left.join(best.select("id"), "id", "left_anti")
    chosen = salted_join(mine.select("page_id", "id"), found, ["id"], "inner", "page_id")
    every = (blocks if pages is None else pages).select("page_id").distinct()
    return every.join(chosen, "page_id", "left").select(
        "page_id", F.col("_b.template").alias("template"), F.coalesce("_b.score", F.lit(0.0)).alias("score"))


def template_conformance(blocks: DataFrame, chosen: DataFrame, templates: DataFrame) -> DataFrame:
    """``(page_id, block_pos, block_type, problem)``: blocks the template lacks, out of order, or at another level."""
    sections = templates.groupBy("template", "block_type").agg(
        F.min("section_pos").alias("_section"), F.collect_set("level").alias("_levels"))
    known = chosen.filter(F.col("template").isNotNull()).select("page_id", "template")
    rows = salted_join(blocks.join(known, "page_id"), sections,
                       ["template", "block_type"], "left", "page_id")
    order = Window.partitionBy("page_id").orderBy("block_pos")
    previous = F.last("_section", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_previous", previous)
    wrong_level = (F.size("_levels") > 0) & F.col("level").isNotNull() & ~F.array_contains("_levels", F.col("level"))
    problem = (
        F.when(F.col("_section").isNull(), F.lit("not in template"))
        .when(F.coalesce(wrong_level, F.lit(False)), F.lit("other level"))
        .when(F.col("_section") < F.col("_previous"), F.lit("out of order"))
    )
    return rows.withColumn("problem", problem).filter(F.col("problem").isNotNull()).select(
        "page_id", "block_pos", "block_type", "problem")


def host_report(outcomes: DataFrame) -> DataFrame:
    """``(host, content_source, pages, ok, images, median_blocks)`` with subtotals (NULL keys)."""
    rows = outcomes.withColumn("host", url_host(F.col("url")))
    return rows.rollup("host", "content_source").agg(
        F.count("*").alias("pages"), F.count_if(F.col("status") == "ok").alias("ok"), F.sum("images").alias("images"),
        F.percentile_approx("blocks", F.lit(0.5), F.lit(10_000)).alias("median_blocks"),
    )
