"""URL lists, selector lists and the page bundle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pageloom.functions.text import strip
from pageloom.operators.skew import ranged_prefix
from pageloom.session import materialize
from pageloom.sources.snapshots import read_snapshot, write_snapshot


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """``(ordinal, url, title_override)`` from text files, in the order of path and line; see :func:`parse_url_lines`.

    Lines are Spark's own rows, so a large file is read in pieces by many tasks. Their order is that of the file's
    blocks, which the number of a row within its piece and the piece's start give.
    """
    lines = spark.read.text(path, lineSep="\n").select(
        F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"),
                 F.monotonically_increasing_id().alias("row")).alias("at"),
        F.posexplode(F.split(F.regexp_replace("value", r"\r$", ""), r"\r")).alias("part", "line"),
    )
    placed = materialize(lines)  # the row numbers hold for this one read
    return parse_url_lines(placed.select(F.struct("at.path", "at.start", "at.row", "part").alias("line_no"), "line"))


def parse_url_lines(lines: DataFrame) -> DataFrame:
    """``(ordinal, url, title_override)`` from ``(line_no, line)``; ``line_no`` may be of any type with an order.

    Blank and ``#`` lines go; the first ``|`` starts a forced title, which may be empty. The
    ordinal counts the lines kept.
    """
    rows = lines.select("line_no", strip(F.col("line")).alias("_line")).filter(
        (F.col("_line") != "") & ~F.col("_line").startswith("#")
    )
    rest = F.expr("substring(_line, instr(_line, '|') + 1)")
    parsed = rows.select(
        "line_no", strip(F.substring_index("_line", "|", 1)).alias("url"),
        F.when(F.col("_line").contains("|"), strip(rest)).alias("title_override"),
    )
    ranked = ranged_prefix(parsed, "line_no", F.lit(1), "_before")
    return ranked.select((F.col("_before") + 1).alias("ordinal"), "url", "title_override")


def inline_urls(spark: SparkSession, urls: list[str]) -> DataFrame:
    """``(ordinal, url)`` of one request; an empty request is an error."""
    kept = [u.strip() for u in urls if u.strip() and not u.strip().startswith("#")]
    if not kept:
        raise ValueError("No URLs provided.")
    return spark.createDataFrame(list(enumerate(kept, start=1)), "ordinal bigint, url string")


def request_urls(requests: DataFrame) -> DataFrame:
    """``(request_id, pos, url)`` from ``(request_id, urls array)``, one row per usable URL."""
    rows = requests.select("request_id", F.posexplode("urls").alias("pos", "_url")).select(
        "request_id", F.col("pos").cast("bigint").alias("pos"), strip(F.col("_url")).alias("url")
    )
    return rows.filter((F.col("url") != "") & ~F.col("url").startswith("#"))


def dedup_urls_ordered(urls: DataFrame) -> DataFrame:
    """``(url, ordinal)``: first occurrence of each URL."""
    return urls.groupBy("url").agg(F.min("ordinal").alias("ordinal"))


def cap_urls(urls: DataFrame, n: int) -> DataFrame:
    """The first ``n`` URLs in discovery order."""
    return urls.orderBy("ordinal").limit(n)


def selectors_table(lines: DataFrame) -> DataFrame:
    """``(host, css)`` from ``(line_no, line)`` of the form ``domain = css``; the last line of a domain wins."""
    parts = F.split("line", "=", 2)
    rows = lines.filter(F.col("line").contains("=")).select(
        "line_no", strip(F.get(parts, F.lit(0))).alias("host"), strip(F.get(parts, F.lit(1))).alias("css")
    )
    return rows.filter((F.col("host") != "") & (F.col("css") != "")).groupBy("host").agg(
        F.max_by("css", "line_no").alias("css")
    )


def bundle_add(bundle: DataFrame, pages: DataFrame) -> DataFrame:
    """Bundle with the pages added; a page with a known link replaces the older one.

    Both are ``(link, title, content, added)``, ``added`` being the order of addition.
    """
    fields = F.struct("title", "content", "added")
    return bundle.unionByName(pages).groupBy("link").agg(F.max_by(fields, "added").alias("_p")).select("link", "_p.*")


def bundle_remove(bundle: DataFrame, links: DataFrame) -> DataFrame:
    """Bundle without the given links."""
    return bundle.join(links.select("link"), "link", "left_anti")


BUNDLE_SCHEMA = "link string, title string, content string, added bigint"


def load_bundle(spark: SparkSession, folder: str) -> DataFrame:
    """The stored bundle; empty before anything was added."""
    stored = read_snapshot(spark, folder, BUNDLE_SCHEMA)
    return spark.createDataFrame([], BUNDLE_SCHEMA) if stored is None else stored


def store_added(folder: str, pages: DataFrame) -> int:
    """Add pages to the stored bundle as :func:`bundle_add` does; returns the new version. Adding the same again changes nothing."""
    pages = pages.select("link", "title", "content", F.col("added").cast("bigint").alias("added"))
    return write_snapshot(bundle_add(load_bundle(pages.sparkSession, folder), pages), folder)


def store_removed(folder: str, links: DataFrame) -> int:
    """Remove links from the stored bundle; returns the new version."""
    return write_snapshot(bundle_remove(load_bundle(links.sparkSession, folder), links), folder)
