"""Page tables and the augmented view used to exercise image and block markup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def load_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """``(page_id, url, html)`` from a table file, in any format Spark reads with those columns.

    ``fmt`` "html_files" reads one file per page, named by its URL-encoded address. Spark skips
    files of length zero; join with the URL list to see them.
    """
    if fmt != "html_files":
        return spark.read.format(fmt).load(path).select("page_id", "url", "html")
    files = spark.read.format("binaryFile").load(path)
    name = F.regexp_replace(F.regexp_extract("path", "[^/]*$", 0), r"\.html$", "")
    # Listed paths are URL-encoded once more by the file system layer.
    return files.select(
        F.xxhash64("path").alias("page_id"), F.coalesce(_decoded(_decoded(name)), name).alias("url"),
        F.col("content").cast("string").alias("html"),
    )


def _decoded(name: Column) -> Column:
    return F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


def test_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_pages(spark, f"{sf_dir}/pages.parquet")


def _insert(page_id: Column) -> Column:
    rest = page_id % 6
    number = page_id.cast("string")
    return (
        F.when(rest == 0, F.lit(
            '<table class="t"><thead><tr><th>Hole</th><th>Par</th></tr></thead>'
            "<tbody><tr><td>1</td><td><b>4</b></td></tr><tr><td>2</td><td>3 &amp; up</td></tr></tbody></table>"))
        .when(rest == 1, F.lit(
            "<blockquote><p>Quoted &amp; kept.</p><p>Second <b>one</b>.</p></blockquote>"
            "<blockquote>Bare quote</blockquote>"))
        .when(rest == 2, F.lit(
            '<pre class="x">a &lt; b\n  "c"</pre><hr class="s"><img alt="none">'
            '<graphic url="//cdn.example.org/g.jpg">'))
        .when(rest == 3, F.concat(
            F.lit('<iframe src="https://www.youtube.com/embed/v'), number,
            F.lit('"></iframe><form action="/book"><p>Book now</p></form>')))
        .when(rest == 4, F.lit(
            "<ul><li>One <i>x</i></li><li>Two<ul><li>Two a</li><li>Two b</li></ul></li></ul>"
            '<ol><li>First</li></ol><table><tr><td>cell <img src="icon.png?v=1" alt="icon"> tail</td></tr></table>'))
        .otherwise(F.concat(
            F.lit('<figure><img src="../pic/'), (page_id % 7).cast("string"),
            F.lit('.png" title="Fig"><figcaption>Caption '), (page_id % 3).cast("string"),
            F.lit('</figcaption></figure><div class="gallery"><img src="/g/1.jpg"><img src="/g/2_b-c%20d.jpg">'
                  '<img src="/g/3.jpg"></div><p><a class="button" href="/go">Go</a></p><div class="columns">'
                  '<div class="column">Left side</div><div class="column">Right side</div></div>')))
    )


def augmented_pages(pages: DataFrame) -> DataFrame:
    """Pages whose ``<br>`` became images and whose article ends with other block markup."""
    image = F.concat(
        F.lit('<img data-src="/img/'), (F.col("page_id") % 17).cast("string"),
        F.lit('.jpg" alt="pic & '), (F.col("page_id") % 5).cast("string"), F.lit('">'),
    )
    with_images = F.replace(F.col("html"), F.lit("<br>"), image)
    tail = F.concat(_insert(F.col("page_id")), F.lit("</article>"))
    return pages.select("page_id", "url", F.replace(with_images, F.lit("</article>"), tail).alias("html"))
