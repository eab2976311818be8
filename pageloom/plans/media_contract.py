"""Queries over images and the cleaned-HTML contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pageloom.functions.urls import safe_filename
from pageloom.operators import content as C, contract as K, media as M, nodes as N
from pageloom.session import materialize
from pageloom.sources.tables import augmented_pages, test_pages


def _aug(spark, sf_dir) -> DataFrame:
    return augmented_pages(test_pages(spark, sf_dir))


def _content(spark, sf_dir) -> DataFrame:
    return C.content_nodes(_aug(spark, sf_dir), css="article")


def _indexed(spark, sf_dir) -> DataFrame:
    return M.index_images(_content(spark, sf_dir))


def _images(spark, sf_dir) -> DataFrame:
    return M.extract_images(_content(spark, sf_dir))


def _image_table(spark, sf_dir) -> DataFrame:
    """The image table as a stored stage, for queries that read it more than once."""
    return materialize(_images(spark, sf_dir))


def _filled(df: DataFrame) -> DataFrame:
    return df.filter(F.col("kind").isNotNull())


# ---------------------------------------------------------------- images


def extract_images(spark, sf_dir):
    return _images(spark, sf_dir)


def extract_images_ext(spark, sf_dir):
    html = F.replace(F.col("html"), F.lit('<img src="/g/1.jpg">'),
                     F.lit('<img data-lazy-src="/g/1.jpg"><img srcset="/g/1-small.jpg 480w, /g/1.jpg 900w">'))
    pages = _aug(spark, sf_dir).withColumn("html", html)
    images = M.extract_images(C.content_nodes(pages, css="article"), extended=True)
    return images.select("page_id", "img_index", "src", "alt", "caption")


def tokenize_images(spark, sf_dir):
    rows = M.tokenize_images(_indexed(spark, sf_dir))
    return rows.select("page_id", "images", F.md5("html").alias("html_md5"))


def detokenize(spark, sf_dir):
    indexed = _indexed(spark, sf_dir)
    tokens = M.tokenize_images(indexed).withColumn("html", F.concat("html", F.lit("<p>⟦IMG_999⟧</p>")))
    images = indexed.filter("kind = 'image'")
    return M.detokenize(tokens, images).select("page_id", F.md5("html").alias("html_md5"))


def distinct_assets(spark, sf_dir):
    return M.distinct_assets(_images(spark, sf_dir))


def _results(images: DataFrame) -> DataFrame:
    """Upload results derived from the assets: every third asset failed."""
    assets = M.distinct_assets(images)
    size = F.length("src")
    return assets.select(
        "src", F.concat(F.lit("https://library.example.org/"), F.md5("src")).alias("url"),
        F.conv(F.substring(F.md5("src"), 1, 12), 16, 10).cast("bigint").alias("media_id"), (size % 3 != 0).alias("ok"),
    )


def plan_media(spark, sf_dir):
    images = _image_table(spark, sf_dir)
    return M.plan_media(images, "upload", _results(images))


def plan_media_sideload(spark, sf_dir):
    return M.plan_media(_images(spark, sf_dir), "sideload")


def ingest_media_results(spark, sf_dir):
    """Outside upload results joined to every image reference: how each asset fared, by use."""
    images = _image_table(spark, sf_dir)
    planned = M.plan_media(images, "upload", _results(images))
    return planned.groupBy("src", "url", "media_id").agg(F.count("*").alias("refs"))


def assign_filenames(spark, sf_dir):
    assets = M.distinct_assets(_images(spark, sf_dir))
    keyed = assets.select(
        "src", safe_filename(F.col("src")).alias("name"), F.sha2("src", 256).alias("sha256"),
        F.struct("first_page", "first_index").alias("ordinal"),
    )
    return M.assign_filenames(materialize(keyed)).select("src", "name", "file_name", "conflict")


def map_tokens_to_media(spark, sf_dir):
    """Tokens of the tokenized pages against media that lack every third image."""
    indexed = _indexed(spark, sf_dir)
    tokens = K.token_rows(M.tokenize_images(indexed))
    media = M.plan_media(indexed.filter("kind = 'image'").filter("img_index % 3 != 2"), "remote")
    return M.map_tokens_to_media(tokens, media).select("page_id", "n", "img_index", "url", "alt")


def unmapped_tokens(spark, sf_dir):
    indexed = _indexed(spark, sf_dir)
    tokens = K.token_rows(M.tokenize_images(indexed))
    media = M.plan_media(indexed.filter("kind = 'image'").filter("img_index % 3 != 2"), "remote")
    return M.unmapped_tokens(tokens, media)


def page_attachments(spark, sf_dir):
    return M.page_attachments(_images(spark, sf_dir), "sideload")


def image_inventory(spark, sf_dir):
    indexed = _indexed(spark, sf_dir)
    placed = K.token_rows(_broken(M.tokenize_images(indexed)))
    return M.image_inventory(indexed.filter("kind = 'image'"), placed)


def asset_sharing(spark, sf_dir):
    return M.asset_sharing(_images(spark, sf_dir), test_pages(spark, sf_dir))


# ---------------------------------------------------------------- contract


def normalize_tags(spark, sf_dir):
    return _filled(K.normalize_tags(_content(spark, sf_dir))).select("page_id", "pos", "tag", "tok")


def enforce_whitelist(spark, sf_dir):
    return _filled(K.enforce_whitelist(K.normalize_tags(_content(spark, sf_dir)))).select("page_id", "pos", "tag", "tok")


def strip_attributes(spark, sf_dir):
    rows = K.strip_attributes(_filled(_content(spark, sf_dir)).filter("kind in ('open', 'close', 'void')"))
    return rows.select("page_id", "pos", "tok")


def unwrap_inline(spark, sf_dir):
    return K.unwrap_inline(_content(spark, sf_dir)).select("page_id", "pos", "tok")


def unwrap_page_wrapper(spark, sf_dir):
    """Article bodies inside two wrappers; odd pages have a second element and keep them."""
    inner = F.regexp_extract("html", "(?s)<article>(.*)</article>", 1)
    wrapped = F.concat(F.lit('<div class="w"><section>'), inner, F.lit("</section></div>"))
    second = F.when(F.col("page_id") % 2 == 1, F.lit("<p>second</p>")).otherwise("")
    pages = test_pages(spark, sf_dir).select("page_id", "url", F.concat(wrapped, second).alias("html"))
    rows = K.unwrap_page_wrapper(N.html_nodes(pages))
    return rows.groupBy("page_id").agg(
        F.md5(F.expr("listagg(tok, '') within group (order by pos)")).alias("html_md5")
    )


def drop_boilerplate(spark, sf_dir):
    return K.drop_boilerplate(N.html_nodes(test_pages(spark, sf_dir))).select("page_id", "pos", "tok")


def boilerplate_report(spark, sf_dir):
    return K.boilerplate_report(N.html_nodes(_aug(spark, sf_dir)))


def _broken(tokenized: DataFrame) -> DataFrame:
    """Cleaner output that breaks the token rules: lost, repeated and renumbered tokens."""
    step, first = F.col("page_id") % 5, F.lit("<p>⟦IMG_0⟧</p>")
    html = (
        F.when(step == 0, F.replace(F.col("html"), first, F.lit("")))
        .when(step == 1, F.concat("html", first))
        .when(step == 2, F.replace(F.col("html"), first, F.lit("<p>⟦IMG_900⟧</p>")))
        .otherwise(F.col("html"))
    )
    return tokenized.select("page_id", html.alias("html"))


def token_integrity(spark, sf_dir):
    indexed = _indexed(spark, sf_dir)
    return K.token_integrity(indexed.filter("kind = 'image'"), _broken(M.tokenize_images(indexed)))


def token_order(spark, sf_dir):
    return K.token_order(_broken(M.tokenize_images(_indexed(spark, sf_dir))))


def restore_lost_tokens(spark, sf_dir):
    indexed = _indexed(spark, sf_dir)
    rows = K.restore_lost_tokens(indexed.filter("kind = 'image'"), _broken(M.tokenize_images(indexed)))
    return rows.select("page_id", F.md5("html").alias("html_md5"), F.col("restored").cast("bigint").alias("restored"))


def isolate_tokens(spark, sf_dir):
    title = F.regexp_extract("html", "(?is)<title[^>]*>([^<]*)", 1)
    html = F.concat(
        F.lit("<p>"), title, F.lit(" ⟦IMG_0⟧ tail</p><ul><li>x ⟦IMG_1⟧</li><li>y ⟦IMG_2⟧ z</li></ul><p>⟦IMG_3⟧</p>")
    )
    pages = test_pages(spark, sf_dir).select("page_id", "url", html.alias("html"))
    return K.isolate_tokens(N.html_nodes(pages))


def final_gate(spark, sf_dir):
    html = F.when(F.col("page_id") % 4 == 0, F.concat("html", F.lit("⟦IMG_3⟧"))).when(
        F.col("page_id") % 4 == 1, F.lit(" \n ")).otherwise(F.col("html"))
    return K.final_gate(test_pages(spark, sf_dir).select("page_id", html.alias("html")))


def ingest_cleaned(spark, sf_dir):
    pages = test_pages(spark, sf_dir)
    fenced = F.concat(F.lit("```html\n"), F.col("html"), F.lit("\n```"))
    cleaned = pages.filter("page_id % 7 != 3").select(
        "page_id", fenced.alias("html"), (F.col("page_id") % 11 == 5).alias("refused")
    )
    rows = K.ingest_cleaned(pages, cleaned)
    return rows.select("page_id", F.md5("html").alias("html_md5"), "status", "message")


def text_fidelity(spark, sf_dir):
    """Words of the main content against the words left after boilerplate and link clean-up."""
    nodes = N.html_nodes(_aug(spark, sf_dir))
    source = N.visible_text(N.drop_chrome(N.body_nodes(nodes)), " ")
    output = N.visible_text(C.select_first(nodes, "article"), " ").withColumn(
        "text", F.concat("text", F.lit(" invented words"))
    )
    return K.text_fidelity(source, output)


QUERIES = {f.__name__: f for f in (
    extract_images, extract_images_ext, tokenize_images, detokenize, distinct_assets, plan_media, plan_media_sideload,
    ingest_media_results, assign_filenames, map_tokens_to_media, unmapped_tokens, page_attachments, image_inventory,
    asset_sharing, normalize_tags, enforce_whitelist, strip_attributes, unwrap_inline, unwrap_page_wrapper,
    drop_boilerplate, boilerplate_report, token_integrity, token_order, restore_lost_tokens, isolate_tokens,
    final_gate, ingest_cleaned, text_fidelity,
)}
