"""Cases that used to lose or change data."""

import random
import html as stdlib_html
from types import SimpleNamespace
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from pageloom import session
from pageloom.functions import html as H, urls as U
from pageloom.operators import content as C, export as X, nodes as N, quality as Q
from pageloom.plans.convert import convert_pages
from pageloom.sources import lists as L


def apply(spark, values, build):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(build(F.col("v"))).collect()]


def test_all_names_long_numbers_and_bare_names(spark):
    values = ["it&apos;s", "&#0000000065;&#x00000041;", "&#65 &#x41", "&copy 2020 &copyright", "&NotEqualTilde;&nGt;", "&#150;&#128;", "&#99999999999;",
              "&#xD800;", "AT&T R&D &unknown; &", "&amp;amp;", "&eacute&lt", "&Tab;|", "&ampamp;"]
    assert apply(spark, values, H.decode_entities) == [stdlib_html.unescape(v) for v in values]


def test_attributes_keep_bare_names_in_addresses(spark):
    values = ['<a href="/x?a=1&copy=2&amp;b=&eacute;">', "<a href='/x?lt&lt;'>"]
    assert apply(spark, values, lambda c: H.attribute(c, "href")) == ["/x?a=1&copy=2&b=é", "/x?lt<"]


def test_percent_decoding_piece_by_piece(spark):
    values = ["a%20b%ZZ%41", "100%", "%E2%82%AC+%2B", "plain", "%"]
    assert apply(spark, values, U.unquote) == [unquote(v) for v in values]


def test_quotes_count_after_the_equals_sign_only(spark, pages_of):
    html = "<p class=don't>Text can't</p><?php echo 1 ?><b title='a>b' x=\"c>d\">q</b><i a= 'x>y'>z</i><? open"
    rows = N.html_nodes(pages_of(html)).orderBy("pos").collect()
    assert [(r.kind, r.tok) for r in rows] == [
        ("open", "<p class=don't>"), ("text", "Text can't"), ("close", "</p>"), ("comment", "<?php echo 1 ?>"), ("open", "<b title='a>b' x=\"c>d\">"),
        ("text", "q"), ("close", "</b>"), ("open", "<i a= 'x>y'>"), ("text", "z"), ("close", "</i>"), ("comment", "<? open")]


def test_hostile_markup_is_linear(spark, pages_of):
    for piece in ("<a ='", "<a =\"x", "<?", "<p '", "&#", "&a"):
        assert N.html_nodes(pages_of(piece * 40_000)).select(F.sum(F.length("tok"))).first()[0] == len(piece) * 40_000


def test_one_selector_counts_per_host(spark, pages_of):
    page = ("https://h/a", "<body><div class=a>one</div><div class=b>two</div></body>")
    ordered = spark.createDataFrame([(1, "h", ".a"), (2, "h", ".b")], "line_no int, host string, css string")
    rows = C.content_nodes(pages_of(page), ordered).filter("kind = 'text'").collect()
    assert [r.tok for r in rows] == ["two"]
    same = spark.createDataFrame([("h", ".a"), ("h", ".a")], "host string, css string")
    assert [r.tok for r in C.content_nodes(pages_of(page), same).filter("kind = 'text'").collect()] == ["one"]
    with pytest.raises(Exception, match="several selectors for host h"):
        C.content_nodes(pages_of(page), ordered.drop("line_no")).collect()


def test_unsupported_selectors_are_told_apart(spark, pages_of):
    selectors = spark.createDataFrame([("a", "body p:hover"), ("b", ".missing")], "host string, css string")
    pages = pages_of(("https://a/", "<p>x</p>"), ("https://b/", "<p>x</p>"))
    rows = C.content_summary(C.content_nodes(pages, selectors, max_parts=3)).orderBy("page_id").collect()
    assert [r.content_source for r in rows] == ["unsupported", "fallback"]


def test_small_headings_stay_headings(pages_of):
    body = convert_pages(pages_of("<article><h5>Five</h5><p>x</p><h6>Six</h6></article>"), css="article").first().body
    assert '{"level":4} -->\n<h4>Five</h4>' in body and '{"level":4} -->\n<h4>Six</h4>' in body


def test_attachments_leave_no_gap_and_do_not_collide(spark):
    pages = spark.createDataFrame([(1, 2), (2, 1)], "page_id bigint, images bigint")
    ids = X.assign_post_ids(pages, sideload=True)
    images = spark.createDataFrame([(1, 0, "http://h/a.png", ""), (1, 5, "http://h/b.png", ""), (2, 3, "http://h/c.png", "")],
                                   "page_id bigint, img_index bigint, src string, alt string")
    used = [r.post_id for r in ids.collect()] + [r.post_id for r in X.attachment_items(images, ids).collect()]
    assert sorted(used) == [1, 2, 3, 4, 5]


def test_post_ids_of_sparse_numbers(spark):
    pages = spark.range(200).select(F.xxhash64("id").alias("page_id"), (F.col("id") % 3).alias("images"))
    ids = X.assign_post_ids(pages, sideload=True).join(pages, "page_id").orderBy("page_id").collect()
    expected = 1
    for row in ids:
        assert row.post_id == expected
        expected += 1 + row.images


def test_url_lists_of_several_files_keep_their_order(spark, tmp_path):
    for name, lines in (("a.txt", "a1\na2\r\na3"), ("b.txt", "b1\rb2\n")):
        (tmp_path / name).write_bytes(lines.encode())
    assert [r.url for r in L.read_url_list(spark, str(tmp_path)).orderBy("ordinal").collect()] == ["a1", "a2", "a3", "b1", "b2"]


def test_maps_sliders_and_widgets_need_attention(pages_of):
    rows = Q.manual_attention(N.html_nodes(pages_of(
        "<div class='hero slider'>x</div><section id=gmap></section><div class='booking-widget'></div><p class=map>no</p>"))).orderBy("pos").collect()
    assert [r.reason for r in rows] == ["slider", "map", "widget"]


def test_intermediates_need_a_shared_folder_on_a_cluster(tmp_path):
    def fake(master, folder=None):
        context = SimpleNamespace(master=master, applicationId=f"app-{master}", getCheckpointDir=lambda: None)
        return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: folder))

    assert session.shared_folder(fake("yarn", "hdfs:///tmp")) == "hdfs:///tmp"
    local = session.shared_folder(fake("local[2]"))
    assert local == session.shared_folder(fake("local[2]"))
    session._LOCAL.pop("app-local[2]")
    for master in ("yarn", "local-cluster[2,1,512]", "spark://h:7077"):
        with pytest.raises(RuntimeError):
            session.shared_folder(fake(master))


def test_similar_pairs_are_all_pairs(spark):
    from pageloom.operators.similarity import similar_pairs

    rng = random.Random(5)
    sets = [(f"{k:03d}", rng.choice("xy"), sorted({rng.choice("abcdefghij") for _ in range(rng.randint(1, 9))})) for k in range(160)]
    frame = spark.createDataFrame(sets, "id string, host string, tokens array<string>")
    for least in (0.5, 0.8, 1.0):
        got = {(r.a, r.b): round(r.similarity, 9) for r in similar_pairs(frame, least, ["host"]).collect()}
        want = {}
        for a, host, x in sets:
            for b, other, y in sets:
                like = len(set(x) & set(y)) / len(set(x) | set(y))
                if a < b and host == other and like >= least - 1e-9:
                    want[a, b] = round(like, 9)
        assert got == want


def test_templates_meet_few_pages_and_lose_none(spark):
    """Ten thousand templates: the best of each page as by comparing all, from a small part of the pairs."""
    from pageloom.operators import quality as Q, similarity as S

    rng = random.Random(6)
    types = ["paragraph", *[f"type{k}" for k in range(60)]]
    templates = [(f"t{k:05d}", p, b, None) for k in range(10_000) for p, b in enumerate({"paragraph", *rng.sample(types, rng.randint(1, 6))})]
    pages = [(i, p, b, None) for i in range(40) for p, b in enumerate({"paragraph", *rng.sample(types, rng.randint(1, 6))})]
    pages += [(90, 0, "unknown", None), (91, 0, None, None)]
    left = spark.createDataFrame(pages, "page_id bigint, block_pos int, block_type string, level bigint")
    right = spark.createDataFrame(templates, "template string, section_pos int, block_type string, level bigint")
    vocabulary = {}
    for name, _, block, _ in templates:
        vocabulary.setdefault(name, set()).add(block)
    got = {r.page_id: (r.template, r.score) for r in Q.pick_template(left, right).collect()}
    for i in range(40):
        own = {b for p, _, b, _ in pages if p == i}
        score, name = min((-round(len(own & v) / len(own | v), 4), n) for n, v in vocabulary.items())
        assert got[i] == (name, -score)
    assert got[90] == got[91] == (None, 0.0)
    mine, theirs = Q._vocabularies(left, "page_id"), Q._vocabularies(right, "template").select("id", "tokens").distinct()
    order = S.ranked(theirs, [])
    first = S.candidates(S.ranked(mine.select("id", "tokens").distinct(), [], counted=theirs), order, Q.TEMPLATE_ROUNDS[0], [])
    assert first.count() < 40 * theirs.count() / 20


def test_near_copies_across_block_borders_and_odd_pages(spark, pages_of):
    from pageloom.operators import content as C, nodes as N

    text = " ".join(f"word{k}" for k in range(60))
    page = f"<head><meta name='description' content='word57 word58 word59 tail of the page'></head><body><p>{text}</p><p>tail of the page</p><p>{text} more</p><p>{text}</p><p>x</p></body>"
    pages = pages_of(("https://a/1", page), ("https://a/2", f"<p>{text} other</p>"), ("https://b/1", f"<p>{text}</p>"), ("https://b/2", ""))
    blocks = C.text_blocks(N.html_nodes(pages))
    row = C.duplicate_content_near(blocks).collect()
    assert [tuple(r) for r in row] == [(0, 5, 2, 0.4)]
    from pageloom.functions.urls import url_host
    pairs = C.near_copies(blocks.withColumn("host", url_host(F.col("url"))), "host").collect()
    assert {r.host for r in pairs} == {"a"} and len(pairs) == 3
    assert [tuple(r) for r in C.meta_overlap(N.html_nodes(pages)).collect()] == [(0, 3, 3, 1.0)]
    runs = [C.boilerplate_sketches(blocks.filter(c)) for c in ("page_id < 2", "page_id > 0")]
    assert C.shared_texts(C.merge_sketches(*runs), 1).count() == C.site_boilerplate(blocks, 1).count()


def test_sketches_of_two_runs_are_those_of_one(spark):
    from pageloom.operators import content as C

    blocks = spark.range(60_000).select(F.col("id").alias("page_id"), F.lit("https://h/").alias("url"),
                                        F.concat(F.lit("t"), (F.col("id") % 2).cast("string")).alias("text"))
    whole = {r.text: r.n_pages for r in C.shared_texts(C.boilerplate_sketches(blocks)).collect()}
    halves = [C.boilerplate_sketches(blocks.filter(c)) for c in ("page_id < 40000", "page_id > 20000")]
    merged = {r.text: r.n_pages for r in C.shared_texts(C.merge_sketches(*halves)).collect()}
    for text in ("t0", "t1"):
        assert abs(merged[text] - 30_000) < 0.05 * 30_000 and abs(merged[text] - whole[text]) < 0.05 * 30_000
