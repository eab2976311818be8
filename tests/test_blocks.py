from pyspark.sql import functions as F

from pageloom.operators import blocks as B, contract as K, layout as Y, media as M, nodes as N
from pageloom.plans.convert import convert_pages, extracted_rows

URL = "https://h.org/dir/page"


def markups(pages_of, body, **options):
    rows = extracted_rows(pages_of((URL, f"<main>{body}</main>")), css="main")
    blocks = B.segment_blocks(B.block_rows(K.clean_rows(rows), **options))
    return [(r.block_type, r.markup) for r in blocks.orderBy("block_pos").collect()]


def paragraph(text):
    return f"<!-- wp:paragraph -->\n<p>{text}</p>\n<!-- /wp:paragraph -->"


def image(src, alt=""):
    return f'<!-- wp:image {{}} -->\n<figure class="wp-block-image size-large"><img src="{src}" alt="{alt}"/></figure>\n<!-- /wp:image -->'


def test_paragraph_inline_rules(pages_of):
    body = "<p class=x> A &copy; <a href='/q?a=1&amp;b=2' rel=y>li<i>nk</i></a> <span>s</span><u>u</u> 1 &lt; 2</p><p> </p>"
    assert markups(pages_of, body) == [
        ("paragraph", paragraph('A © <a href="/q?a=1&amp;b=2">li<em>nk</em></a> su 1 &lt; 2'))]


def test_headings_and_empty_ones(pages_of):
    got = markups(pages_of, "<h1>One</h1><h3></h3><h4>Four</h4>")
    assert [m for _, m in got] == [
        f'<!-- wp:heading {{"level":{n}}} -->\n<h{n}>{t}</h{n}>\n<!-- /wp:heading -->' for n, t in ((2, "One"), (3, ""), (4, "Four"))]


def test_heading_level_is_clamped(spark):
    row = spark.range(1).select(*[B.heading_block(F.lit(n), F.lit("x")) for n in (1, 6)]).first()
    assert '{"level":2}' in row[0] and "<h4>x</h4>" in row[1]


def test_broken_markup(pages_of):
    got = markups(pages_of, "<p><b>bold <em>both<p>next</b></p>tail<div>box</div>after")
    assert got == [("paragraph", paragraph(t)) for t in (
        "<strong>bold <em>both</em></strong>", "next", "tail", "box", "after")]


def test_list_flattens_nested_items(pages_of):
    got = markups(pages_of, "<ol>\n<li> A <b>b</b></li><li>B<ul><li>C</li><li>D</li></ul>e</li></ol>")
    item = "<!-- wp:list-item -->\n<li>{}</li>\n<!-- /wp:list-item -->"
    items = "\n".join(item.format(t) for t in ("A <strong>b</strong>", "BCDe"))
    assert got == [("list", f'<!-- wp:list {{"ordered":true}} -->\n<ol class="wp-block-list">\n{items}\n</ol>\n<!-- /wp:list -->')]


def test_nested_list_block(pages_of):
    rows = K.clean_rows(extracted_rows(pages_of((URL, "<main><ul><li>A<ol><li>B</li><li>C</li></ol>tail</li><li>D</li></ul></main>")), css="main"))
    got = [r.markup for r in Y.nested_list_block(rows).collect()]

    def item(text):
        return f"<!-- wp:list-item -->\n<li>{text}</li>\n<!-- /wp:list-item -->"

    inner = f'<!-- wp:list {{"ordered":true}} -->\n<ol class="wp-block-list">\n{item("B")}\n{item("C")}\n</ol>\n<!-- /wp:list -->'
    first = item("A\n" + inner + "\ntail")
    assert got == [f'<!-- wp:list -->\n<ul class="wp-block-list">\n{first}\n{item("D")}\n</ul>\n<!-- /wp:list -->']


def test_quotes(pages_of):
    got = markups(pages_of, "<blockquote><p>A</p>loose<p></p><p>B</p></blockquote><blockquote> C <i>d</i></blockquote>")
    frame = '<!-- wp:quote -->\n<blockquote class="wp-block-quote">\n{}\n</blockquote>\n<!-- /wp:quote -->'
    assert [m for _, m in got] == [frame.format(paragraph("A") + "\n" + paragraph("B")), frame.format(paragraph("C <em>d</em>"))]


def test_code_table_separator(pages_of):
    got = markups(pages_of, '<pre><code>a < "b"\n  c</code></pre><table id=t><tr><td class=x>1 <b>x</b></td></tr></table><hr class=z>')
    assert got == [
        ("code", '<!-- wp:code -->\n<pre class="wp-block-code"><code>a &lt; &quot;b&quot;\n  c</code></pre>\n<!-- /wp:code -->'),
        ("table", '<!-- wp:table -->\n<figure class="wp-block-table"><table class="wp-block-table__table"><tr><td>1 x</td></tr></table></figure>\n<!-- /wp:table -->'),
        ("separator", '<!-- wp:separator -->\n<hr class="wp-block-separator"/>\n<!-- /wp:separator -->')]
    assert '<figure class="wp-block-table"><table>' in markups(pages_of, "<table><tr><td>1</td></tr></table>", table_class=None)[0][1]


def test_images_split_paragraphs_and_leave_containers(pages_of):
    body = '<p>a <img src="x.png" alt=" q&quot; "> b</p><table><tr><td>c <img src="/y.png"></td></tr></table><img alt=none>'
    got = markups(pages_of, body)
    assert [m for _, m in got[:4]] == [paragraph("a"), image("https://h.org/dir/x.png", "q&quot;"), paragraph("b"), image("https://h.org/y.png")]
    assert got[4][0] == "table" and "<td>c </td>" in got[4][1]


def test_image_block_with_id(spark):
    row = spark.range(1).select(
        B.image_block(F.lit("u&v"), F.lit("a<b"), F.lit(7)), B.image_block(F.lit("u&v"), F.lit(None), escape_url=True),
        B.image_block_caption(F.lit("u"), F.lit(""), F.lit("C & d"))).first()
    assert row[0] == ('<!-- wp:image {"id":7,"sizeSlug":"large"} -->\n<figure class="wp-block-image size-large">'
                      '<img src="u&v" alt="a&lt;b" class="wp-image-7"/></figure>\n<!-- /wp:image -->')
    assert 'src="u&amp;v" alt=""/>' in row[1]
    assert '<figcaption class="wp-element-caption">C &amp; d</figcaption></figure>' in row[2]


def test_extract_images(pages_of):
    html = ('<main><img src="a.jpg" alt=" A "><img alt="none"><img src="" data-src="../b.jpg" title="T"><graphic url="//c.org/c.jpg">'
            '<figure><img data-lazy-src="d.jpg"><figcaption>Cap <b>1</b></figcaption></figure><img srcset="e.jpg 1x, f.jpg 2x"></main>')
    content = extracted_rows(pages_of((URL, html)), css="main").filter("kind = 'image'").orderBy("img_index")
    assert [(r.img_index, r.src, r.alt) for r in content.collect()] == [
        (0, "https://h.org/dir/a.jpg", "A"), (1, "https://h.org/b.jpg", "T"), (2, "https://c.org/c.jpg", "")]
    from pageloom.operators.content import content_nodes
    more = M.extract_images(content_nodes(pages_of((URL, html)), css="main"), extended=True).orderBy("img_index").collect()
    assert [(r.src.rsplit("/", 1)[1], r.caption) for r in more] == [
        ("a.jpg", None), ("b.jpg", None), ("c.jpg", None), ("d.jpg", "Cap 1"), ("e.jpg", None)]


def test_tokens_round_trip(pages_of):
    rows = extracted_rows(pages_of((URL, '<main>x<img src="a.jpg" alt="&quot;q">y</main>')), css="main")
    tokens = M.tokenize_images(rows)
    assert tokens.first().html == "x<p>⟦IMG_0⟧</p>y"
    back = M.detokenize(tokens, rows.filter("kind = 'image'")).first().html
    assert back == 'x<p><img src="https://h.org/dir/a.jpg" alt="&quot;q"></p>y'


def test_file_names(spark):
    assets = spark.createDataFrame(
        [("s1", "a.jpg", "h1", 1), ("s2", "a.jpg", "h1", 2), ("s3", "a.jpg", "h2", 3), ("s4", "a.jpg", "h3", 4), ("s5", "a-1.jpg", "h4", 5),
         ("s6", ".jpg", "h5", 6), ("s7", ".jpg", "h6", 7)],
        "src string, name string, sha256 string, ordinal bigint")
    got = {r.src: (r.file_name, r.conflict) for r in M.assign_filenames(assets).collect()}
    assert got == {"s1": ("a.jpg", False), "s2": ("a.jpg", False), "s3": ("a-1.jpg", True), "s4": ("a-2.jpg", False),
                   "s5": ("a-1.jpg", False), "s6": (".jpg", False), "s7": (".jpg-1", False)}


def test_media_modes(spark):
    images = spark.createDataFrame([(1, 0, "s", "x"), (2, 0, "s", "y"), (2, 1, "t", "")], "page_id bigint, img_index bigint, src string, alt string")
    results = spark.createDataFrame([("s", "lib/s", 9, True), ("t", "lib/t", 8, False)], "src string, url string, media_id bigint, ok boolean")

    def run(mode):
        return [(r.url, r.media_id, r.alt) for r in M.plan_media(images, mode, results).orderBy("page_id", "img_index").collect()]

    assert run("upload") == [("lib/s", 9, "x"), ("lib/s", 9, "y"), ("t", None, "")]
    assert run("bundle") == [("lib/s", None, "x"), ("lib/s", None, "y"), ("t", None, "")]
    assert run("remote") == run("sideload") == [("s", None, "x"), ("s", None, "y"), ("t", None, "")]
    assert M.page_attachments(images, "remote").count() == 0 and M.page_attachments(images, "sideload").count() == 3


def test_upload_mode_reaches_the_blocks(pages_of, spark):
    results = spark.createDataFrame([("https://h.org/a.jpg", "https://lib/a.jpg", 5, True)], "src string, url string, media_id bigint, ok boolean")
    row = convert_pages(pages_of((URL, '<main><p>t</p><img src="/a.jpg"></main>')), css="main", mode="upload", results=results).first()
    assert 'class="wp-image-5"' in row.body and "https://lib/a.jpg" in row.body and row.images == 1


def test_contract_checks(spark):
    images = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "page_id bigint, img_index bigint")
    output = spark.createDataFrame(
        [(1, "<p>⟦IMG_1⟧</p>⟦IMG_1⟧ ⟦IMG_0⟧"), (2, "⟦IMG_9⟧"), (3, "⟦IMG_x⟧")], "page_id bigint, html string")
    assert sorted(map(tuple, K.token_integrity(images, output).collect())) == [
        (1, 1, 1, 2, "duplicated"), (2, 0, 1, 0, "missing"), (2, 9, 0, 1, "unknown")]
    assert [(r.page_id, r.n, r.img_index) for r in K.token_order(output).collect()] == [(1, 2, 0)]
    assert {r.page_id: r.html for r in K.restore_lost_tokens(images, output).collect()}[2] == "⟦IMG_9⟧\n<p>⟦IMG_0⟧</p>"
    assert {r.page_id: r.passed for r in K.final_gate(output).collect()} == {1: False, 2: False, 3: False}


def test_isolated_tokens(pages_of):
    rows = K.isolate_tokens(N.html_nodes(pages_of("<p>a ⟦IMG_0⟧ b ⟦IMG_1⟧</p><table><tr><td>⟦IMG_2⟧ c</td></tr></table>⟦IMG_3⟧")))
    assert rows.first().html == ("<p>a </p><p>⟦IMG_0⟧</p><p> b </p><p>⟦IMG_1⟧</p><p>⟦IMG_2⟧</p>"
                                 "<table><tr><td> c</td></tr></table><p>⟦IMG_3⟧</p>")


def test_page_wrapper(pages_of):
    docs = ["<div><section><p>a</p></section></div>", "<div><p>a</p></div><p>b</p>", "<div></div>", "<p>a</p>", "<div><div>a</div><div>b</div></div>"]
    rows = K.unwrap_page_wrapper(N.html_nodes(pages_of(*docs))).groupBy("page_id").agg(F.expr("listagg(tok, '') within group (order by pos)").alias("t"))
    assert {r.page_id: r.t for r in rows.collect()} == {
        0: "<p>a</p>", 1: "<div><p>a</p></div><p>b</p>", 3: "<p>a</p>", 4: "<div>a</div><div>b</div>"}


def test_boilerplate(pages_of):
    nodes = N.html_nodes(pages_of("<p>keep</p><div class='share-bar'>x <div class=ad>y</div></div><div id=comments>z</div><div class='shadow'>stay</div>"))
    kept = K.drop_boilerplate(nodes).filter("kind = 'text'").orderBy("pos").collect()
    assert [r.tok for r in kept] == ["keep", "stay"]
    assert [(r.reason, r.words) for r in K.boilerplate_report(nodes).orderBy("pos").collect()] == [("share", 2), ("comments", 1)]


def test_cleaner_input(spark):
    pages = spark.createDataFrame([(1,), (2,), (3,)], "page_id bigint")
    cleaned = spark.createDataFrame([(1, "```html\n<p>a</p>\n```", False), (2, "x", True)], "page_id bigint, html string, refused boolean")
    rows = K.ingest_cleaned(pages, cleaned).orderBy("page_id").collect()
    assert [(r.html, r.status) for r in rows] == [("<p>a</p>", "ok"), (None, "failed"), (None, "failed")]


def test_outcomes(pages_of):
    pages = pages_of("<main><p>fine</p></main>", "<main> \n </main>", "<main><div><p> </p></div></main>", "")
    rows = convert_pages(pages, css="main").orderBy("page_id").collect()
    assert [(r.status, r.message) for r in rows] == [
        ("ok", None), ("skipped", "no main content extracted"), ("skipped", "empty after conversion"), ("skipped", "no main content extracted")]
    from pageloom.operators.quality import job_summary
    assert tuple(job_summary(convert_pages(pages, css="main")).first()) == (4, 1, 3, 1)


def test_layout_blocks(pages_of):
    html = ("<a href='https://youtu.be/x'>https://youtu.be/x</a><a href='https://youtu.be/y'>watch</a><a class='btn' href='/b'>B &amp; c</a>"
            "<div class=row><div class='col col-6'>L</div><div class='col col-6'>R</div></div><iframe src='https://maps.example/'></iframe>")
    nodes = N.html_nodes(pages_of((URL, html)))
    assert [(r.provider, r.url) for r in Y.embed_block(nodes).collect()] == [("youtube", "https://youtu.be/x")]
    assert ['href="https://h.org/b">B &amp; c</a>' in r.markup for r in Y.button_block(nodes).collect()] == [True]
    row = Y.columns_block(extracted_rows(pages_of((URL, f"<main>{html}</main>")), css="main")).first()
    assert row.columns == 2 and row.markup.count('{"width":"50%"}') == 2
    from pageloom.operators.quality import manual_attention, placeholders
    assert [(r.reason, r.target, r.before_text, r.after_text) for r in manual_attention(nodes).collect()] == [("embed", "https://maps.example/", "R", None)]
    assert any("[Needs manual attention: embed https://maps.example/]" in r.tok for r in placeholders(nodes).collect())
