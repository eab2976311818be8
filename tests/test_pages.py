import random

from pyspark.sql import functions as F

from pageloom.operators import content as C, nodes as N, titles as T

LONG = " ".join(["word"] * 20)


def titles(pages):
    return [(r.title, r.title_source) for r in T.page_titles(pages).orderBy("page_id").collect()]


def test_tokens_lose_nothing(pages_of):
    rng = random.Random(7)
    alphabet = ["<", ">", "<p>", "</p>", "<a href='", '"', "'", "<!--", "-->", "<script>", "</script>", "text", " ", "<!x>", "é", "&"]
    docs = ["".join(rng.choices(alphabet, k=rng.randint(0, 30))) for _ in range(300)]
    docs += ["", "<", "<b", "<!-- open", "<script>var a='</p>'", "< " * 3000, "<a b='" * 500]
    pages = pages_of(*docs)
    joined = N.html_nodes(pages).groupBy("page_id").agg(
        F.expr("listagg(tok, '') within group (order by pos)").alias("t"))
    got = {r.page_id: r.t or "" for r in joined.collect()}
    assert [got[i] for i in range(len(docs))] == docs


def test_kinds(pages_of):
    rows = N.html_nodes(pages_of("<!DOCTYPE html><SCRIPT>x</SCRIPT><br/>a < b<P class='>'>t</p><!--c-->")).orderBy("pos").collect()
    assert [(r.kind, r.tag) for r in rows] == [
        ("doctype", ""), ("raw", "script"), ("void", "br"), ("text", ""), ("open", "p"), ("text", ""), ("close", "p"), ("comment", "")]


def test_depth_ignores_stray_closes(pages_of):
    rows = N.node_depth(N.html_nodes(pages_of("</nav><nav>a<nav>b</nav></nav></nav>c<nav>d")), ("nav",)).orderBy("pos").collect()
    assert [r.depth for r in rows] == [0, 1, 1, 2, 2, 1, 0, 0, 0, 1, 1]


def test_extents(pages_of):
    rows = N.element_extents(N.html_nodes(pages_of("<div><div>a</div></div></div><p>b"))).filter("kind in ('open','close')").orderBy("pos").collect()
    assert [(r.pos, r.end_pos) for r in rows] == [(0, 4), (1, 3), (3, 3), (4, 4), (5, None), (6, 8)]


def test_title_cascade(pages_of):
    pages = pages_of(
        "<title>T | Site</title><nav><h1>Menu</h1></nav><h2>News &amp; Events</h2><h2>Real <b>one</b></h2>",
        "<body><div id='email-cta-heading'><h1>Join</h1></div><h3> Later </h3>",
        "<title> Only title – Site </title><h1> </h1>",
        "<meta property='og:title' content=' Social '>",
        "<p>nothing</p>",
        "",
        "<body><nav id='email-cta-heading'><h1>in nav</h1></nav><div id='email-cta-heading'><h1>x</h1></div><h1>Kept</h1>",
        "<h1>Foo <b>bar</b></h1>",
    )
    assert titles(pages) == [
        ("Realone", "heading"), ("Later", "heading"), ("Only title", "title"), ("Social", "og"), ("Untitled", "none"),
        ("Untitled", "none"), ("Kept", "heading"), ("Foobar", "heading")]


def test_title_override(pages_of):
    pages = pages_of("<h1>A</h1>", "<h1>B</h1>").withColumn(
        "title_override", F.when(F.col("page_id") == 0, F.lit("Forced")).otherwise(""))
    assert [t for t, _ in titles(pages)] == ["Forced", "B"]


def first(pages, css):
    rows = C.select_first(N.html_nodes(pages), css).groupBy("page_id").agg(F.expr("listagg(tok, '') within group (order by pos)").alias("t"))
    return {r.page_id: r.t for r in rows.collect()}


def test_select_first(pages_of):
    pages = pages_of("<main><div class='x post-body y'>A<div>B</div></div></main><div class='post-body'>C</div>",
                     "<div class='post-body'>no main</div>", "<section id='et-boc'><p>Z</p></section>")
    assert first(pages, "main .post-body") == {0: "A<div>B</div>"}
    assert first(pages, ".post-body") == {0: "A<div>B</div>", 1: "no main"}
    assert first(pages, "div.post-body.y") == {0: "A<div>B</div>"}
    assert first(pages, "#et-boc") == {2: "<p>Z</p>"}
    assert first(pages, "section#et-boc p") == {2: "Z"}


def test_content_source_is_never_silent(pages_of, spark):
    html = f"<body><nav><a href=x>{LONG}</a></nav><article class='c'><p>{LONG}</p></article><div><a href=y>{LONG}</a></div></body>"
    pages = pages_of(("https://www.a.com/1", html), ("https://b.com/1", html), ("https://c.com/1", html), ("https://www.A.com/2", "<p> </p>"))
    selectors = spark.createDataFrame([("a.com", "article.c"), ("b.com", ".missing")], "host string, css string")
    rows = C.content_summary(C.content_nodes(pages, selectors)).orderBy("page_id").collect()
    assert [r.content_source for r in rows] == ["selector", "fallback", "auto", "fallback"]
    assert [r.text_chars for r in rows] == [len(LONG)] * 3 + [0]
    assert [r.is_empty for r in rows] == [False, False, False, True]


def test_selector_by_raw_authority(pages_of, spark):
    selectors = spark.createDataFrame([("www.a.com", "p"), ("b.com", "")], "host string, css string")
    rows = C.match_selector(pages_of(("https://www.a.com/", ""), ("https://b.com/", "")), selectors)
    assert {r.page_id: r.css for r in rows.collect()} == {0: "p", 1: None}


def test_site_boilerplate_counts_pages_not_repeats(pages_of):
    docs = [(f"https://h.com/{i}", f"<p>Shared line</p><p>Shared line</p><p>own {i}</p>") for i in range(4)]
    docs.append(("https://other.com/", "<p>Shared line</p>"))
    blocks = C.text_blocks(N.html_nodes(pages_of(*docs)))
    assert [tuple(r) for r in C.site_boilerplate(blocks).collect()] == [("h.com", "Shared line", 4)]
    left = C.drop_site_boilerplate(blocks, C.site_boilerplate(blocks)).select("text").collect()
    assert sorted(r.text for r in left) == ["Shared line", "own 0", "own 1", "own 2", "own 3"]


def test_doubled_body_and_meta_echo(pages_of):
    body = "<p>first line</p><p>second line</p>"
    pages = pages_of(body + body, body, f"<head><meta name=description content='x first line y'></head><body>{body}</body>")
    nodes = N.html_nodes(pages)
    assert [tuple(r) for r in C.duplicate_content(C.text_blocks(nodes)).collect()] == [(0, 4, 2, 0.5)]
    assert [tuple(r) for r in C.meta_duplication(nodes).collect()] == [(2, 2, 1)]


def test_suggested_selector(pages_of):
    docs = [(f"https://h.com/{i}", f"<body><div id='top'><p>{LONG} {i}</p><section class='main-text wide'><p>{LONG} {LONG}</p><p>{LONG}{i}</p></section></div></body>")
            for i in range(3)]
    row = C.suggest_selector(pages_of(*docs), coverage=0.7).first()
    assert (row.host, row.css, row.n_pages, row.votes) == ("h.com", "section.main-text", 3, 3)


def test_same_result_for_any_partitioning(pages_of):
    docs = [f"<body><h1>T {i}</h1><p>{LONG} <b>{i}</p></body>" for i in range(40)]
    pages = pages_of(*docs)
    results = []
    for parts in (1, 7, 64):
        shuffled = pages.orderBy(F.rand(parts)).repartition(parts)
        results.append(sorted(map(tuple, C.content_summary(C.content_nodes(shuffled, css="body")).collect())))
    assert results[0] == results[1] == results[2]


def test_bucketed_archive_needs_no_exchange(spark, tmp_path, pages_of):
    from pageloom.sources.sinks import archive_raw_pages

    pages = pages_of(*[f"<nav><p>{i}</p></nav>" for i in range(20)])
    archive_raw_pages(pages, str(tmp_path / "archive"), table="bucketed_pages", buckets=4)
    depth = N.node_depth(N.html_nodes(spark.table("bucketed_pages"), partitioned=True), ("nav",))
    assert "Exchange" not in depth._jdf.queryExecution().executedPlan().toString()
    assert depth.count() == 100
    spark.sql("drop table bucketed_pages")


def test_one_exchange_for_a_page_job(pages_of):
    plan = T.page_titles(pages_of("<h1>x</h1>"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_pruned_nodes_keep_positions_and_pages(pages_of):
    pages = pages_of("<!--c--><p>a</p><script>x</script>", "<!--only-->", "")
    rows = N.html_nodes(pages, prune=True).orderBy("page_id", "pos").collect()
    assert [(r.page_id, r.pos, r.tok) for r in rows] == [
        (0, 0, None), (0, 1, "<p>"), (0, 2, "a"), (0, 3, "</p>"), (1, 0, None), (2, None, None)]
