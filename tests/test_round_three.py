"""Tables in part files, tasks that do not grow with a table, and near-copies within a page."""

import re

import pytest
from pyspark.sql import functions as F

from pageloom.operators import content as C, nodes as N, selectors as L, similarity as S
from pageloom.operators.quality import pick_template
from pageloom.plans.convert import convert_pages
from pageloom.plans import streams as Q
from pageloom.streaming import pages as P


@pytest.mark.parametrize("parts", [1, 3])
def test_streams_read_tables_of_part_files(spark, tmp_path, pages_of, parts):
    html = "<html><head><title>T</title></head><body><article><p>Text {0}</p><img src='/{0}.png'></article></body></html>"
    table = pages_of(*[(f"https://h{i % 2}.org/{i}", html.format(i % 4)) for i in range(6)])
    table.repartition(parts).write.parquet(str(tmp_path / "pages.parquet"))
    found = [r.src for r in Q.stream_new_assets(spark, str(tmp_path)).collect()]
    assert len(found) == len(set(found)) and {f"https://h{i % 2}.org/{i}.png" for i in range(4)} <= set(found)
    done = Q.stream_pages(spark, str(tmp_path)).collect()
    assert sorted(r.page_id for r in done) == list(range(6)) and all(r.title == "T" for r in done)
    assert {(r.job_id, r.done) for r in Q.stream_job_progress(spark, str(tmp_path)).collect()} == {("h0.org", 3), ("h1.org", 3)}


def test_streams_read_tables_of_one_file(spark, tmp_path, pages_of):
    pages_of("<p>a</p>", "<p>b</p>").coalesce(1).write.parquet(str(tmp_path / "parts"))
    (tmp_path / "in").mkdir()
    next((tmp_path / "parts").glob("*.parquet")).rename(tmp_path / "in" / "pages.parquet")
    stream = P.stream_table(spark, str(tmp_path / "in"), "pages.parquet", P.PAGE_SCHEMA)
    P.stream_new_assets(lambda df: df.select(F.col("html").alias("src")), stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_pages_are_dealt_to_more_tasks_as_they_grow(spark, tmp_path):
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(400)), lambda i: F.md5(F.concat_ws("-", "id", i))))
    for rows in (100, 800):
        spark.range(rows).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), text.alias("html")).write.parquet(str(tmp_path / str(rows)))
    dealt = [N.by_page(spark.read.parquet(str(tmp_path / str(rows)))).rdd.getNumPartitions() for rows in (100, 800)]
    assert dealt[1] > 4 and dealt[1] > dealt[0]


def test_conversion_keeps_the_parts_its_pages_were_dealt_to(spark, tmp_path, capsys):
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(400)), lambda i: F.md5(F.concat_ws("-", "id", i))))
    html = F.concat(F.lit("<body><article><p>"), text, F.lit("</p></article></body>"))
    dealt = []
    for rows in (400, 800):
        spark.range(rows).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), html.alias("html")).write.parquet(str(tmp_path / str(rows)))
        convert_pages(spark.read.parquet(str(tmp_path / str(rows))), css="article").explain()
        exchanges = [line for line in capsys.readouterr().out.splitlines() if re.search(r"\bExchange", line)]  # small titles may be broadcast
        parts = [re.search(r"Exchange hashpartitioning\(page_id#\d+L, (\d+)\), REPARTITION_BY_NUM", line) for line in exchanges]
        assert len(parts) == 2 and all(parts)  # content and titles: no window, aggregate or join deals the rows anew
        dealt.append({int(p.group(1)) for p in parts})
    assert all(len(d) == 1 for d in dealt) and max(dealt[1]) >= 1.5 * max(dealt[0]) > 4


def test_counts_of_shingles_are_not_repeated_for_every_salt(spark):
    sets = spark.createDataFrame([("x", [1, 2, 3]), ("y", [2, 3, 4]), ("z", [3])], "id string, tokens array<bigint>")
    order = S.ranked(sets, [])
    assert "_salt" not in order._jdf.queryExecution().toString()
    assert {r.id: r.tokens for r in order.collect()} == {"x": [1, 2, 3], "y": [4, 2, 3], "z": [3]}


def test_near_copies_within_pages_and_sites(spark):
    words = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen".split()
    plain, near = " ".join(words), " ".join([*words[:-1], "changed"])
    rows = [(1, 1, plain), (1, 2, "else"), (1, 3, near), (1, 4, "else"), (2, 1, plain), (3, 1, near), (None, 1, plain), (None, 2, near),
            (4, 1, plain), (4, 1, near)]  # page 4 came twice
    blocks = spark.createDataFrame(rows, "page_id bigint, block_id bigint, text string").withColumn("host", F.lit("h"))
    assert sorted((r.page_id, r.blocks, r.near) for r in C.duplicate_content_near(blocks).collect()) == [(1, 4, 2), (4, 2, 1)]
    pairs = C.near_copies(blocks, "host").collect()
    assert len(pairs) == 1 and pairs[0].a < pairs[0].b and round(pairs[0].similarity, 4) == round(11 / 13, 4)
    assert C.near_copies(blocks.withColumn("host", F.col("text")), "host").count() == 0


def test_templates_read_the_blocks_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(kind):
        read.add(1)
        return kind

    rows = spark.createDataFrame([(i, "table" if i % 2 else "list") for i in range(8)], "page_id bigint, block_type string")
    blocks = rows.withColumn("block_type", F.udf(seen, "string")("block_type"))
    templates = spark.createDataFrame([("t", 1, "table", None)], "template string, section_pos int, block_type string, level bigint")
    found = pick_template(blocks, templates, rows).collect()
    assert sorted((r.page_id, r.template) for r in found) == [(i, "t" if i % 2 else None) for i in range(8)]
    assert read.value <= 16  # a filter and the column itself read each row


def test_structural_selectors_parse_a_page_once(spark, pages_of, capsys):
    html = "<body><nav><p>n</p></nav><div id=a><p>one</p><p>two</p></div></body>"
    pages = pages_of(("https://a.example/", html), ("https://b.example/", html), ("https://c.example/", html)).unionByName(
        spark.createDataFrame([(None, "https://a.example/", html)], "page_id bigint, url string, html string"))
    selectors = spark.createDataFrame([("a.example", "div > p + p"), ("b.example", "div p"), ("c.example", "div > h1")], "host string, css string")
    content = C.content_nodes(pages, selectors)
    content.explain()
    assert capsys.readouterr().out.count("Generate posexplode") == 1
    text = F.expr("listagg(if(kind = 'text', tok, null), ' ') within group (order by pos)")
    found = {(r.page_id, r.content_source, r.text) for r in content.groupBy("page_id", "content_source").agg(text.alias("text")).collect()}
    assert found >= {(0, "selector", "two"), (1, "selector", "one")} and (2, "fallback") in {f[:2] for f in found} and len(found) == 4


def test_hits_are_the_same_with_their_rows_and_alone(spark):
    html = "<div class=row><p>a<p>b</div><ul><li>c<li><b>d</b></ul>"
    rows = [(1, html, "p + p"), (2, html, "ul > li"), (3, html, "ul li"), (4, "", "p > b"), (5, html, None), (None, html, "p + p")]
    nodes = N.html_nodes(spark.createDataFrame(rows, "page_id bigint, html string, css string"), ("css",))
    steps = F.when(L.is_structural(F.col("css")), L.structural_steps(F.col("css")))
    alone = {r.page_id: r.hit_pos for r in L.structural_hits(nodes.withColumn("_steps", steps).filter("page_id is not null")).collect()}
    marked = L.with_structural_hits(nodes)
    assert marked.count() == nodes.count() and alone == {1: 3, 2: 7}
    assert {(r.page_id, r.hit_pos) for r in marked.select("page_id", "hit_pos").distinct().collect()} == {
        (i, alone.get(i)) for i in (1, 2, 3, 4, 5, None)}
    assert marked.select(*nodes.columns).exceptAll(nodes).count() == 0
