import gzip
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from pageloom.operators import export as X, quality as Q, skew
from pageloom.plans.convert import convert_pages
from pageloom.sources import lists as L, sinks, sitemaps as S
from pageloom.streaming import pages as P


def items_of(spark, sideload):
    pages = spark.createDataFrame(
        [(10, "https://h/1", 'A & <b> "q" \'s', "x ]]> y", 2), (20, "https://h/2", "日本", "b", 0), (30, "https://h/3", "C", "c", 1)],
        "page_id bigint, url string, title string, body string, images bigint")
    images = spark.createDataFrame(
        [(10, 0, "https://h/a_b.jpg", ""), (10, 1, "https://h/i.jpg", "alt & x"), (30, 0, "https://h/z.png", " ")],
        "page_id bigint, img_index bigint, src string, alt string")
    ids = X.assign_post_ids(pages, sideload, bucket=15)
    items = X.content_items(pages, ids)
    return items.unionByName(X.attachment_items(images, ids)) if sideload else items


def test_ids_leave_room_for_attachments(spark):
    got = [(r.post_id, r.parent_id, r.kind) for r in items_of(spark, True).orderBy("post_id").collect()]
    assert got == [(1, 0, "page"), (2, 1, "attachment"), (3, 1, "attachment"), (4, 0, "page"), (5, 0, "page"), (6, 5, "attachment")]
    assert [r.post_id for r in items_of(spark, False).orderBy("post_id").collect()] == [1, 2, 3]


def test_every_shard_is_a_document(spark, tmp_path):
    path = str(tmp_path / "export")
    sinks.write_wxr(items_of(spark, True), path, items_per_shard=3)
    files = sorted(tmp_path.glob("export/shard=*/*.txt"))
    assert len(files) == 2
    namespaces = {"wp": "http://wordpress.org/export/1.2/", "content": "http://purl.org/rss/1.0/modules/content/"}
    found = []
    for file in files:
        channel = ET.fromstring(file.read_text(encoding="utf-8")).find("channel")
        assert channel.find("wp:author/wp:author_login", namespaces).text == "admin"
        for item in channel.findall("item"):
            found.append((int(item.find("wp:post_id", namespaces).text), item.find("title").text,
                          item.find("wp:post_name", namespaces).text, item.find("content:encoded", namespaces).text))
    assert found == [(1, 'A & <b> "q" \'s', "a-b-q-s", "x ]]> y"), (2, "a b", "a-b", None), (3, "alt & x", "alt-x", None),
                     (4, "日本", "page", "b"), (5, "C", "c", "c"), (6, "z", "z", None)]
    back = sinks.read_export(spark, path).orderBy("post_id").collect()
    assert [(r.post_id, r.parent_id, r.title, r.content) for r in back][:2] == [(1, 0, 'A & <b> "q" \'s', "x ]]> y"), (2, 1, "a b", "")]
    assert back[1].attachment_url == "https://h/a_b.jpg"


def test_dual_export_writes_nothing_for_no_items(spark, tmp_path):
    items = items_of(spark, False)
    sinks.write_dual_export(items.limit(0), items, str(tmp_path / "e"))
    assert not (tmp_path / "e").exists() and sinks.read_export(spark, str(tmp_path / "e-raw")).count() == 3


def test_archive(spark, tmp_path, pages_of):
    sinks.archive_raw_pages(pages_of(("http://h/a/b?x", "<p>"), ("http://h?q", "")), str(tmp_path / "raw"))
    rows = spark.read.parquet(str(tmp_path / "raw")).orderBy("page_id").collect()
    assert [(r.raw_name, r.html) for r in rows] == [("001-a-b.html", "<p>"), ("002-index.html", "")]


def test_url_list(spark, tmp_path):
    file = tmp_path / "urls.txt"
    file.write_text("# c\n\n https://h/x?id=1&page=2 | Rates\nhttps://h/x | A | B\r\nhttps://h/x |\nhttps://h/y", encoding="utf-8")
    rows = [tuple(r) for r in L.read_url_list(spark, str(file)).orderBy("ordinal").collect()]
    assert rows == [(1, "https://h/x?id=1&page=2", "Rates"), (2, "https://h/x", "A | B"), (3, "https://h/x", ""), (4, "https://h/y", None)]
    assert L.inline_urls(spark, [" a ", "", "#b"]).count() == 1
    with pytest.raises(ValueError):
        L.inline_urls(spark, ["", "# x"])


def test_selector_lines(spark):
    lines = spark.createDataFrame([(1, "a = .x"), (2, "a=div[b=c]"), (3, "nope"), (4, " = .y"), (5, "b =")], "line_no int, line string")
    assert [tuple(r) for r in L.selectors_table(lines).collect()] == [("a", "div[b=c]")]


NS = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'


def urlset(*urls):
    return f"<urlset {NS}>" + "".join(f"<url><loc>{u}</loc></url>" for u in urls) + "</urlset>"


def index(*urls):
    return f"<sitemapindex {NS}>" + "".join(f"<sitemap><loc>{u}</loc></sitemap>" for u in urls) + "</sitemapindex>"


def test_sitemap_entries(spark):
    docs = spark.createDataFrame([
        ("a", "﻿ \n<?xml version='1.0'?>" + f"<urlset {NS}><url><image><loc>no</loc></image><loc></loc><loc> u1 </loc></url><url/><url><loc>u2</loc></url></urlset>"),
        ("b", "<urlset><url></urlset>"), ("c", "<other><url><loc>u3</loc></url></other>"), ("d", "not xml")], "doc_url string, body string")
    rows = sorted((r.doc_url, r.root, r.loc) for r in S.sitemap_entries(docs).collect())
    assert rows == [("a", "urlset", "u1"), ("a", "urlset", "u2"), ("c", "other", "u3")]
    assert sorted(r.doc_url for r in S.bad_sitemaps(docs).collect()) == ["b", "d"]


def test_gunzip(spark):
    docs = spark.createDataFrame([("a.gz", gzip.compress(b"one")), ("b", gzip.compress(b"two")), ("c.gz", b"plain"), ("d", b"text")],
                                 "doc_url string, content binary")
    assert {r.doc_url: r.body for r in S.gunzip_bodies(docs).collect()} == {"a.gz": "one", "b": "two", "c.gz": "plain", "d": "text"}


def expand(spark, docs, **caps):
    entries = S.sitemap_entries(spark.createDataFrame(list(docs.items()), "doc_url string, body string"))
    roots = spark.createDataFrame([("root",)], "root_url string")
    return [r.url for r in S.expand_sitemaps(entries, roots, **caps).orderBy("ordinal").collect()]


def test_expansion_order_cycles_and_duplicates(spark):
    docs = {"root": index("m2", "sub", "m1", "m2"), "sub": index("root", "m3", "m1"), "m1": urlset("u1", "u2"), "m2": urlset("u3", "u1"),
            "m3": urlset("u4", "u3")}
    assert expand(spark, docs) == ["u3", "u1", "u2", "u4"]


def test_expansion_caps(spark):
    docs = {"root": index(*[f"m{i}" for i in range(60)]), **{f"m{i}": urlset(f"u{i}") for i in range(60)}}
    assert expand(spark, docs) == [f"u{i}" for i in range(60)]
    assert expand(spark, docs, max_urls=3) == ["u0", "u1", "u2"]
    assert len(expand(spark, docs, max_sitemaps=5)) == 4
    entries = S.sitemap_entries(spark.createDataFrame(list(docs.items()), "doc_url string, body string"))
    roots = spark.createDataFrame([("root",)], "root_url string")
    assert tuple(S.expansion_limits(entries, roots).first()) == ("root", 61, 60, 0, 0, False)
    assert tuple(S.expansion_limits(entries, roots, max_sitemaps=5, max_urls=3).first()) == ("root", 5, 3, 56, 1, True)


def test_bucketed_prefix_with_one_hot_key(spark):
    rows = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"))
    got = skew.bucketed_prefix(rows, "id", F.lit(1), "n", 37, ("k",)).filter("k = 'hot'").orderBy("id").collect()
    assert [r.n for r in got] == list(range(334))


def test_prefix_over_hashed_ids(spark):
    rows = spark.range(500).select(F.xxhash64("id").alias("page_id"), (F.col("id") % 4).alias("images"))
    got = {r.page_id: r.post_id for r in X.assign_post_ids(rows, True, bucket=None).collect()}
    expected, following = {}, 1
    for row in rows.orderBy("page_id").collect():
        expected[row.page_id] = following
        following += 1 + row.images
    assert got == expected


def test_salted_join_keeps_rows(spark):
    left = spark.range(200).select("id", F.when(F.col("id") < 150, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"))
    right = spark.createDataFrame([("hot", 1), ("160", 2)], "k string, v int")
    assert skew.salted_join(left, right, ["k"], "left", "id").count() == 200
    assert skew.salted_join(left, right, ["k"], "inner", "id").count() == 151
    assert skew.salted_join(left, right, ["k"], "left_anti", "id").count() == 49


def test_rate_audit_across_buckets(spark):
    log = spark.createDataFrame([(1, 7, 0), (2, 7, 3599), (3, 7, 3600), (4, 7, 9000), (5, 8, 3600), (6, 7, 9000)], "id bigint, user bigint, s bigint")
    log = log.withColumn("ts", F.timestamp_seconds("s"))
    got = sorted(tuple(r) for r in Q.rate_audit(log, "user", "id", 2.0).collect())
    assert got == [(3, 7, 1_000_000), (6, 7, 0)]


def test_schedule_and_ledger(spark):
    urls = spark.createDataFrame([(1, "http://a/1"), (2, "http://b/1"), (5, "http://a/2"), (9, "http://a/3")], "page_id bigint, url string")
    got = {r.page_id: r.start_second for r in Q.politeness_schedule(urls, 0.5, bucket=2).collect()}
    assert got == {1: 0.0, 2: 0.0, 5: 0.5, 9: 1.0}
    tries = spark.createDataFrame(
        [(1, 1, False, "e1"), (1, 2, True, None), (2, 1, False, "e1"), (2, 2, False, "e2"), (2, 3, False, "e3"), (2, 4, True, None)],
        "fetch_id bigint, attempt bigint, ok boolean, error string")
    rows = {r.fetch_id: tuple(r)[1:] for r in Q.retry_ledger(tries).collect()}
    assert rows == {1: (2, True, None, 1.5, 0), 2: (4, True, None, 9.0, 0)}
    rows = {r.fetch_id: tuple(r)[1:] for r in Q.retry_ledger(tries, max_attempts=3).collect()}
    assert rows == {1: (2, True, None, 1.5, 0), 2: (3, False, "e3", 4.5, 1)}


def test_schedule_of_sparse_ids_keeps_pages_without_url(spark):
    urls = spark.range(300).select(F.xxhash64("id").alias("page_id"), F.when(F.col("id") % 3 == 0, F.lit("http://hot/x")).when(
        F.col("id") % 3 == 1, F.lit(None)).otherwise(F.concat(F.lit("http://h"), F.col("id"))).alias("url"))
    rows = Q.politeness_schedule(urls, 1.0).collect()
    assert len(rows) == 300
    for netloc in ("hot", None):
        assert sorted(r.start_second for r in rows if r.netloc == netloc) == [float(i) for i in range(100)]


def test_progress_lines(spark):
    events = spark.createDataFrame(
        [("j", 1, 1, 4, "u1", "ok", "T", None), ("j", 2, 1, 4, "u1", "ok", "T", None), ("j", 3, 2, 4, "u2", "failed", None, "boom"), ("j", 4, 3, 4, "u3", "skipped", None, None)],
        "job_id string, ts int, idx bigint, total bigint, url string, status string, title string, message string")
    assert [r.line for r in Q.progress_log(events).orderBy("idx").collect()] == ["[OK] u1 — T", "[FAILED] u2 — boom", "[SKIPPED] u3"]
    assert tuple(Q.job_progress(events).first()) == ("j", 3, 4, 75)


def test_patterns_and_templates(spark):
    old = spark.createDataFrame([("p", "paragraph", 0.5, 2, 4), ("b", "group", 0.0, 0, 10)],
                                "shape string, block_type string, confidence double, n_confirmed bigint, n_seen bigint")
    findings = spark.createDataFrame([("p", "paragraph", True), ("p", "paragraph", True), ("div.x", "group", False)], "shape string, block_type string, confirmed boolean")
    got = {r.shape: (r.confidence, r.n_confirmed) for r in Q.learn_patterns(old, findings).collect()}
    assert got == {"p": (0.625, 4), "div.x": (0.3333, 0), "b": (0.0833, 0)}
    templates = spark.createDataFrame([("a", 1, "heading", 2), ("a", 2, "paragraph", None), ("b", 1, "table", None)], "template string, section_pos int, block_type string, level bigint")
    blocks = spark.createDataFrame([(1, 1, "paragraph", None), (1, 2, "heading", 3), (1, 3, "table", None), (2, 1, "paragraph", None), (2, 2, "heading", 2)],
                                   "page_id bigint, block_pos bigint, block_type string, level bigint")
    chosen = Q.pick_template(blocks, templates)
    assert {r.page_id: (r.template, r.score) for r in chosen.collect()} == {1: ("a", 0.6667), 2: ("a", 1.0)}
    others = spark.createDataFrame([(1,), (2,), (3,)], "page_id bigint")
    only_quotes = spark.createDataFrame([("q", 1, "quote", None)], templates.schema)
    assert {r.page_id: (r.template, r.score) for r in Q.pick_template(blocks, only_quotes, others).collect()} == {i: (None, 0.0) for i in (1, 2, 3)}
    problems = sorted(tuple(r) for r in Q.template_conformance(blocks, chosen, templates).collect())
    assert problems == [(1, 2, "heading", "other level"), (1, 3, "table", "not in template"), (2, 2, "heading", "out of order")]


def test_streams_equal_batch_over_two_triggers(spark, tmp_path, pages_of):
    docs = [(f"https://h/{i}", f"<main><p>text {i}</p><img src='/{i % 3}.jpg'></main>") for i in range(6)]
    pages = pages_of(*docs)
    for part in range(2):
        pages.filter(F.col("page_id") % 2 == part).coalesce(1).write.parquet(str(tmp_path / f"in/part={part}"))
    source = str(tmp_path / "in/part=*")

    def stream():
        return P.stream_table(spark, source, "*.parquet", P.PAGE_SCHEMA, files_per_trigger=1)

    def convert(df):
        return convert_pages(df, css="main")

    P.stream_pages(stream(), convert, str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch_id").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, convert(pages).collect()))

    from pageloom.operators.content import content_nodes
    from pageloom.operators.media import extract_images
    P.stream_new_assets(lambda df: extract_images(content_nodes(df, css="main")), stream(), str(tmp_path / "assets"), str(tmp_path / "c2")).awaitTermination()
    assets = spark.read.parquet(str(tmp_path / "assets")).collect()
    assert sorted(r.src for r in assets) == ["https://h/0.jpg", "https://h/1.jpg", "https://h/2.jpg"]
    assert {r.batch_id for r in assets} <= {0, 1}

    events = stream().select(F.lit("j").alias("job_id"), F.when(F.col("page_id") == 0, F.lit("failed")).otherwise("ok").alias("status"))
    P.stream_job_progress(events, str(tmp_path / "jobs"), str(tmp_path / "c3")).awaitTermination()
    assert [tuple(r) for r in P.latest_progress(spark, str(tmp_path / "jobs")).collect()] == [("j", 6, 5, 1)]


def test_new_assets_over_batches_and_runs(spark, tmp_path, pages_of):
    """Repeated pages, a replaced file and a second run: each source comes out once, and a batch reads its own rows only."""
    from pageloom.operators.content import content_nodes
    from pageloom.operators.media import extract_images

    def images_of(df):
        return extract_images(content_nodes(df, css="main"))

    def run():
        stream = P.stream_table(spark, str(tmp_path / "in"), "*.parquet", P.PAGE_SCHEMA, files_per_trigger=1)
        query = P.stream_new_assets(images_of, stream, str(tmp_path / "out"), str(tmp_path / "check"))
        query.awaitTermination()
        return query

    def put(name, *sources):
        docs = [(f"https://h/{name}", "<main>" + "".join(f"<img src='/{s}.jpg'>" for s in sources) + "</main>")]
        pages_of(*docs).coalesce(1).write.mode("overwrite").parquet(str(tmp_path / f"raw/{name}"))
        import shutil
        part = next((tmp_path / f"raw/{name}").glob("part-*"))
        (tmp_path / "in").mkdir(exist_ok=True)
        shutil.copy(part, tmp_path / f"in/{name}.parquet")

    put("a", 1, 2, 2)
    put("b", 2, 3)
    run()
    put("c", 1, 2, 3, 4)
    query = run()
    state = [o for p in query.recentProgress for o in p["stateOperators"]]
    assert sum(o["numRowsUpdated"] for o in state) == 1 and state[-1]["numRowsTotal"] == 4
    assert "RocksDB" in str(state[-1]["customMetrics"].keys()) or any("rocksdb" in k.lower() for k in state[-1]["customMetrics"])
    assert sum(p["numInputRows"] for p in query.recentProgress) == 4
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r.src for r in rows) == [f"https://h/{k}.jpg" for k in (1, 2, 3, 4)]
    assert sorted(r.src for r in P.known_assets(spark, str(tmp_path / "check")).collect()) == [f"https://h/{k}.jpg" for k in (1, 2, 3, 4)]


def test_finished_jobs_leave_the_progress_state(spark, tmp_path):
    rows = [("a", "ok", 3), ("a", "failed", 3), ("b", "ok", None)], [("a", "ok", 3), ("b", "ok", None), ("c", "ok", 5)], [
        ("d", None, 2)], [("a", "ok", 3), ("d", "ok", 2)]
    schema = "job_id string, status string, total bigint"
    for k, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
        stream = P.stream_table(spark, str(tmp_path / "in/*"), "*.parquet", schema)
        P.stream_job_progress(stream, str(tmp_path / "out"), str(tmp_path / "check"), idle_batches=3).awaitTermination()
        active = {r.job_id for r in P.active_jobs(spark, str(tmp_path / "out")).collect()}
        assert active == [{"a", "b"}, {"b", "c"}, {"b", "c", "d"}, {"a", "b", "c"}][k]
        every = [r for p in rows[: k + 1] for r in p]
        want = {(j, sum(r[0] == j for r in every), sum(r[0] == j and r[1] == "ok" for r in every)) for j in {r[0] for r in every}}
        got = P.latest_progress(spark, str(tmp_path / "out")).collect()
        assert {(r.job_id, r.done, r.succeeded) for r in got} == want and all(r.failed == r.done - r.succeeded for r in got)
    # Two batches on, the idle ones are settled, and nothing is counted twice when the last batch runs again.
    spark.createDataFrame([("e", "ok", None)], schema).coalesce(1).write.parquet(str(tmp_path / "in/9"))
    stream = P.stream_table(spark, str(tmp_path / "in/*"), "*.parquet", schema)
    P.stream_job_progress(stream, str(tmp_path / "out"), str(tmp_path / "check"), idle_batches=3).awaitTermination()
    assert {r.job_id for r in P.active_jobs(spark, str(tmp_path / "out")).collect()} == {"a", "e"}
    assert sum(r.done for r in P.latest_progress(spark, str(tmp_path / "out")).collect()) == 10


def test_late_events_go_to_the_side(spark, tmp_path):
    """Over a hundred batches and times out of order: on time and late together are all, and what is on time comes once."""
    import datetime as dt
    import os

    start = dt.datetime(2024, 1, 1)
    batches = [[(k, start + dt.timedelta(minutes=k), "x"), (k, start + dt.timedelta(minutes=k), "x")] for k in range(103)]
    batches[50].append((1000, start + dt.timedelta(minutes=3), "late"))   # 46 minutes behind
    batches[60].append((1001, start + dt.timedelta(minutes=55), "on time"))
    batches[102] += [(101, start + dt.timedelta(minutes=101), "x"), (1000, start + dt.timedelta(minutes=3), "late")]
    schema = "event_id bigint, ts timestamp, line string"
    (tmp_path / "in").mkdir()
    import pyarrow as pa
    import pyarrow.parquet as pq
    for k, part in enumerate(batches):
        table = pa.table({"event_id": [r[0] for r in part], "ts": pa.array([r[1] for r in part], pa.timestamp("us", "UTC")), "line": [r[2] for r in part]})
        pq.write_table(table, tmp_path / f"in/{k:03d}.parquet")
        os.utime(tmp_path / f"in/{k:03d}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    stream = P.stream_table(spark, str(tmp_path / "in"), "*.parquet", schema, files_per_trigger=1)
    P.stream_event_dedup(stream, ["event_id"], str(tmp_path / "out"), str(tmp_path / "check"), delay="10 minutes").awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    late = P.late_events(spark, str(tmp_path / "out_late"), schema).collect()
    assert sorted(r.event_id for r in out) == [*range(103), 1001]
    assert sorted((r.event_id, r.batch_id) for r in late) == [(1000, 50), (1000, 102)]
    on_time = spark.read.parquet(str(tmp_path / "check_on_time")).count()
    assert on_time + len(late) == sum(map(len, batches))


def test_stored_bundle(spark, tmp_path):
    """Add, replace, remove and reload; a write that failed half way changes nothing, and its retry takes effect."""
    from pageloom.sources import lists as L, snapshots as S

    folder = str(tmp_path / "bundle")
    schema = "link string, title string, content string, added bigint"
    assert S.read_snapshot(spark, folder) is None and L.load_bundle(spark, folder).count() == 0
    L.store_added(folder, spark.createDataFrame([("a", "A", "x", 1), ("b", "B", "y", 2)], schema))
    L.store_added(folder, spark.createDataFrame([("b", "B2", "z", 3), ("c", "C", "w", 4), ("a", "old", "v", 0)], schema))
    assert [(r.link, r.title) for r in L.load_bundle(spark, folder).orderBy("added").collect()] == [("a", "A"), ("b", "B2"), ("c", "C")]
    # What a crash leaves: files without the marker.
    broken = tmp_path / "bundle" / "version=000000003"
    broken.mkdir()
    (broken / "part-00000.parquet").write_bytes(b"half a file")
    assert L.load_bundle(spark, folder).count() == 3
    L.store_removed(folder, spark.createDataFrame([("b",), ("missing",)], "link string"))
    assert [r.link for r in L.load_bundle(spark, folder).orderBy("added").collect()] == ["a", "c"]
    assert S.versions(spark, folder) == [2, 3]
    L.store_added(folder, spark.createDataFrame([("b", "B3", "again", 9)], schema))
    L.store_added(folder, spark.createDataFrame([("b", "B3", "again", 9)], schema))
    assert sorted((r.link, r.added) for r in L.load_bundle(spark, folder).collect()) == [("a", 1), ("b", 9), ("c", 4)]


def test_pages_from_files(spark, tmp_path):
    from urllib.parse import quote

    from pageloom.sources.tables import load_pages
    for url, html in (("https://h.org/a b?x=1", "<p>one\ntwo</p>\n"), ("http://h/ä+b", "x")):
        (tmp_path / f"{quote(url, safe='')}.html").write_text(html, encoding="utf-8")
    rows = {r.url: r.html for r in load_pages(spark, str(tmp_path), "html_files").collect()}
    assert rows == {"https://h.org/a b?x=1": "<p>one\ntwo</p>\n", "http://h/ä+b": "x"}
