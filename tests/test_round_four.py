"""Layout queries that make their rows once."""

import re

from pageloom.operators import layout as Y
from pageloom.plans.convert import convert_pages_layout, extracted_rows

HTML = ("<html><head><title>T</title></head><body><article><p>One</p><div class='row'><div class='col-4'><ul><li>a<ol><li>b</li></ol></li></ul>"
        "<br></div><div class='col-8'>Two<div class='row'><div class='col'>In</div><div class='col'>ner</div></div></div></div>"
        "<div class='row'><div class='col'>x</div></div><ul><li>c<ul><li>d</li></ul></li></ul></article></body></html>")


def scans(df) -> int:
    return len(re.findall(r"Scan parquet|FileScan|Scan ExistingRDD|LocalTableScan", df._jdf.queryExecution().executedPlan().toString()))


def test_columns_are_counted_where_they_are_placed(spark, tmp_path, pages_of):
    pages_of(HTML, "<article><div class='row'><p>no column</p></div></article>", "").write.parquet(str(tmp_path / "pages"))
    found = Y.columns_block(extracted_rows(spark.read.parquet(str(tmp_path / "pages")), css="article"))
    assert scans(found) == 1
    rows = sorted((r.page_id, r.columns, r.markup.count("<!-- wp:column ")) for r in found.collect())
    assert rows == [(0, 1, 1), (0, 2, 4)]


def test_layout_conversion_renders_its_blocks_once(spark, tmp_path, pages_of):
    pages_of(HTML, "", "<article></article>").write.parquet(str(tmp_path / "pages"))
    done = convert_pages_layout(spark.read.parquet(str(tmp_path / "pages")), css="article")
    # The blocks to count, the blocks to place, and the pages for their titles.
    assert scans(done) == 3
    rows = {r.page_id: r for r in done.collect()}
    assert sorted(rows) == [0, 1, 2] and [rows[i].status for i in range(3)] == ["ok", "skipped", "skipped"]
    assert rows[0].body.count("<!-- wp:list ") == 4 and rows[0].body.count("<!-- wp:columns -->") == 3
    assert rows[1].body == "" and rows[1].blocks == 0
