import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pageloom.session import build_session, release  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "6g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    release(session)
    session.stop()


@pytest.fixture(scope="session")
def pages_of(spark):
    """DataFrame of pages from a list of HTML strings (or (url, html) pairs)."""
    def build(*docs):
        rows = []
        for number, doc in enumerate(docs):
            url, html = doc if isinstance(doc, tuple) else ("https://www.Example.com/a/b.html?x=1", doc)
            rows.append((number, url, html))
        return spark.createDataFrame(rows, "page_id bigint, url string, html string")

    return build
