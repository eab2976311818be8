import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang, source) rows."""
    def build(*rows):
        full = [(*r, None, None)[:4] for r in rows]
        return spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in full], SCHEMA)

    return build


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null, empty and blank texts, a null id, repeated rows, one very long text, and columns with clashing names."""
    long = " ".join(f"w{i % 997}x{i % 31}" for i in range(60_000))
    rows = [(1, None, None, None), (2, "", "en", "s"), (3, " \n\t ", "en", "s"), (None, "no id here at all", "en", None),
            (5, "one two three four five", "en", "s"), (5, "one two three four five", "en", "s"), (6, long, "en", "t"),
            (7, "Ünïcode wörds ÄÖ ñ 日本語 text", "de", "t"), (8, "x", "en", "s")]
    extra = "size bigint, row_key string, spans string, rate double, _salt int, repeats string, chunks string, copies int, copy_no int, dropped_id int, score double"
    return spark.createDataFrame(
        [(*r, None if r[1] is None else len(r[1]), 1, "k", "s", 0.5, 1, "r", "c", 2, 3, 4, 0.25) for r in rows], f"{SCHEMA}, {extra}")
