import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def docs(spark):
    """Make a documents table from (doc_id, text[, source]) rows, with columns whose names could clash."""

    def make(*rows):
        made = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), "x", 1, "y") for r in rows]
        return spark.createDataFrame(made, DOCS + ", chunk string, quality int, `mix` string")

    return make
