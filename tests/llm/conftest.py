import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, score string, n string, id string, size string, spans string, _id string, copies string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of (doc_id, text[, lang[, source]]) rows with more columns whose names operators use."""

    def make(rows):
        full = [(*r, *[None] * (4 - len(r)), None if r[1] is None else len(r[1]), *["x"] * 8) for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(3)

    return make
