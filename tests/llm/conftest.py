import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, fp string, spans string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of (doc_id, text[, lang, source]) rows, with extra columns whose names operators use themselves."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "h", len(r[1] or ""), "x", "y", "z") for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
