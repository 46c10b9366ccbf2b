import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """A documents table from (doc_id, text) or full rows; more columns by an extended schema."""

    def build(rows, schema=SCHEMA, parts=3):
        full = [r if len(r) > 2 else (r[0], r[1], "en", "a", len(r[1]) if r[1] is not None else None) for r in rows]
        return spark.createDataFrame(full, schema).repartition(parts)

    return build
