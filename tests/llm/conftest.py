import pytest


@pytest.fixture
def docs_of(spark):
    """documents from (doc_id, text) pairs, with further columns whose names the operators use themselves."""
    def make(rows, **more):
        cols = "doc_id long, text string, lang string, source string, n_chars long, fp string, node string, part string"
        return spark.createDataFrame(
            [(i, t, more.get("lang", "en"), more.get("source", "s"), len(t) if t is not None else None, "x", "y", "z")
             for i, t in rows], cols)
    return make
