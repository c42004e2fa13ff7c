import duckdb
import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def real(small):
    """(doc_id, text) of the smallest documents."""
    return duckdb.sql(f"select doc_id, text from '{small}/documents.parquet' order by doc_id").fetchall()


@pytest.fixture(scope="session")
def documents(spark):
    """Documents from texts, (id, text), (id, text, source) or (id, text, source, lang)."""
    def make(rows):
        full = []
        for i, r in enumerate(rows):
            r = r if isinstance(r, tuple) else (i, r)
            doc_id, text, source, lang = (*r, *("src0", "en")[len(r) - 2:])
            full.append((doc_id, text, lang, source, None if text is None else len(text)))
        return spark.createDataFrame(full, COLUMNS)
    return make
