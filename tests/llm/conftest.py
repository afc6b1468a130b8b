import duckdb
import pytest

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def root():
    return ROOT


@pytest.fixture(scope="session")
def texts():
    """Whole texts of the small table by id."""
    return dict(duckdb.sql(f"select doc_id, text from '{ROOT}/documents.parquet'").fetchall())


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null and empty texts, a null and a repeated id, null columns, a long text, and columns whose names operators use."""
    long = " ".join(f"word{i % 5000} of a long text" for i in range(40_000))
    rows = [
        (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "src1", 1, "x", 0.5, 7),
        (2, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "src1", 1, "x", 0.5, 7),
        (2, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "src1", 1, "x", 0.5, 7),
        (3, None, None, None, None, None, None, None),
        (4, "", "en", "", 0, "", 0.0, 0),
        (5, "  \n\t ", "en", "src2", 0, "y", 0.0, 0),
        (6, "one", "de", "src2", 3, "y", 0.0, 0),
        (7, "12 34 !!", "de", "other", 3, "y", 0.0, 0),
        (8, long, "en", "src1", len(long), "y", 0.0, 0),
        (None, "Ein Text ohne Kennung und mit der MIT License", "de", "src3", 4, "z", 1.0, 1),
        (9, "Ein Text mit Kennung: GNU General Public License, mit license.", "de", "src3", 4, "z", 1.0, 1),
    ]
    kind = "doc_id long, text string, lang string, source string, n_chars long, label string, score double, shard int"
    return spark.createDataFrame(rows, kind)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
