import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def documents(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]


@pytest.fixture
def odd_docs(spark):
    """Nulls in every column, empty and blank texts, repeated rows, ties, one long text, and columns whose names clash."""
    long = " ".join(f"w{i % 977} end{i}." for i in range(9000))
    rows = [(1, "Alpha beta gamma. Delta epsilon zeta eta theta.", "s", 1), (1, "Alpha beta gamma. Delta epsilon zeta eta theta.", "s", 1), (2, None, "s", None),
            (3, "", None, 0), (4, " \t\n ", "s", 4), (None, "one two three", "t", 5), (None, None, None, None), (5, long, "u", len(long)),
            (6, long, "u", len(long)), (7, "x", "t", 1), (8, "x", "t", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    extra = {c: docs["n_chars"] for c in ("size", "target", "row", "key", "n", "kind", "spans", "star", "length", "severity", "removed", "label")}
    return docs.withColumns(extra)
