import pytest


@pytest.fixture
def docs(spark):
    """Makes a documents table, with an extra column whose name operators use inside."""

    def make(rows, extra=True):
        df = spark.createDataFrame([(k, t) for k, t in rows], "doc_id long, text string")
        return df.selectExpr("*", "'en' AS lang", "'s' AS source", "length(text) AS n_chars", "1 AS key", "'x' AS score", "0 AS mark", "0 AS n") if extra else df

    return make


#: Nulls, empty and white space texts, short ones, ties and repeated rows, a very long text, line breaks of all kinds.
EDGE = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (5, "one"), (6, "two words"), (7, "Ünï çödé \x0b wörd s x"), (8, " ".join(f"w{i % 997}" for i in range(60_000))), (9, " ".join(f"w{i % 997}" for i in range(60_000))), (10, "a" * 5000)]


@pytest.fixture
def edge(docs):
    return docs(EDGE)
