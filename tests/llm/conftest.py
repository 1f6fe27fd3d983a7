import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from texts, or from (doc_id, text) or (doc_id, text, lang, source)."""

    def make(rows):
        full = []
        for k, r in enumerate(rows):
            r = r if isinstance(r, tuple) else (k, r)
            r = (*r, "en", "src0")[:4] if len(r) < 4 else r
            full.append((*r, len(r[1]) if r[1] is not None else None))
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def odd_docs(spark, docs_of):
    """Nulls in any column, empty and long texts, ties, repeated rows and an extra column with a clashing name."""
    from pyspark.sql import functions as F

    long = " ".join(f"word{i % 997}" for i in range(20_000))
    rows = [(1, None, "en", "a"), (2, "", None, None), (None, "a text without id " * 6, "en", None), (3, long, "en", "a"), (4, "same text here " * 9, "fr", "b"), (4, "same text here " * 9, "fr", "b"), (5, "same text here " * 9, None, "b"), (6, "   \n\t\n", "en", "a"), (7, "1234 !!", "en", "a")]
    return docs_of(rows).withColumns({"n": F.lit(1), "_doc": F.lit("x"), "count": F.lit(2), "ids": F.lit(3)})


@pytest.fixture(scope="session")
def clashing():
    """Adds columns whose names operators use for their own, each with its name as its value."""
    from pyspark.sql import functions as F

    names = ["_doc", "_th", "_t1", "_t2", "_line", "_row", "_n", "_q", "_w", "_h", "_lang", "_source", "_docs", "_split", "_stays", "_pos", "removed", "word_length_high", "symbol_ratio_high", "h", "w", "id", "item_id", "node", "root", "key", "html", "text_", "spans", "kept", "a.b", "tick`ed"]

    def add(df):
        return df.select("*", *[F.lit(n).alias(n) for n in names])

    def unharmed(df):
        return all(r[n] == n for r in df.collect() for n in names)

    add.unharmed = unharmed
    return add
