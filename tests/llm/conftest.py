import pytest

#: Texts with the cases every operator must handle.
EDGE_TEXTS = [None, "", "   \n\t ", "one", "two words", "a b c d e", "A B C D E", "x y z", "word " * 30_000]


@pytest.fixture(scope="session")
def documents(spark):
    """Rows with nulls, empty and long texts, repeats, and columns whose names clash with the operators' own."""
    rows = [(i, t, "en", f"s{i % 3}" if i % 4 else None, None if t is None else len(t), "c", "d", 1, 0.5)
            for i, t in enumerate(EDGE_TEXTS)]
    rows += [(1, "", "en", None, 0, "c", "d", 1, 0.5), (None, "no id here at all", "en", "s1", 17, "c", "d", 1, 0.5),
             (None, None, None, None, None, None, None, None, None), rows[4], rows[4]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, "
                                       "size string, _key string, shard int, score double")


@pytest.fixture(scope="session")
def no_documents(documents):
    return documents.limit(0)
