import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Builds a documents table from (doc_id, text, source) rows."""

    def build(rows):
        full = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows]
        return spark.createDataFrame(full, DOCUMENTS)

    return build


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and white-space texts, a very long text, ties and repeated rows."""
    long_text = "".join(f"word{i % 977} " for i in range(60_000))
    return [
        (1, "a quick brown fox jumps over the lazy dog", "s1"),
        (1, "a quick brown fox jumps over the lazy dog", "s1"),
        (1, "another text of the same id", "s2"),
        (2, None, "s1"),
        (3, "", None),
        (4, " \t\r\n ", "s2"),
        (None, "an id that is null", "s3"),
        (None, None, None),
        (5, long_text, "s3"),
        (6, "x" * 50_000, "s1"),
        (7, "ÀÉÎ ß ẞ İ 日本語 🙂 don't it's ́a", "s2"),
        (8, "a quick brown fox jumps over the lazy dog", "s3"),
        (9, "<|endoftext|> and <|startoftext|>x", "s1"),
    ]
