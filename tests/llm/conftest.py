import pytest

#: Columns that every input has besides, with names that operators use themselves.
CLASH = "size int, key string, node long, n_tokens string, rep int, start int, part string"


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a documents table from rows (doc_id, text) or (doc_id, text, source), with clashing columns."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), 1, "k", 2, "t", 3, 4, "p") for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, " + CLASH)

    return make


@pytest.fixture(scope="session")
def edge(documents):
    """Nulls, empty and long texts, repeated rows, blanks only."""
    return documents([(1, None), (2, ""), (3, "a b c d e f g"), (3, "a b c d e f g"), (4, "word " * 30_000), (5, " \n\t "), (None, "x y"), (6, "naïve 漢字 😀 <|endoftext|> it's"), (7, "a b c d e f g", None)])
