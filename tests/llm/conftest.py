import pytest

#: Documents with every odd case: nulls, empty and very long texts, ties and repeated rows.
ODD = [
    (0, "The cat sat on the mat. The cat sat on the mat."),
    (1, None),
    (2, ""),
    (3, "   \n\t "),
    (5, "naïve café — 東京 \U0001f600 test nbsp  two  blanks \n\n lines\r\nend "),
    (7, "It's the cat's don't we'll 12345 <|endoftext|> a1b2"),
    (7, "It's the cat's don't we'll 12345 <|endoftext|> a1b2"),
    (10, "<|endoftext|><|endoftext|> \n<|endoftext|>x  <|endoftext|"),
    (8, "word " * 20000 + "end"),
    (9, "The cat sat on the mat. The cat sat on the mat."),
    (None, "no id here"),
    (-4, "negative id separator\x1cfile"),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """The odd documents, with more columns than an operator asks for and names that clash with results."""
    rows = [(i, t, "en" if k % 2 else None, None if k == 3 else f"s{k % 3}", k, 5, 1.0) for k, (i, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_tokens long, score double")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
