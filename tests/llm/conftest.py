import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, a clashing extra column."""
    a = "The cat sat on the mat and looked at the dog that lay in the sun all day long without a care"
    rows = [
        (1, a, "en", "s1", 5, "x"),
        (2, a, "en", "s1", 5, "y"),
        (3, a + " and more words follow here", None, None, None, None),
        (4, None, "en", "s2", None, "z"),
        (5, "", "de", "s2", 0, "z"),
        (6, "   \n\t ", "de", "s2", 6, "z"),
        (7, "Hi", "fr", "s3", 2, "z"),
        (8, "it's we're 'tis <|endoftext|> été 日本語 😀 ½", "fr", "s3", 2, "z"),
        (9, "word " * 3000 + "tail", "fr", "s1", 2, "z"),
        (9, "word " * 3000 + "tail", "fr", "s1", 2, "z"),
        (10, "prefix words " + a, "fr", None, 2, "z"),
        (None, a, "en", "s1", 5, "z"),
        (None, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words string")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
