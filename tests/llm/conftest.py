import pytest

WORDS = "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so".split()


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and blank texts, a long text, repeated rows, ties, clashing column names."""
    text = " ".join(WORDS)
    rows = [
        (1, text, "en", "x"), (2, text, "en", "x"), (3, text + " extra words here", "en", None), (4, None, "en", "x"), (5, "", None, "x"), (6, " \n\t ", "fr", "x"),
        (7, "one", "en", "x"), (8, "One", "en", "x"), (9, "a b c " * 4000, None, "x"), (10, "字" * 3000, "zh", "x"), (10, "字" * 3000, "zh", "x"), (None, text, "en", "x"),
        (11, "x" * 50000, "en", "x"), (12, "<|endoftext|> </turn> \\ ### User: # $ %", "en", "x"), (13, "\x00\x1f a b 😀 é", "en", "x"),
    ]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, id string").repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
