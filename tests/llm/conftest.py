import pytest

TOKENIZER = "byte_bpe_50k.json"


@pytest.fixture(scope="session")
def tokenizer():
    from inkwell.llm.token_files import tokenizer_path

    return tokenizer_path(TOKENIZER)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, tiny and long texts, repeated rows and ids, and extra columns with clashing names."""
    words = " ".join(f"w{i}" for i in range(60))
    rows = [
        (0, words, "en", "a", 1, 7), (1, words, "en", "a", 2, 7), (2, None, None, None, None, None), (3, "", "en", "b", 0, 7),
        (4, " \n\t", "en", "b", 0, 7), (5, "one", "de", "b", 3, 7), (5, "one", "de", "b", 3, 7), (5, "other text here", None, "b", 3, 7),
        (None, words + " tail", "en", None, 5, 7), (6, "é ß 日本 " * 30, "fr", "c", 9, 7), (7, "long " * 30000, "en", "c", 9, 7),
        (8, words + " mail me at a.b@c.org now", "en", "a", 9, 7), (9, "x" * 5000, "en", "a", 9, 7), (10, words.upper(), "en", "d", 9, 7),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id long")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
