import pytest


@pytest.fixture(autouse=True)
def _reachable(spark):
    from eventmill.llm.queries import reachable

    reachable(spark)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """NULLs, empty and very long texts, ties, repeated rows, and columns named like results."""
    long = " ".join(f"word{i % 977} the of" for i in range(40_000))
    rows = [
        (1, "the same  text here now", "en", "keep_id", 7),
        (2, "the same\ttext here now", "en", None, 7),
        (2, "the same\ttext here now", "en", None, 7),
        (None, "the same text here now", None, "x", None),
        (None, None, None, None, None),
        (5, None, "de", "s", 0),
        (6, "", "de", "s", 0),
        (7, " \n\t ", "fr", "s", 0),
        (8, long, "en", "s", 1),
        (9, long, "en", "s", 1),
        (10, "short", "en", "s", 1),
        (11, "№ 42 + 17 = 59 !!!", "en", "s", 1),
        (12, "Ünïcode 日本 ▁ text \U0001f642", "de", "s", 1),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, kept string, n_tokens long")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
