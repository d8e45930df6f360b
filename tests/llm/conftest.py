import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"
#: Null in any column, empty and blank texts, repeated rows, ties.
ODD = [
    (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \n\t ", None, None, 4), (4, "one", "en", None, 3), (4, "one", "en", None, 3),
    (None, "no id here but some words to read", "en", "b", 33), (7, "x" * 200_000, "de", "b", 200_000), (8, "word " * 50_000, "fr", "a", 250_000), (9, "12 34\x00 ▁ é", "", "", 10),
]


@pytest.fixture()
def odd(spark):
    return spark.createDataFrame([(*r, 1, "clash") for r in ODD], DOC + ", kept int, class_id string")


@pytest.fixture()
def none(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture()
def sf():
    import os

    path = "/root/testdata/sf0.01"
    if not os.path.isdir(path):
        pytest.skip("no test data")
    return path
