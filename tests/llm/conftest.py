import os

import pytest

HEAD = "doc_id long, text string, lang string, source string, n_chars long"
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog. Mail jo.doe@mail7.example.com now!", "en", "a", 80),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, "Größe, naïve café — straße!\n\nzwei  Leerzeichen\t und 10.1.2.3 Ende ", "de", "b", 60),
    (5, "call +1 (826) 555-4081 or pay 4111 1111 1111 1111.", "en", "b", 50),
    (5, "call +1 (826) 555-4081 or pay 4111 1111 1111 1111.", "en", "b", 50),
    (None, "a row without an id, but with some words in it", "en", "c", 46),
    (7, "word " * 3000 + "end", "en", "b", 15003),
    (8, " , .\n.,x\r\n<|endoftext|> 漢字😀 a.b,c ..", "xx", "\U0001F600", 30),
    (9, "x" * 5000, "en", "a", 5000),
]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(ROWS, HEAD)


@pytest.fixture(scope="session")
def clashing(spark):
    """The same rows with columns whose names the operators use themselves."""
    rows = [(*r, i, "z", [1], 0.5) for i, r in enumerate(ROWS)]
    return spark.createDataFrame(rows, HEAD + ", size long, ids string, spans array<int>, n double")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], HEAD)


@pytest.fixture(scope="session", autouse=True)
def workers_find_the_package(spark):
    from scanloom.llm.queries import ROOT

    spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH", "")]))
