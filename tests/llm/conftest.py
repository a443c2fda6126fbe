from __future__ import annotations

import pytest
from llm_prose import prose

WHITE = " \t\n\x0b\x0c\r"


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text): nulls, empty and white texts, repeats, a very long text, no id."""
    long = prose(1, 60_000)
    return [
        (1, prose(2, 300)),
        (2, None),
        (3, ""),
        (4, WHITE),
        (5, prose(2, 300)),
        (6, prose(2, 300)),
        (6, prose(2, 300)),
        (7, long),
        (8, "x" * 200_000),
        (9, "one two three"),
        (None, prose(3, 120)),
        (None, "one two three"),
        (10, prose(4, 90) + "\n" + prose(5, 60)),
        (11, "é ß 漢字 🙂   tail " + prose(6, 70)),
    ]


@pytest.fixture(scope="session")
def documents(spark, odd_rows):
    """The odd rows with the other columns of documents and clashing names."""
    rows = [(i, t, None if k % 4 == 0 else "en", None if k % 5 == 0 else f"s{k % 2}", None, "clash", -1) for k, (i, t) in enumerate(odd_rows)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words string, n_tokens int").repartition(3)


@pytest.fixture(scope="session")
def nothing(documents):
    return documents.where("false")
