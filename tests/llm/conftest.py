import pytest

#: Rows that every text operator must take: null id, null and empty texts, repeats, odd spaces, clashing columns.
ROWS = [
    (1, "The cat sat on the mat and looked at the dog for a while."),
    (1, "The cat sat on the mat and looked at the dog for a while."),
    (None, "The cat sat on the mat and looked at the dog for a while."),
    (2, None),
    (3, ""),
    (4, "  \t\n "),
    (5, "a"),
    (6, "Über größe naïve café 😀 \u3000 x\x1cy  z"),
    (7, "word " * 30_000),
    (8, "x" * 60_000),
]


@pytest.fixture
def odd(spark):
    """The rows above with columns named like results."""
    schema = "doc_id bigint, text string, score double, id string, fp int, n_tokens string, __row int, key string, lang string"
    return spark.createDataFrame([(*r, 0.5, "i", 3, "n", 4, "k", None) for r in ROWS], schema).repartition(3)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
