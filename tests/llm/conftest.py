import pytest

#: Rows that every text operator must survive: null, empty, blank, long, repeated, odd characters, and clashing columns.
AWKWARD = [(0, None), (1, ""), (2, " \n\t "), (3, "a" * 30_000), (4, "the same text twice, the same text twice"), (4, "the same text twice, the same text twice"), (5, "naïve café 😀   x"), (None, "a row without an id")]


@pytest.fixture
def awkward(spark):
    rows = [(i, t, None, f"s{k % 2}", None if t is None else len(t), "x", k, None) for k, (i, t) in enumerate(AWKWARD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, token_ids int, h string")


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
