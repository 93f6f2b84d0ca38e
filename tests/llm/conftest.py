import pytest


@pytest.fixture(scope="session")
def edge_rows(spark):
    """Documents with nulls in every column, empty and very long texts, ties, repeated rows and clashing columns."""
    long_text = " ".join(f"word{i}" for i in range(30_000))
    near = " ".join(f"near{i}" for i in range(60))
    rows = [
        (1, "", "en", "a"), (2, None, None, None), (None, "no id here but words enough to be a text", "en", "a"),
        (3, long_text, "en", "b"), (4, long_text, "de", "b"), (5, " \t\n ", "en", "a"), (6, near, "en", "a"), (7, near + " tail", "fr", "a"),
        (7, near + " tail", "fr", "a"), (8, "tie", "en", "a"), (9, "tie ", "en", "a"), (10, "t i e", "en", "a"), (11, "été 日本 🙂\nshared line of text\n", "fr", "c"),
        (12, "shared line of text\nown line of twelve\nSHARED LINE OF TEXT ", "en", "c"), (13, "1234 !!", "en", "c"),
    ]
    # ids, leaks, n_lines and the like are names that operators use themselves.
    shape = "doc_id long, text string, lang string, source string"
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, shape).withColumns({
        name: F.lit("mine") for name in ("key", "n", "label", "prefix", "pos", "line", "batch", "digest", "node", "token", "other", "c0", "letters")
    })


@pytest.fixture(scope="session")
def no_rows(edge_rows):
    return edge_rows.limit(0)
