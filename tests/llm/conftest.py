import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, score double, component string"


def filler(seed, n):
    import random

    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeats, ties, clashing names."""
    base = filler(1, 120)
    rows = [
        (1, base, "en", "s", 1, 7, 0.5, "x"),
        (2, base, "en", "s", 1, 7, 0.5, "x"),
        (3, base.replace(" ", "  ") + " tail", "de", None, None, None, None, None),
        (4, None, None, None, None, None, None, None),
        (5, "", "en", "s", 0, 1, 0.1, "y"),
        (6, " \n\t ", "en", "s", 4, 1, 0.1, "y"),
        (7, "one", "fr", "s", 3, 1, 0.1, "y"),
        (7, "one", "fr", "s", 3, 1, 0.1, "y"),
        (8, "1234 !!", "en", "s", 7, 1, 0.1, "y"),
        (None, base, "en", "s", 1, 1, 0.1, "y"),
        (None, None, None, None, None, None, None, None),
        (9, filler(2, 4000), "de", "s", 1, 1, 0.1, "y"),
        (10, "ünïcode é 漢字 😀 " + filler(3, 30), "fr", "s", 1, 1, 0.1, "y"),
        (-3, "A shared line of text here.\nshort\n" + filler(4, 40) + ".", "en", "s", 1, 1, 0.1, "y"),
        (11, filler(5, 40) + ".\n  a SHARED line of text here. \nshort", "en", "s", 1, 1, 0.1, "y"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small():
    """Documents of the smallest test table, as (doc_id, text)."""
    pq = pytest.importorskip("pyarrow.parquet")
    path = "/root/testdata/sf0.001/documents.parquet"
    try:
        return [(r["doc_id"], r["text"]) for r in pq.read_table(path).to_pylist()]
    except OSError:
        pytest.skip("the test tables are not here")


@pytest.fixture(scope="session")
def small_df(spark, small):
    return spark.createDataFrame(small, "doc_id long, text string")
