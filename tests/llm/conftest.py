import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in any column, empty and long texts, ties, repeated rows and a column with a clashing name."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
    prose = lambda n, k: " ".join(words[(i * i * k + 7 * i + k) % 24] + str((i * k) % 5) * (i % 3 == 0) for i in range(n))
    rows = [
        (1, prose(80, 1), "en", "a", 1), (2, prose(80, 1), "en", "a", None), (2, prose(80, 1), "en", "a", None), (3, None, None, None, None), (4, "", "en", None, 0),
        (5, " \t\n\x0b", "en", "b", 4), (6, prose(9000, 3), "en", "b", 1), (7, "token = \"0123456789abcdef0123456789abcdef01234567\" Ünïcödé 字字字 \U0001f600 end", "de", "b", 9),
        (8, prose(120, 5) + "\nsame line here\nsame line here\n" + prose(30, 7), "en", "c", 3), (None, prose(60, 11), "en", "c", 3), (None, None, None, None, None), (9, "one", "en", "ü", 3), (10, "one two three", "en", "ü", 3),
    ]
    df = spark.createDataFrame(rows, DOCS)
    return df.selectExpr("*", "'x' as spans", "1 as taken", "2 as kept", "3 as fp", "'k' as kid", "0 as target", "5 as size", "'y' as found")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
