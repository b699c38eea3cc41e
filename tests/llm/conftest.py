import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, base string, spans int, score double, block int, key string, component_id string"
LONG = " ".join(f"word{k % 977}" for k in range(20_000))
ODD = [
    (1, None, "en"),
    (2, "", "en"),
    (3, "   \t\n", None),
    (4, LONG, "en"),
    (5, "a short text", "en"),
    (5, "a short text", "en"),
    (6, "a short text", None),
    (None, "text without an id", "en"),
    (None, None, None),
    (7, "🎉🎉 naïve Straße ΟΔΟΣ İstanbul 12 345", "de"),
    (8, "x" * 5000, "en"),
    (9, "1234 5678 !!", "en"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, extra columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, l, None, None, "keep", 1, 0.5, 2, "k", "c") for i, t, l in ODD], SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
