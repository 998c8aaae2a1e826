import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, src string, kept string, band long, copies long"

PROSE = ["the quick brown fox jumps over the lazy dog", "le renard brun saute par dessus le chien paresseux", "der schnelle braune fuchs springt ueber den faulen hund"]


def rows():
    out = [(i, f"{PROSE[i % 3]} {i} and more words {i * 7} here\nsecond line {i}\nthird line", ("en", "fr", "de")[i % 3], f"src{i % 4}", 10) for i in range(24)]
    out += [(100, None, "en", "src0", 0), (101, "", None, None, 0), (102, "   \n \n", "en", "src1", None), (103, "!!! ... ???", None, "src2", 5)]
    out += [(None, "a text without an id but with some words", "en", "src1", 3), (5, out[5][1], "de", "src1", 10), (5, out[5][1], "de", "src1", 10)]
    out += [(104, ("long words repeat in a very long text " * 4000), "en", "src3", 1), (105, "x" * 50_000, None, "src3", 1), (106, out[1][1], "fr", "src0", 1)]
    return [(*r, "k", "s", "no", 7, 9) for r in out]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows and columns with clashing names."""
    return spark.createDataFrame(rows(), SCHEMA).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
