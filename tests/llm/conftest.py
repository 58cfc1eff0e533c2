import pytest

LETTERS = "abcdefghijklmnopqrstuvwxyz"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows and columns with clashing names."""
    long = " ".join(f"word{k % 997}" for k in range(20_000))
    line = "The same line of seven plain words"
    rows = [
        (1, "Hello World, this is one text", "en", "a", 5), (2, "hello world, THIS is one text", "en", "a", 5), (2, "hello world, THIS is one text", "en", "a", 5),
        (3, None, "de", None, None), (4, "", None, "b", 0), (None, "", "en", "b", 0), (None, "text without a number", "en", "c", 3),
        (5, long, "en", "a", len(long)), (6, long + " end", "fr", "a", len(long)), (7, "ÄÖ É ß mixed ÉÉ", "de", "a", 9), (8, " \t\n ", "es", "a", 3),
        (9, f"first\n{line}\nlast words of a text here", "en", "a", 1), (10, f"other\n{line}\n{line}", "en", "a", 1), (11, "x", "en", "a", 1),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    # Names that operators use inside.
    for name in ("row", "fp", "key", "id", "h", "root", "at", "words"):
        df = df.withColumn(name, df.source)
    return df


@pytest.fixture
def stored(spark, tmp_path):
    """Write a frame and read it back, as row numbers need a stable table."""

    def store(df, name="t"):
        df.write.mode("overwrite").parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    return store
