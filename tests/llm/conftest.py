import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

#: Nulls in any column, empty and very long texts, ties, repeated rows, odd white space, several scripts.
ROWS = [
    (0, "The quick brown fox jumps over the lazy dog, again and again. Call +1 (269) 555-3296 or mail a.b@mail1.example.com now.", "en", "s", 1),
    (1, None, "en", None, None),
    (2, "", None, "s", 0),
    (3, "word " * 30_000, "en", "s", 150_000),
    (4, "Ünïcödé täxt\tmit harten  Leerzeichen\n\nund ÄÖÜ 字符 🙂 1.2.3.4 und 4111 1111 1111 1111.", "de", "s", 3),
    (5, "the quick brown fox jumps over the lazy dog, again and again. Call +1 (269) 555-3296 or mail a.b@mail1.example.com now.", "en", "s", 2),
    (5, "the quick brown fox jumps over the lazy dog, again and again. Call +1 (269) 555-3296 or mail a.b@mail1.example.com now.", "en", "s", 2),
    (7, " \n \t ", "en", "s", 5),
    (8, "DE89 3704 0044 0532 0130 00 is an iban; 300.1.1.1 is none; a@b.c@d.e and x@y, 021000021 routing number", "en", "s", 9),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ROWS, DOCS).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clash(odd):
    """Extra columns with the names that the operators use themselves."""
    from pyspark.sql import functions as F

    names = ("h", "hash", "n", "start", "end", "length", "bucket", "blob", "spans", "score", "label", "toxic", "component_id", "sequence_id", "key", "id", "src", "dst", "rn", "part")
    return odd.withColumns({x: F.lit("x") for x in names})



@pytest.fixture(scope="session")
def real(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
