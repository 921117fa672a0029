import pytest

#: A very long text, a tie, repeated rows, null and empty texts, a null id, and text beyond ASCII.
LONG = " ".join(f"w{i % 977}" for i in range(60_000))
ROWS = [
    (1, "Plain words about nothing much at all, really.", "en", "a", 46),
    (2, "Plain words about nothing much at all, really.", "en", "a", 46),
    (3, None, None, None, None),
    (4, "", "en", "b", 0),
    (5, LONG, "en", "a", len(LONG)),
    (5, LONG, "en", "a", len(LONG)),
    (None, "No id here, but mail me@site.example.org please.", "en", "c", 48),
    (6, "Ünïcode 中文 ١٢٣ <|endoftext|> \x85\u2028 ʼn", "xx", None, 3),
    (7, " \t\n ", "en", "b", 4),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents of every odd kind, with extra columns whose names clash with the operators' own."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ROWS, SCHEMA)
    clashing = ["score", "id", "cid", "sig", "grp", "h", "size", "shard", "part", "spans", "media", "_id", "_y", "copy_of_another", "length"]
    return df.withColumns({c: F.lit(f"own {c}") for c in clashing})


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")
