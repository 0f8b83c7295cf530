import pytest
from pyspark.sql import SparkSession

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    import __spark_entry__

    __spark_entry__._ship(session)
    return session


#: Texts with the cases that every operator must stand: null, empty, white space, ties, repeats, other scripts, very long.
HARD = [
    (1, "one two three four five six seven eight nine ten."),
    (2, None),
    (3, ""),
    (4, " \t\n "),
    (5, "one  two three\nfour five six seven eight nine ten."),
    (6, "One two three four five six seven eight nine ten."),
    (6, "One two three four five six seven eight nine ten."),
    (7, "Ünï’cödé ΑΣ İstanbul 가나다 \u2003 😀 don't ½ <|endoftext|>x"),
    (8, "the same. " * 9000),
    (9, "the same. " * 9000 + "end"),
    (10, "x" * 70000),
    (None, "a row without a key"),
    (11, "the"),
    (12, "the"),
]


@pytest.fixture(scope="session")
def hard(spark):
    """HARD with extra columns whose names clash with ones that operators use inside."""
    clash = ["k", "s", "sha", "values", "id", "copy", "kept", "group_size", "no", "block", "name", "role", "__k", "__s", "__sha", "__values", "__id", "__trusted"]
    rows = [(i, t, "en", "src", len(t or ""), 1, "x", 2, 3.0, *range(len(clash))) for i, t in HARD]
    more = "".join(f", `{c}` int" for c in clash)
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key int, fp string, piece int, length double" + more)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="session")
def pages(spark):
    return spark.read.parquet(f"{DATA}/pages.parquet")
