import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    top = tmp_path_factory.mktemp("spark")
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", f"file://{top}/shared")
        .config("spark.sql.warehouse.dir", f"{top}/warehouse")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, and columns whose names clash with inner ones."""
    line = "one two three four five six seven eight nine ten "
    texts = [None, "", " \n\t", "word", line, line, line * 4000, line.upper(), "é ü ß 漢字 " * 30, "a" * 70000, "token=abcdefgh AKIA" + "B" * 16]
    rows = [(i if i % 5 else None, t, None, "s", None, "x", i, "k") for i, t in enumerate(texts)]
    rows += [(7, line, "en", None, 3, "x", 1, "k"), (7, line, "en", None, 3, "x", 1, "k"), (4, "other text under the same id", "en", "s", 3, None, None, None)]
    return spark.createDataFrame(rows, DOCS + ", sig string, s long, row_key string")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
