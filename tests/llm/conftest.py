import pytest
from pyspark.sql import Row


@pytest.fixture(scope="session", autouse=True)
def shared_folder(spark, tmp_path_factory):
    """A folder for written tables where the session names none."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


ODD = [
    (1, "a b c d e f g h", "x"),
    (1, "a b c d e f g h", "x"),
    (2, None, None),
    (3, "", "x"),
    (4, " \n\t", "x"),
    (None, "a b c d e f g h", None),
    (None, None, None),
    (5, "one", "x"),
    (6, "w " * 60_000 + "end", "x"),
    (7, "é ß ñ Ñ 中文 a\x00b \x1c", "x"),
    (1, "other text under the same id", "x"),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, repeated rows and ids, and columns named like those of the operators."""
    clash = "doc_id long, text string, source string, key_a string, keep string, score string, tid int, n_words string, lang string"
    return spark.createDataFrame([(*row, "c", "c", "c", 1, "c", "c") for row in ODD], clash)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.fixture(scope="session")
def some_labels(spark):
    rows = [Row(doc_id=d, quality=d % 2, toxic=d % 2) for d in (1, 2, 3, 4, 5, 6, 7)]
    return spark.createDataFrame([*rows, Row(doc_id=99, quality=1, toxic=0), Row(doc_id=5, quality=0, toxic=0), Row(doc_id=None, quality=1, toxic=1), Row(doc_id=4, quality=None, toxic=None)])
