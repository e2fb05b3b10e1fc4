import pytest

from strataframe.llm.shared import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, name string, score double, spread long, part int, start long"


@pytest.fixture
def scratch(spark, tmp_path):
    made = Scratch(spark)
    made.folder = str(tmp_path)
    return made


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls everywhere, empty and long texts, ties, repeated rows, and columns whose names the operators use themselves."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    texts = ["", None, "one", "two words", "a b c d e f g h i j k l", "A b  c\td e f g h i j k l", long, long + " end", "é" * 70, "x " * 40, "\n\n \t"]
    rows = [(i, t, None if i % 3 else "en", None if i % 4 == 0 else f"s{i % 3}", None, None, None, None, None, None) for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, "a b c d e f g h i j k l", None, None, None, "n", 1.0, 1, 1, 1), (None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
