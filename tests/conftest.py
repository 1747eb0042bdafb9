import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def docs(spark):
    """A few documents with awkward texts."""
    texts = [
        "the cat sat on the mat. the end", "", "   ", "日月水火。木金土 é😀", None,
        "aaaa aaa aa a", "a\nb\n\nthe the", "\u3000x\u2028y\u2029 ", "the mat the cat 2024",
    ]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
