import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture()
def docs(spark):
    """A frame of (doc_id, text) with extra columns whose names clash with the operators' own."""

    def make(rows, extra=True):
        frame = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
        return frame.selectExpr("*", "1 as score", "'x' as shard", "2 as n_lines", "3 as leaks", "4 as Slot") if extra else frame

    return make


SENTENCES = [
    "The quick brown fox jumps over the lazy dog near the river bank at dawn every single day",
    "A completely different sentence about shipping containers and the price of steel in winter months",
    "Nobody expected the orchestra to play the second movement before the soloist had arrived on stage",
    "Several species of moss grow on the northern side of old stone walls in damp and shaded valleys",
]


@pytest.fixture()
def sentences():
    return SENTENCES
