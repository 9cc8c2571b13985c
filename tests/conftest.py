import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def transcripts(spark, tmp_path_factory):
    """Two files of three lines each, loaded."""
    from parley.sources.transcripts import read_transcripts

    d = tmp_path_factory.mktemp("talks")
    (d / "a_2015.txt").write_text("K: It's the water that's gone.\nJ: The water, and the river!\nno colon here\n")
    (d / "b_2016.txt").write_text("K: River fishing: we don't stop.\nM: Fishing the river.\nM: Fishing the river.\n")
    return read_transcripts(spark, str(d)).cache()
