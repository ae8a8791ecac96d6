import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pseudoveil.session import checkpoint_dir, local_session
    s = local_session(cores="*", shuffle_partitions=8, app="pseudoveil-tests")
    checkpoint_dir(s)
    yield s
    s.stop()


def run_col(spark, fn, texts):
    """Apply a findings-array column function to each text; return per-text
    lists of (value, start, end) or of full finding dicts."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    rows = df.select("i", fn(F.col("text")).alias("x")).orderBy("i").collect()
    return [[(f["value"], f["start"], f["end"]) for f in r["x"]] for r in rows]
