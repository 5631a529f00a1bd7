import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark import cloudpickle

    import turnwise
    from turnwise.session import build_session

    cloudpickle.register_pickle_by_value(turnwise)
    session = build_session("local[4]", app="turnwise-tests", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def tiny_chunks(spark):
    """Treat every key with more than a few rows as hot."""
    spark.conf.set("spark.turnwise.chunkRows", "6")
    yield
    spark.conf.unset("spark.turnwise.chunkRows")
