import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (SparkSession.builder.master("local[4]").appName("tests")
               .config("spark.sql.shuffle.partitions", "4")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.driver.memory", "6g")
               .config("spark.ui.enabled", "false").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    from fringelake.shipping import ship
    ship(session)
    yield session
    session.stop()


@pytest.fixture
def vis_frame(spark):
    """Make a DataFrame of samples from arrays."""
    import pandas as pd

    def make(**columns):
        return spark.createDataFrame(pd.DataFrame(columns))

    return make
