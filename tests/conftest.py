import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
               .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
               .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    from specmap.session import ship_package
    ship_package(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def table(spark):
    """Rows of a matrix as (star_id, <name>)."""
    def make(matrix, name="phi", kind=None):
        kind = kind or (pa.float32() if name == "phi" else pa.float64())
        rows = pa.array(list(np.asarray(matrix)), pa.list_(kind))
        return spark.createDataFrame(pa.table({"star_id": np.arange(len(matrix)), name: rows}))
    return make


@pytest.fixture(scope="session")
def matrix():
    """(star_id, <name>) back to a matrix in star_id order."""
    return lambda df, name: np.stack(df.select("star_id", name).toPandas().sort_values("star_id")[name].to_numpy())
