import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")


@pytest.fixture(scope="session")
def spark():
    from labelspark.session import build_session

    session = build_session("tests", "local[4]", 4, {
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "6g",
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def values(spark):
    """Evaluate a column function over a list of argument tuples."""
    from pyspark.sql import functions as F

    def run(function, rows, schema):
        names = [part.split()[0] for part in schema.split(",")]
        data = [(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)]
        df = spark.createDataFrame(data, "_i int, " + schema)
        out = df.select("_i", function(*[F.col(n) for n in names]).alias("v")).collect()
        return [r.v for r in sorted(out, key=lambda r: r._i)]

    return run
