import os
import pathlib
import sys
import tempfile

import pytest

ROOT = str(pathlib.Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])  # for Python workers


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.local.dir", folder)
        .config("spark.sql.warehouse.dir", f"{folder}/warehouse")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def same():
    """Compares a Spark result with a DuckDB one: columns by name, rows in any order."""
    import pandas as pd

    def cell(x):
        if hasattr(x, "tolist") and not isinstance(x, (str, bytes)):
            x = x.tolist()
        if isinstance(x, (list, tuple)):
            return "[" + ",".join(map(cell, x)) + "]"
        if x is None or x is pd.NA or x is pd.NaT or x != x:
            return "null"
        if isinstance(x, bool):
            return str(x)
        if isinstance(x, (int, float)) and not isinstance(x, str):
            return f"{x:.9g}" if isinstance(x, float) and x != int(x) else str(int(x))
        return str(x)

    def rows(df):
        df = df[sorted(df.columns)].astype(object)
        return sorted(tuple(map(cell, r)) for r in df.itertuples(index=False))

    def check(a, b):
        assert sorted(a.columns) == sorted(b.columns)
        assert rows(a) == rows(b)

    return check
