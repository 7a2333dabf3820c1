import os
import sys
from pathlib import Path

import pytest

HERE = Path(__file__).parent
sys.path[:0] = [str(HERE.parent)]

from pyspark.sql import SparkSession  # noqa: E402

from lectern.session import prepare  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    builder = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    session = builder.config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint"))).config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield prepare(session)
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def duck(sf):
    """DuckDB with the tables of ``sf`` as views."""
    import duckdb

    con = duckdb.connect()
    for f in Path(sf).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def same_rows(got, want) -> None:
    """Equal bags of rows, columns by name, numbers to six places."""
    import pandas as pd

    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)

    def norm(v):
        if pd.isna(v):
            return "-"
        return f"{float(v):.6f}" if isinstance(v, (int, float)) or type(v).__module__ == "numpy" and not isinstance(v, str) else str(v)

    a = sorted(tuple(map(norm, r)) for r in got[cols].astype(object).values.tolist())
    b = sorted(tuple(map(norm, r)) for r in want[cols].astype(object).values.tolist())
    assert a == b


@pytest.fixture(scope="session")
def same():
    return same_rows
