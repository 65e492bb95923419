import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="countloom-tests-"))
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    found = Path("/root/testdata/sf0.001")
    if not found.exists():
        pytest.skip("no test tables")
    return str(found)


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    return con


def same_rows(df, frame) -> bool:
    """Whether a Spark result and a DuckDB frame hold the same rows under the same names."""
    got = df.toPandas()
    names = sorted(got.columns)
    if names != sorted(frame.columns):
        return False
    rows = [sorted(map(repr, x[names].astype(object).itertuples(index=False, name=None))) for x in (got, frame)]
    return rows[0] == rows[1]
