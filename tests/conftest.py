import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("PYTHONPATH", "")
os.environ["PYTHONPATH"] = f"{Path(__file__).resolve().parent.parent}:{os.environ['PYTHONPATH']}"

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from qatlam.session import local_session

    session = local_session(4, 4, "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    if not Path(DATA).exists():
        pytest.skip("no test tables here")
    return DATA


@pytest.fixture(scope="session")
def duck(data):
    import duckdb

    con = duckdb.connect()
    for f in Path(data).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(value):
    """A value in a form that is the same from Spark and from DuckDB."""
    if value is None or value != value:
        return "null"
    if isinstance(value, list | tuple) or type(value).__name__ == "ndarray":
        return "[" + ",".join(map(plain, value)) + "]"
    if type(value).__name__ == "NaTType":
        return "null"
    if isinstance(value, bool) or type(value).__name__ == "bool":
        return str(bool(value))
    if hasattr(value, "item") and not isinstance(value, float | int):
        return plain(value.item())
    if isinstance(value, float):
        return str(int(value)) if value == int(value) else repr(round(value, 6))
    return value.isoformat()[:26] if hasattr(value, "isoformat") else str(value)


def rows_of(frame):
    return sorted(tuple(map(plain, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


def same(spark_df, duck_rel):
    a, b = spark_df.toPandas(), duck_rel.df()
    assert sorted(a.columns) == sorted(b.columns)
    assert rows_of(a) == rows_of(b)
