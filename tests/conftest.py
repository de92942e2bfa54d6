import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from knnscore.session import session

    s = session("local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for p in sorted(Path(SF).glob("*.parquet")):
        source = f"{p}/*.parquet" if os.path.isdir(p) else str(p)
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{source}'")
    return c


def same_rows(got, expected):
    """Equal as multisets of rows, columns by name; numbers with a fraction to 12 digits, as engines sum in other orders."""
    assert sorted(got.columns) == sorted(expected.columns)
    told = lambda x: f"{x:.12g}" if isinstance(x, float) else str(x)
    rows = lambda df: sorted(str(tuple(map(told, r))) for r in df[sorted(df.columns)].itertuples(index=False, name=None))
    assert rows(got) == rows(expected)
