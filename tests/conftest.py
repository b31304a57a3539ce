import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def _plain(value):
    return None if isinstance(value, float) and value != value else round(value, 9) if isinstance(value, float) else value


@pytest.fixture(scope="session")
def same_as_sql():
    """Compares a DataFrame with DuckDB's answer over the same tables, in any order."""
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in sorted(os.listdir(DATA)):
        con.execute(f"CREATE VIEW {p.split('.')[0]} AS SELECT * FROM '{DATA}/{p}'")

    def check(frame, sql):
        columns = sorted(frame.columns)
        mine = sorted(repr(tuple(_plain(r[c]) for c in columns)) for r in frame.collect())
        cursor = con.execute(sql)
        names = [d[0] for d in cursor.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        assert mine == sorted(repr(tuple(_plain(r[i]) for i in at)) for r in cursor.fetchall())

    return check
