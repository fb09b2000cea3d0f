import os
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    tmp = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{tmp}/shared").config("spark.sql.warehouse.dir", f"{tmp}/warehouse").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(cells, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda x: "~" if x is None or x != x else repr(x + 0.0) if isinstance(x, float) else str(x)
    return sorted(tuple(show(r[i]) for i in order) for r in cells)


@pytest.fixture(scope="session")
def same(duck):
    """Spark rows and DuckDB rows are equal, in any order, and so are their column names."""

    def check(df, sql):
        duck.execute(sql)
        columns = [c[0] for c in duck.description]
        assert sorted(df.columns) == sorted(columns)
        assert rows(df.collect(), df.columns) == rows(duck.fetchall(), columns)

    return check
