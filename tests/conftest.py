import os
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH", "")) if x)
SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "6g", "spark.ui.showConsoleProgress": "false"}
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def _plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if hasattr(v, "asDict"):
        v = tuple(v)
    return tuple(_plain(x) for x in v) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="session")
def same_as_sql():
    def compare(df, sql, sf_dir=SMALL):
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
        cursor = con.execute(sql)
        names = [c[0] for c in cursor.description]
        assert sorted(names) == sorted(df.columns)
        want = sorted(repr([_plain(r[names.index(c)]) for c in sorted(names)]) for r in cursor.fetchall())
        got = sorted(repr([_plain(r[c]) for c in sorted(names)]) for r in df.collect())
        assert got == want
        return len(got)

    return compare
