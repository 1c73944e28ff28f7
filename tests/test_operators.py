"""Every declared operator agrees with DuckDB on the small tables; branches are really taken."""

import os
import zipfile
from io import BytesIO

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from markfield.functions.dialect import jsround, pearson, reflect
from markfield.plans import catalogue

@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_as_sql(spark, same_as_sql, name):
    assert same_as_sql(catalogue.QUERIES[name](spark, SMALL), catalogue.SQL[name]) > 0


def test_what_has_no_sql():
    assert set(catalogue.QUERIES) - set(catalogue.SQL) == catalogue.NO_SQL | set(catalogue.PROGRAMS)
    assert len(catalogue.QUERIES) > 110


def test_numeric_rules(spark):
    row = spark.sql(f"select {jsround('cast(-2.5 as double)')} a, {jsround('cast(2.5 as double)')} b, {reflect('-1', 8)} c, {reflect('-23', 8)} d, {pearson('2', '2', '3', '2', '5', '3')} e").first()
    assert (row.a, row.b, row.c, row.d, row.e) == (-2, 3, 1, 5, 0)


def test_every_gate_takes_both_branches(spark):
    for name, column in [("match_mode", "mode"), ("alpha_candidate_valid", "valid"), ("polarity_gate", "found"), ("batch_admission", "reason"), ("text_kind", "kind")]:
        assert catalogue.QUERIES[name](spark, "/root/testdata/sf0.01").select(column).distinct().count() > 1, name


def test_zip_sink_and_scan(spark, tmp_path):
    from markfield.sources.files import archives, scan_files

    (tmp_path / "a.bin").write_bytes(b"abc")
    (tmp_path / "empty.bin").write_bytes(b"")
    assert [r.length for r in scan_files(spark, str(tmp_path)).select("length").collect()] == [3]
    df = spark.createDataFrame([("x", 2, "二.png", bytearray(b"22")), ("x", 1, "one.png", bytearray(b"1"))], "batch string, at long, name string, content binary")
    z = zipfile.ZipFile(BytesIO(bytes(archives(df).first().content)))
    assert z.namelist() == ["one.png", "二.png"] and z.testzip() is None


def test_stream_results_once(spark, tmp_path):
    from markfield.sources.files import watch_files
    from markfield.streaming.queue import keep_results

    source = tmp_path / "in"
    source.mkdir()
    (source / "a.bin").write_bytes(b"abc")
    for _ in range(2):
        stream = watch_files(spark, str(source)).selectExpr("path as id", "modificationTime as saved_at", "length")
        keep_results(stream, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_region_union_is_dealt_out(spark, same_as_sql, tmp_path):
    out = catalogue.QUERIES["region_union"](spark, SMALL)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and "isnull((img" not in plan  # no null-aware join, which is a broadcast whatever the size
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().sparkPlan().toString()
    line = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    null = line.withColumn("l_orderkey", F.when(F.col("l_orderkey") % 5 != 0, F.col("l_orderkey")))
    texts = null.where("l_linenumber % 3 = 2 or l_partkey % 1000 <= 500")  # none is found elsewhere
    known = line.unionByName(null.where("l_linenumber % 3 = 2"))  # images unknown, but not of what is found
    for i, rows in enumerate((null, texts, known)):
        folder = tmp_path / str(i)
        folder.mkdir()
        for name in os.listdir(SMALL):
            if name != "lineitem.parquet":
                (folder / name).symlink_to(f"{SMALL}/{name}")
        rows.coalesce(1).write.parquet(str(folder / "made"))
        next((folder / "made").glob("*.parquet")).rename(folder / "lineitem.parquet")
        same_as_sql(catalogue.QUERIES["region_union"](spark, str(folder)), catalogue.SQL["region_union"], str(folder))
