"""File intake: metadata scans that do not read contents, and a ZIP sink."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, modificationTime, length, content of non-empty files.  Columns that are not selected are not read, and the
    length filter reaches the scan."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).where(F.col("length") > 0)


def watch_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """The same as a stream: each file once, with its content."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    stream = spark.readStream.schema(schema).format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return stream.where(F.col("length") > 0)


def archives(entries: DataFrame) -> DataFrame:
    """batch, content binary: one stored ZIP a batch from rows of (batch, at, name, content), in order of `at`.  A batch
    is admitted with a byte limit, so a group is bounded."""

    def build(pdf):
        import pandas as pd

        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            for row in pdf.sort_values("at").itertuples():
                z.writestr(zipfile.ZipInfo(row.name), bytes(row.content or b""))
        return pd.DataFrame({"batch": [pdf["batch"].iloc[0]], "content": [out.getvalue()]})

    return entries.select("batch", "at", "name", "content").groupBy("batch").applyInPandas(build, "batch string, content binary")
